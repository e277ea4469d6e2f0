"""Scores of a candidate pool: similarity, local centrality, reliability."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import clamp
from loomgraph.storage import ship

ALPHA, BETA, GAMMA = 0.8, 0.1, 0.1


def local_edges(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, source, target, edge_type, weight) of edges with both ends in a request's pool.

    ``edges`` may be such a table itself, of a larger pool.
    """
    if "request_id" in edges.columns:
        ends = pool.select("request_id", "id").distinct()
        out = edges.join(ends.toDF("request_id", "source"), ["request_id", "source"], "left_semi")
        return out.join(ends.toDF("request_id", "target"), ["request_id", "target"], "left_semi").select("request_id", "source", "target", "edge_type", "weight")
    ids = pool.select("request_id", F.col("id").alias("source"))
    out = ids.join(edges, "source")
    return out.join(pool.select("request_id", F.col("id").alias("target")), ["request_id", "target"], "left_semi").select("request_id", "source", "target", "edge_type", "weight")


def _rank(damping: float, rounds: int, tolerance: float):
    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids = np.sort(nodes["id"].to_numpy())
        n = len(ids)
        if n == 0:
            return pd.DataFrame({"request_id": [], "id": [], "pagerank": []})
        if len(links) == 0:
            rank = np.full(n, 1 / n)
        else:
            a = np.zeros((n, n))
            np.add.at(a, (np.searchsorted(ids, links["source"]), np.searchsorted(ids, links["target"])), links["weight"])
            total = a.sum(axis=1, keepdims=True)
            a = np.divide(a, total, out=np.zeros_like(a), where=total > 0)
            dangling, rank = total[:, 0] == 0, np.full(n, 1 / n)
            for _ in range(rounds):
                new = damping * (rank @ a + rank[dangling].sum() / n) + (1 - damping) / n
                done = np.abs(new - rank).sum() < n * tolerance
                rank = new
                if done:
                    break
            rank = rank / rank.max()
        return pd.DataFrame({"request_id": nodes["r"].iloc[0], "id": ids, "pagerank": rank})

    return run


def pagerank(pool: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(request_id, id, pagerank) over the REQUIRES edges inside each request's pool, divided by its maximum.

    Dangling mass is spread evenly; a pool without edges gives 1 / n each.
    Pools are at most a few dozen candidates, so each fits its own task.
    """
    ship(pool.sparkSession)
    inner = local_edges(pool, edges.where("edge_type = 'REQUIRES'"))
    left = pool.select(F.col("request_id").alias("r"), "id").groupBy("r")
    right = inner.select("request_id", "source", "target", "weight").toDF("r2", "source", "target", "weight").groupBy("r2")
    return left.cogroup(right).applyInPandas(_rank(damping, rounds, tolerance), "request_id long, id long, pagerank double")


def composite(similarity: Column, centrality: Column, reliability: Column, multiplier: Column | None = None) -> Column:
    """alpha * similarity + beta * centrality + gamma * reliability, each clamped to [0, 1], times a category's factor."""
    score = ALPHA * clamp(similarity) + BETA * clamp(centrality) + GAMMA * clamp(reliability)
    return score * (multiplier if multiplier is not None else F.lit(1.0))


def enhancement(kept: DataFrame) -> DataFrame:
    """(request_id, signed, enhancement, improved): mean score of all kept (score, is_seed) less that of the seeds, and what of it is gained."""
    seed = F.coalesce(F.avg(F.when(F.col("is_seed"), F.col("score"))), F.lit(0.0))
    gain = F.avg("score") - seed
    return kept.groupBy("request_id").agg(F.round(gain, 9).alias("signed"), F.round(F.greatest(F.lit(0.0), gain), 9).alias("enhancement"), F.bool_or(~F.col("is_seed")).alias("improved"))


def score(pool: DataFrame, skills: DataFrame, edges: DataFrame | None = None, multipliers: dict | None = None) -> DataFrame:
    """The pool with (pagerank, reliability, category, score); without ``edges`` centrality counts as 0.

    ``multipliers`` are factors by category; others have 1.
    """
    known = skills.select("id", F.col("execution_success_rate").alias("reliability"), "category")
    out = pool.join(known, "id")
    if edges is None:
        out = out.withColumn("pagerank", F.lit(0.0))
    else:
        out = out.join(pagerank(pool, edges), ["request_id", "id"], "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    factor = None
    if multipliers:
        table = F.create_map(*(F.lit(x) for k, v in multipliers.items() for x in (k, float(v))))
        factor = F.coalesce(F.try_element_at(table, F.col("category")), F.lit(1.0))
    return out.withColumn("score", F.round(composite(F.col("similarity"), F.col("pagerank"), F.col("reliability"), factor), 6))
