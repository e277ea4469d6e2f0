"""The routing plan: from requests to selected skills, for all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.assembly import assemble, cap
from loomgraph.operators.conflicts import conflict_edges, independent_set
from loomgraph.operators.retrieval import constrain, expand, recall
from loomgraph.operators.scoring import local_edges, score
from loomgraph.storage import cut


def candidates(requests: DataFrame, skills: DataFrame, edges: DataFrame, centrality: bool = True, min_reliability: float = 0.5, **rules) -> tuple[DataFrame, DataFrame]:
    """(seeds, scored pool) of each request; both are used several times, so each is computed once.

    ``rules`` go to ``constrain`` (excluded, required, categories) and to
    ``score`` (multipliers).
    """
    multipliers = rules.pop("multipliers", None)
    seeds = cut(recall(requests, skills))
    pool = constrain(expand(seeds, edges, skills, requests), skills, min_reliability=min_reliability, **rules)
    return seeds, cut(score(cut(pool) if centrality else pool, skills, edges if centrality else None, multipliers))


def quality(pool: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, skill_coverage, dependency_correctness, conflict_resolution) of the kept candidates.

    Shares of the seeds kept (0 without seeds), of the candidates reached over
    REQUIRES kept, and of the pool's conflicts that are gone (1 without any).
    """
    in_ = pool.select("request_id", "id", "is_seed", "edge_type").join(kept.select("request_id", "id", F.lit(True).alias("in")), ["request_id", "id"], "left")
    seed, need, stays = F.col("is_seed"), F.coalesce(F.col("edge_type") == "REQUIRES", F.lit(False)), F.col("in").isNotNull()
    share = lambda part, whole, none: F.when(whole > 0, part / whole).otherwise(none)
    per = in_.groupBy("request_id").agg(share(F.count_if(seed & stays), F.count_if(seed), 0.0).alias("a"), share(F.count_if(need & stays), F.count_if(need), 1.0).alias("b"))
    clash = conflict_edges(pool, edges)
    left = conflict_edges(kept, edges).withColumn("left", F.lit(True))
    gone = clash.join(left, ["request_id", "a", "b"], "left").groupBy("request_id").agg((F.count_if(F.col("left").isNull()) / F.count("*")).alias("c"))
    out = per.join(gone, "request_id", "left")
    return out.select("request_id", F.round("a", 6).alias("skill_coverage"), F.round("b", 6).alias("dependency_correctness"), F.round(F.coalesce("c", F.lit(1.0)), 6).alias("conflict_resolution"))


def decide(seeds: DataFrame, scored: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, id, similarity, is_seed, score, mode) of what is selected.

    Where a non-seed survives the protected independent set the request is
    ``enhanced``: seeds and survivors, capped to the top; otherwise its seeds
    stand alone as the ``baseline``.
    """
    kept = cut(independent_set(scored, edges).select("request_id", "id"))
    survivors = scored.join(kept, ["request_id", "id"], "left_semi")
    improved = survivors.groupBy("request_id").agg(F.bool_or(~F.col("is_seed")).alias("improved"))
    flags = seeds.select("request_id").distinct().join(improved, "request_id", "left").select("request_id", F.coalesce("improved", F.lit(False)).alias("improved"))
    up = cap(survivors.join(flags.where("improved"), "request_id").drop("improved"))
    up = up.select("request_id", "id").join(scored.select("request_id", "id", "similarity", "is_seed", "score"), ["request_id", "id"]).withColumn("mode", F.lit("enhanced"))
    base = seeds.join(flags.where("not improved"), "request_id").select("request_id", "id", "similarity", F.lit(True).alias("is_seed"), F.col("similarity").alias("score"), F.lit("baseline").alias("mode"))
    return cut(up.unionByName(base))


def metrics(selected: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Per request: confidence, seed coverage and conflicts left among the selected."""
    clash = conflict_edges(selected.select("request_id", "id"), edges).groupBy("request_id").agg(F.count("*").alias("n_conflicts"))
    per = selected.groupBy("request_id").agg(F.count("*").alias("n_selected"), F.least(F.lit(1.0), F.avg("score")).alias("c"), F.count_if("is_seed").alias("n_seed"), F.first("mode").alias("mode"))
    total = seeds.groupBy("request_id").agg(F.count("*").alias("n_seeds"))
    return total.join(per, "request_id", "left").join(clash, "request_id", "left").select(
        "request_id",
        "mode",
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"),
        F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"),
        F.round(F.coalesce("n_seed", F.lit(0)) / F.col("n_seeds"), 6).alias("seed_coverage"),
        F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"),
    )


def vector_only(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """The fallback response: seeds alone, with confidence 0.5 and no text."""
    return recall(requests, skills).select("request_id", "id", "similarity", F.lit(0.5).alias("confidence"), F.lit(0).cast("long").alias("tokens"))


def route(requests: DataFrame, skills: DataFrame, edges: DataFrame, centrality: bool = True, **rules) -> DataFrame:
    """(request_id, mode, ids, used, assembled_text, confidence, ...): the nested response of each request.

    The edges inside each pool are found once; pruning, ordering and counting
    conflicts read them instead of the whole graph.
    """
    seeds, scored = candidates(requests, skills, edges, centrality, **rules)
    inner = cut(local_edges(scored.select("request_id", "id").union(seeds.select("request_id", "id")).distinct(), edges))
    selected = decide(seeds, scored, inner)
    typed = selected.join(scored.select("request_id", "id", "edge_type"), ["request_id", "id"], "left")
    text = assemble(selected.select("request_id", "id"), typed, skills, inner)
    return metrics(selected, seeds, inner).join(text, "request_id", "left")
