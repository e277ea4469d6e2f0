"""Vector top-k, seed recall and one-hop expansion, batched over requests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.vectors import clamp, cosine
from loomgraph.storage import cut, ship

TOP_K, OVER_FETCH, THRESHOLD = 5, 2, 0.3
#: Bytes of query vectors that are sent to every task at once.
QUERY_BYTES = 32 << 20


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column of ``dim`` numbers at length 1; a null vector stays null."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


#: Below any similarity.
NONE = -(1 << 40)
#: Similarities that a task holds at once.
CELLS = 1 << 22


class Best:
    """The k most similar rows of each request so far, similarities in millionths, ties to the smaller id."""

    def __init__(self, requests: int, k: int):
        self.near = np.full((requests, k), NONE, np.int64)
        self.ids = np.full((requests, k), np.iinfo(np.int64).max, np.int64)

    def add(self, rows: np.ndarray | slice, similarity: np.ndarray, ids: np.ndarray) -> None:
        """Offer requests ``rows`` the similarities of ``ids``, which ascend."""
        k, n = self.near.shape[1], len(ids)
        near = np.where(np.isfinite(similarity), np.rint(similarity * 1e6), NONE).astype(np.int64)
        if n > k:  # of one batch the k best, by a key that no two share
            key = near * n - np.arange(n)
            best = np.argpartition(-key, k - 1, axis=1)[:, :k]
            near, ids = np.take_along_axis(near, best, 1), ids[best]
        else:
            ids = np.broadcast_to(ids, near.shape)
        near, ids = np.concatenate([self.near[rows], near], 1), np.concatenate([self.ids[rows], ids], 1)
        order = np.lexsort((ids, -near), axis=1)[:, :k]
        self.near[rows], self.ids[rows] = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)

    def batches(self, names: np.ndarray):
        """(request_id, id, similarity) of what was offered."""
        row, at = np.nonzero(self.near > NONE)
        for s in range(0, len(row), 1 << 16):
            r, c = row[s : s + (1 << 16)], at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(self.ids[r, c]), pa.array(self.near[r, c] / 1e6 + 0.0)], names=["request_id", "id", "similarity"])


def _scan(queries: np.ndarray, names: np.ndarray, k: int):
    """Per batch of vectors one matrix product; a task gives the k best of all its batches."""

    def run(batches):
        best = Best(len(names), k)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            if len(ids):
                order = np.argsort(ids, kind="stable")
                vectors, step = unit(batch.column("vector"), queries.shape[1])[order].T, max(1, CELLS // len(ids))
                for s in range(0, len(names), step):
                    best.add(slice(s, s + step), queries[s : s + step] @ vectors, ids[order])
        yield from best.batches(names)

    return run


def blocks(requests: DataFrame, size: int):
    """(names, unit query vectors) of ``requests`` (request_id, query_vector), about ``size`` bytes at a time.

    The driver holds one block, read a partition at a time.
    """
    names, held, dim = [], [], None
    for r in requests.select("request_id", "query_vector").where("request_id is not null and query_vector is not null").toLocalIterator():
        dim = dim or len(r["query_vector"])
        if len(r["query_vector"]) != dim:
            raise ValueError("query vectors differ in length")
        names.append(r["request_id"])
        held.append(r["query_vector"])
        if 8 * dim * len(held) >= size:
            yield np.array(names), unit(pa.array(held), dim)
            names, held = [], []
    if held:
        yield np.array(names), unit(pa.array(held), dim)


def ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def over_blocks(requests: DataFrame, search, k: int, spark: SparkSession) -> DataFrame:
    """(request_id, id, similarity, rank) of ``search(names, queries)``, a block of requests at a time.

    Where there are several blocks each one's result is written before the next
    is read, so neither the plan nor the driver holds more than one.
    """
    found, last = None, None
    for names, queries in blocks(requests, QUERY_BYTES):
        if last is not None:
            done = cut(ranked(last, k))
            found = done if found is None else found.unionByName(done)
        last = search(names, queries)
    if last is None:
        return spark.createDataFrame([], "request_id long, id long, similarity double, rank int")
    return ranked(last, k) if found is None else found.unionByName(ranked(last, k))


def top_k(requests: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(request_id, id, similarity, rank): the exact k most similar vectors of each request.

    Similarities are rounded to six places and ties go to the smaller id; vectors
    of another length than the queries', null ones and null ids have none, null
    queries no result.  Query vectors go to the tasks in blocks of at most
    ``QUERY_BYTES``, a pass over the vectors each; a task keeps the k best of all
    its vectors, so k rows a request and task are shuffled.
    """
    ship(vectors.sparkSession)
    pair = vectors.select(F.col("id").cast("long").alias("id"), "vector").where("id is not null and vector is not null")

    def search(names: np.ndarray, queries: np.ndarray) -> DataFrame:
        return pair.where(F.size("vector") == queries.shape[1]).mapInArrow(_scan(queries, names, k), "request_id long, id long, similarity double")

    return over_blocks(requests, search, k, vectors.sparkSession)


def recall(requests: DataFrame, skills: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(request_id, id, similarity, rank): seeds.

    The 2k nearest are cut first; then deprecated skills and those under the
    threshold go, and k stay.  A request that the threshold leaves without seeds
    is served without it.
    """
    near = top_k(requests, skills, k * OVER_FETCH).drop("rank").join(skills.select("id", "is_deprecated"), "id").where("not is_deprecated")
    per = Window.partitionBy("request_id")
    near = near.withColumn("similarity", clamp(F.col("similarity"))).withColumn("passes", F.col("similarity") >= threshold)
    near = near.withColumn("any", F.max("passes").over(per)).where("passes or not any")
    ranked = near.withColumn("rank", F.row_number().over(per.orderBy(F.desc("similarity"), "id")))
    return ranked.where(F.col("rank") <= k).select("request_id", "id", "similarity", "rank")


def expand(seeds: DataFrame, edges: DataFrame, skills: DataFrame, vectors_of: DataFrame | None = None, vector_only: bool = False) -> DataFrame:
    """(request_id, id, similarity, depth, is_seed, edge_type): seeds and their out-neighbours, one hop.

    Over REQUIRES and ENHANCES edges to skills that are not deprecated; a
    neighbour of several seeds is found by the best-ranked, then by edge type.
    ``vectors_of`` (request_id, query_vector) gives neighbours their similarity.
    """
    own = seeds.select("request_id", "id", "similarity", F.lit(0).alias("depth"), F.lit(True).alias("is_seed"), F.lit(None).cast("string").alias("edge_type"))
    if vector_only:
        return own
    out = edges.where("edge_type in ('REQUIRES', 'ENHANCES')").select("source", "target", "edge_type").distinct()
    hop = seeds.select("request_id", F.col("id").alias("source"), "rank").join(out, "source")
    hop = hop.join(skills.where("not is_deprecated").select(F.col("id").alias("target"), "vector"), "target")
    hop = hop.join(seeds.select("request_id", F.col("id").alias("target")), ["request_id", "target"], "left_anti")
    first = Window.partitionBy("request_id", "target").orderBy("rank", F.when(F.col("edge_type") == "REQUIRES", 1).otherwise(3))
    hop = hop.withColumn("n", F.row_number().over(first)).where("n = 1")
    if vectors_of is None:
        similarity = F.lit(0.0)
    else:
        hop = hop.join(vectors_of, "request_id")
        similarity = clamp(F.round(cosine("query_vector", "vector"), 6))
    return own.unionByName(hop.select("request_id", F.col("target").alias("id"), similarity.alias("similarity"), F.lit(1).alias("depth"), F.lit(False).alias("is_seed"), "edge_type"))


def constrain(pool: DataFrame, skills: DataFrame, excluded: list[int] | None = None, min_reliability: float = 0.5, required: list[int] | None = None, categories: list | None = None) -> DataFrame:
    """The pool without excluded skills, those under a success rate and those of other categories.

    ``required`` skills (an extension) stay whatever the other rules say, and
    count as seeds; those that a pool doesn't hold come in with similarity 0.
    """
    good = F.col("execution_success_rate") >= min_reliability
    if categories is not None:
        good = good & F.col("category").isin(categories)
    if excluded:
        good = good & ~F.col("id").isin(excluded)
    if not required:
        return pool.join(skills.where(good).select("id"), "id", "left_semi")
    forced = F.col("id").isin(required)
    kept = pool.join(skills.where(good | forced).select("id"), "id", "left_semi").withColumn("is_seed", F.col("is_seed") | forced)
    wanted = pool.select("request_id").distinct().crossJoin(F.broadcast(skills.where(forced).select("id")))  # as many as are named
    new = wanted.join(pool.select("request_id", "id"), ["request_id", "id"], "left_anti")
    fixed = {"similarity": F.lit(0.0), "depth": F.lit(0), "is_seed": F.lit(True), "edge_type": F.lit(None).cast("string")}
    return kept.unionByName(new.select(*(fixed.get(c, F.col(c) if c in ("request_id", "id") else F.lit(None)).alias(c) for c in kept.columns)))
