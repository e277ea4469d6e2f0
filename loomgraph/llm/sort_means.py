"""Sort-means: Lloyd's clustering of integer vectors whose scans end by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import materialise, scrap, ship
from loomgraph.llm._vectors import integer_vectors, lists, matrix, no_lists, squared

#: Centroids at most: every task holds their distances to each other, sorted.
MOST_CENTROIDS = 2048

STATE = "vec_id bigint, q array<int>, cluster int, distance bigint, n bigint, sums array<bigint>"


def nearest(x: np.ndarray, previous: np.ndarray, centers: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number.

    ``order[a]`` lists the other centroids by their squared distance ``gaps[a]``
    from a.  A row scans its previous centroid's list until a gap is over twice
    its distance from that centroid: all later ones are farther than it.  Rows of
    one centroid are sorted by that distance, so those still scanning are a prefix.
    """
    best, least = previous.copy(), np.zeros(len(x))
    for a in np.unique(previous):
        rows = np.flatnonzero(previous == a)
        d = ((x[rows] - centers[a]) ** 2).sum(1)
        far = np.argsort(-d, kind="stable")
        rows, d = rows[far], d[far]
        own, number, low = x[rows], np.full(len(rows), a), d.copy()
        norms = (own * own).sum(1)
        scanning = len(rows) - np.searchsorted(4 * d[::-1], gaps[a], side="left")
        for c, m in zip(order[a], scanning):
            if not m:
                break
            new = norms[:m] - 2 * (own[:m] @ centers[c]) + centers[c] @ centers[c]
            better = (new < low[:m]) | ((new == low[:m]) & (c < number[:m]))
            number[:m][better], low[:m][better] = c, new[better]
        best[rows], least[rows] = number, low
    return best, least


def ordered(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance (ties by number) and these squared distances."""
    gaps = squared(centers, centers)
    np.fill_diagonal(gaps, -1)
    order = np.argsort(gaps, axis=1, kind="stable")
    return order[:, 1:], np.take_along_axis(gaps, order, 1)[:, 1:]


def _assign(centers: np.ndarray):
    """Per task: its rows with their nearest centroid, then one row of sums for each centroid it met."""
    order, gaps = ordered(centers)
    k, dim = centers.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("q"), dim)
            number, d = nearest(x, batch.column("cluster").to_numpy(), centers, order, gaps)
            for c in np.unique(number):
                own = x[number == c]
                counts[c] += len(own)
                sums[c] += own.sum(0).astype(np.int64)
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(number, pa.int32()), pa.array(d.astype(np.int64)), pa.nulls(n, pa.int64()), no_lists(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "cluster", "distance", "n", "sums"])
        met = np.flatnonzero(counts)
        if len(met):
            columns = [pa.nulls(len(met), pa.int64()), no_lists(len(met), pa.int32()), pa.array(met, pa.int32()), pa.nulls(len(met), pa.int64()), pa.array(counts[met]), lists(sums[met])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "cluster", "distance", "n", "sums"])

    return run


def moved(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The next centroids: floor(sum / count) of their vectors, empty ones as they are."""
    dim = centers.shape[1]
    parts = state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    out = centers.copy()
    for row in parts.collect():  # a row a centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def sort_means(embeddings: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) per kept row of ``embeddings`` (vec_id, embedding).

    Vectors with ``dim`` components, none null, NaN or infinite, are kept and
    turned into whole numbers, floor(scale * x).  The first centroids are the k
    rows with the smallest SHA-256 of ``<seed>:<vec_id>`` (all, where there are
    fewer; repeated ids by vector; a null id is hashed as an empty one).  Each round
    assigns every row to its nearest centroid (squared distance, ties to the
    smaller number) and moves each to the floor of its rows' mean; an empty one
    stays.  Then rows are assigned once more.  ``inertia`` is the sum of distances.

    A round is one pass over the table of rows and their last centroids, which
    writes the next such table and a row of sums for each task and centroid it
    met.  So a centroid that holds most rows is summed in all tasks, and the driver
    sees k sums.  Rounds cut lineage in the shared folder.  k is at most
    ``MOST_CENTROIDS``.  Repeated rows are rows of their own; an empty table gives
    none; other columns are ignored.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be 1 to {MOST_CENTROIDS}")
    spark = embeddings.sparkSession
    ship(spark)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    kept = integer_vectors(embeddings, scale, dim)
    start = [r["q"] for r in kept.orderBy(F.sha2(named, 256), "q").limit(k).select("q").collect()]
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid string"
    if not start:
        return spark.createDataFrame([], out)
    centers = np.array(start, dtype=np.float64)
    empty = "cast(null as bigint) distance", "cast(null as bigint) n", "cast(null as array<bigint>) sums"
    state, before = kept.selectExpr("vec_id", "q", "0 cluster", *empty), None
    for last in [False] * rounds + [True]:
        rows = state if before is None else state.where("n is null")
        state = materialise(rows.select("vec_id", "q", "cluster").mapInArrow(_assign(centers), STATE), "sort-means")
        if before is not None:
            scrap(spark, before)
        before = state
        if not last:
            centers = moved(state, centers)
    rows = state.where("n is null").select("vec_id", "cluster", "distance")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    named = [(i, sums[i], sum(sums.values()), ",".join(str(int(v)) for v in c)) for i, c in enumerate(centers) if i in sums]
    per = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid string")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
