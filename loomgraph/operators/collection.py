"""Stored vector collections: coarse cells with residual codes, searched by probing, and exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.vectors import cosine
from loomgraph.operators.retrieval import CELLS, Best, over_blocks, ranked, top_k, unit
from loomgraph.sources.store import Change, Store, Table
from loomgraph.storage import cut, ship

#: Cells at most (each is a bucket of the store), and rows and bytes of vectors that centroids are fitted on.
MOST_CELLS, SAMPLE_ROWS, SAMPLE_BYTES = 1024, 20_000, 64 << 20
FIT_ROUNDS = 10
#: Stored vectors that the number of probes is measured with, and the share of true neighbours it must reach.
TUNE_ROWS, RECALL = 200, 0.95


def fit(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by a few rounds of Lloyd's, from evenly spaced rows; empty ones stay."""
    centers = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        cell = (vectors @ centers.T).argmax(1)
        sums, counts = np.zeros_like(centers), np.bincount(cell, minlength=cells)
        np.add.at(sums, cell, vectors)
        full = counts > 0
        centers[full] = sums[full] / np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-300)
    return centers


def _encode(centers: np.ndarray, scale: float):
    """Per vector its cell and the residual's components in steps of ``scale``, a signed byte each."""
    kind = pa.struct([("cell", pa.int32()), ("code", pa.binary())])

    def run(column: pa.Array) -> pa.Array:
        n, dim = len(column), centers.shape[1]
        v = unit(column, dim)
        cell = (v @ centers.T).argmax(1) if n else np.zeros(0, int)
        code = np.clip(np.rint((v - centers[cell]) / scale), -127, 127).astype(np.int8)
        codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.py_buffer(code.tobytes())])
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), codes], fields=list(kind))

    return run


def _probe(centers: np.ndarray, scale: float, queries: np.ndarray, names: np.ndarray, probes: np.ndarray, k: int):
    """Per task the k best of the rows in each request's cells, by their codes."""
    dim = centers.shape[1]

    def run(batches):
        wanted = [np.flatnonzero((probes == c).any(1)) for c in range(len(centers))]
        best = Best(len(names), k)
        for batch in batches:
            ids, cell = batch.column("id").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy(zero_copy_only=False)
            code = batch.column("code")
            steps = np.frombuffer(code.buffers()[2], np.int8)[code.offset * dim : (code.offset + len(code)) * dim].reshape(-1, dim) if len(code) else None
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                rows = rows[np.argsort(ids[rows], kind="stable")]
                near = (centers[c] + steps[rows] * scale).T
                step = max(1, CELLS // len(rows))
                for s in range(0, len(wanted[c]), step):
                    asked = wanted[c][s : s + step]
                    best.add(asked, queries[asked] @ near, ids[rows])
        yield from best.batches(names)

    return run


class Collection:
    """Vectors with attributes under a path: a table a cell, in versions of a ``Store``.

    Centroids are fitted once, on a bounded sample of the first vectors
    (``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes, chosen by a hash of the id), as
    many as the root of their number, up to ``MOST_CELLS``.  Every vector lies in
    its nearest centroid's cell with its residual as signed bytes.  A search reads
    the codes of the cells nearest to each query, takes a shortlist, and ranks it by
    the vectors themselves.  How many cells that are is measured: ``tune`` takes
    the number that holds ``RECALL`` of the true neighbours of ``TUNE_ROWS`` stored vectors.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        settings = {r["name"]: r["value"] for r in self.store.read("settings").collect()}
        self.dim, self.scale, self.probes = int(settings["dim"]), settings["scale"], int(settings["probes"])
        self.centers = np.array([r["center"] for r in self.store.read("centroids").orderBy("cell").collect()])  # at most MOST_CELLS

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, vectors: DataFrame, attributes: str = "", cells: int | None = None) -> Collection:
        """The collection under ``path``; made where there is none, with centroids fitted on ``vectors`` (id, vector).

        ``attributes`` are further columns, as a schema string.  It has no rows until ``upsert``.
        """
        try:
            old = cls(spark, path)
        except FileNotFoundError:
            pass
        else:
            if old.dim != dim:
                raise ValueError(f"the collection has {old.dim} components")
            return old
        good = vectors.where(cls._fits(dim))
        n = good.count()
        most = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))
        rows = good.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").collect()
        sample = unit(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), dim)
        k = min(cells or int(np.ceil(np.sqrt(max(n, 1)))), MOST_CELLS, max(len(rows), 1))
        centers = fit(sample, k) if rows else np.zeros((1, dim))
        residual = sample - centers[(sample @ centers.T).argmax(1)]
        scale = float(np.abs(residual).max()) / 127 if rows else 0.0
        more = f", {attributes}" if attributes else ""
        tables = {
            "vectors": Table(f"id long, cell int, vector array<double>, code binary{more}", ("id",), len(centers), by="cell"),
            "centroids": Table("cell int, center array<double>", ("cell",), 1),
            "settings": Table("name string, value double", ("name",), 1),
        }
        store = Store.create(spark, path, tables)
        placed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], tables["centroids"].schema)
        settings = {"dim": dim, "scale": scale or 1.0, "probes": len(centers)}
        store.commit("create", {"centroids": Change(placed), "settings": Change(spark.createDataFrame([(k, float(v)) for k, v in settings.items()], tables["settings"].schema))})
        return cls(spark, path)

    @staticmethod
    def _fits(dim: int):
        v = F.col("vector")
        return F.coalesce(F.col("id").isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

    def rejected(self, rows: DataFrame) -> DataFrame:
        """(id, reason) of rows that ``upsert`` leaves out."""
        reason = F.when(F.col("id").isNull(), "no id").when(F.col("vector").isNull(), "no vector").when(F.size("vector") != self.dim, "dimension").otherwise("not finite")
        return rows.where(~self._fits(self.dim)).select("id", reason.alias("reason"))

    def upsert(self, batch: str, rows: DataFrame, order: str | None = None) -> int:
        """Put (id, vector, attributes) over known ids and return the version; rows that don't fit are left out (see ``rejected``).

        Of several rows of an id the one with the greatest ``order`` holds.
        """
        ship(self.spark)
        kind = "struct<cell:int,code:binary>"
        vector = F.transform("vector", lambda x: x.cast("double"))
        placed = rows.where(self._fits(self.dim)).withColumn("vector", vector).withColumn("at", F.arrow_udf(_encode(self.centers, self.scale), kind)("vector"))
        columns = [c for c in self.store.tables["vectors"].struct().names if c not in ("cell", "code")]
        extra = [order] if order and order not in columns else []
        return self.store.commit(batch, {"vectors": Change(placed.select(*columns, *extra, "at.cell", "at.code"), order=order)})

    def delete(self, batch: str, ids: DataFrame) -> int:
        """Take ids out and return the version."""
        return self.store.commit(batch, {"vectors": Change(deletes=ids.where("id is not null"))})

    def rows(self, where: str | None = None, version: int | None = None) -> DataFrame:
        """The stored rows; a condition on attributes goes into the scan."""
        found = self.store.read("vectors", version).drop("code", "cell")
        return found.where(where) if where else found

    def exact(self, requests: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """(request_id, id, similarity, rank): the k nearest among all rows that meet the condition."""
        return top_k(requests, self.rows(where).select("id", "vector"), k)

    def search(self, requests: DataFrame, k: int, where: str | None = None, probes: int | None = None, refine: int = 4) -> DataFrame:
        """(request_id, id, similarity, rank): the k nearest found in the nearest cells of each request (request_id, query_vector).

        ``where`` is a condition on attributes, met before the shortlist of
        ``refine`` * k is taken.  Requests whose cells hold fewer than k such rows are
        searched exactly, so a request gets k rows wherever there are k.
        """
        ship(self.spark)
        centers, scale = self.centers, self.scale
        probes = min(probes or self.probes, len(centers))

        def codes(names: np.ndarray, queries: np.ndarray) -> DataFrame:
            if queries.shape[1] != self.dim:
                raise ValueError(f"queries need {self.dim} components")
            cells = np.argsort(-(queries @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            table = self.store.read("vectors", buckets=np.unique(cells).tolist())
            table = table.where(where) if where else table
            return table.select("id", "cell", "code").mapInArrow(_probe(centers, scale, queries, names, cells, k * refine), "request_id long, id long, similarity double")

        shortlist = over_blocks(requests, codes, k * refine, self.spark).select("request_id", "id")
        near = shortlist.join(self.rows().select("id", "vector"), "id").join(requests.select("request_id", "query_vector"), "request_id")
        found = cut(ranked(near.select("request_id", "id", F.round(cosine("query_vector", "vector"), 6).alias("similarity")), k))
        full = found.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("request_id")
        lacking = cut(requests.select("request_id", "query_vector").join(full, "request_id", "left_anti"))
        if lacking.isEmpty():
            return found
        return found.join(full, "request_id", "left_semi").unionByName(self.exact(lacking, k, where))

    def tune(self, k: int = 10, recall: float = RECALL) -> int:
        """Set and return the number of cells to probe: the least that holds ``recall`` of the k true neighbours of a sample."""
        rows = self.store.read("vectors").select("id", "vector", "cell")
        sample = cut(rows.orderBy(F.xxhash64("id"), "id").limit(TUNE_ROWS))
        true = top_k(sample.select(F.col("id").alias("request_id"), F.col("vector").alias("query_vector")), rows, k + 1).where("request_id <> id")
        cells = true.join(rows.select("id", "cell"), "id").select("request_id", "cell").collect()  # at most TUNE_ROWS * k
        asked = {r["id"]: unit(pa.array([r["vector"]]), self.dim)[0] for r in sample.collect()}
        place = {i: np.argsort(np.argsort(-(self.centers @ q), kind="stable")) for i, q in asked.items()}
        need = np.sort([place[r["request_id"]][r["cell"]] + 1 for r in cells])
        probes = int(need[int(np.ceil(recall * len(need))) - 1]) if len(need) else len(self.centers)
        self.store.commit(f"probes-{self.store.manifest()['version']}", {"settings": Change(self.spark.createDataFrame([("probes", float(probes))], "name string, value double"))})
        self.probes = probes
        return probes
