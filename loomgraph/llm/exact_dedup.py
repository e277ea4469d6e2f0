"""Exact deduplication over a stored index: cuckoo filters of live digests in front of bucketed content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._shared import delete, fresh, materialise, new_path, same_text, ship

SLOTS, MAX_KICKS = 4, 200
#: Digests that one shard's filter holds when the index is made, about.
SHARD_DIGESTS = 200_000
#: A filter that outgrows so many bytes, some four times as many digests, splits the shards.
CELL_BYTES = 1 << 21
#: Shards whose content folders are listed for a read; of more hits than that all folders are read.
LISTED = 1000
#: Batches that a table is inserted in: the later ones probe the filters of those before.
BATCHES = 2
ENTRY = "d64 long, sha string, keep_id long, keep_row long, n long"


class CuckooFilter:
    """A partial-key cuckoo filter of 16-bit fingerprints, four a bucket.

    It keeps no keys: ``insert`` returns False when a kick chain overflows, and
    the owner then builds a larger filter from its stored keys.  A key inserted
    twice is to be deleted twice.
    """

    def __init__(self, buckets: int = 256):
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]

    @staticmethod
    def of(keys: list[int]) -> CuckooFilter:
        """The smallest filter, by doubling, that takes all keys."""
        buckets = 256
        while buckets * SLOTS * 0.9 < len(keys):
            buckets *= 2
        while True:
            out = CuckooFilter(buckets)
            if all(map(out.insert, keys)):
                return out
            buckets *= 2

    def place(self, key: int) -> tuple[int, int]:
        return (key >> 20) & self.mask, (key & 0xFFFF) or 1

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, key: int) -> bool:
        bucket, mark = self.place(key)
        return mark in self.slots[bucket] or mark in self.slots[self.other(bucket, mark)]

    def insert(self, key: int) -> bool:
        bucket, mark = self.place(key)
        second = self.other(bucket, mark)
        for b in (bucket, second):
            if len(self.slots[b]) < SLOTS:
                self.slots[b].append(mark)
                return True
        bucket = second
        for kick in range(MAX_KICKS):
            held = self.slots[bucket]
            mark, held[kick % SLOTS] = held[kick % SLOTS], mark
            bucket = self.other(bucket, mark)
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return True
        return False

    def delete(self, key: int) -> bool:
        bucket, mark = self.place(key)
        for b in (bucket, self.other(bucket, mark)):
            if mark in self.slots[b]:
                self.slots[b].remove(mark)
                return True
        return False

    def store(self) -> bytes:
        """The fingerprints as (buckets, 4) little-endian 16-bit numbers, 0 where free."""
        out = np.zeros((len(self.slots), SLOTS), "<u2")
        for k, held in enumerate(self.slots):
            out[k, : len(held)] = held
        return out.tobytes()

    @staticmethod
    def load(stored: bytes) -> CuckooFilter:
        rows = np.frombuffer(stored, "<u2").reshape(-1, SLOTS).tolist()
        out = CuckooFilter(len(rows))
        out.slots = [[m for m in r if m] for r in rows]
        return out


def probe(stored: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys a stored filter may hold, for all at once."""
    table = np.frombuffer(stored, "<u2").reshape(-1, SLOTS)
    mask = len(table) - 1
    marks = keys & 0xFFFF
    marks = np.where(marks == 0, 1, marks)
    first = (keys >> 20) & mask
    second = (first ^ (marks * 0x5BD1E995)) & mask
    return ((table[first] == marks[:, None]) | (table[second] == marks[:, None])).any(axis=1)


def _hits(filters: pa.Table, keys: pa.Table) -> pa.Table:
    """The keys of one shard that its filter may hold."""
    if not filters.num_rows:
        return keys.slice(0, 0).select(["shard", "d64"])
    ok = probe(filters.column("cells")[0].as_py(), keys.column("d64").to_numpy())
    return keys.select(["shard", "d64"]).filter(pa.array(ok))


def _revise(filters: pa.Table, keys: pa.Table) -> pa.Table:
    """One shard's filter after its deletions, then insertions; null cells where an insertion overflows."""
    shard = (filters if filters.num_rows else keys).column("shard")[0]
    if not keys.num_rows:
        return filters.select(["shard", "cells"])
    held = CuckooFilter.load(filters.column("cells")[0].as_py())
    live, d64 = keys.column("live").to_numpy(zero_copy_only=False), keys.column("d64").to_numpy()
    for key in d64[~live].tolist():
        held.delete(key)
    fits = all(map(held.insert, d64[live].tolist()))
    return pa.table({"shard": pa.array([shard.as_py()], pa.int32()), "cells": pa.array([held.store() if fits else None], pa.binary())})


def _rebuild(keys: pa.Table) -> pa.Table:
    """A larger filter of one shard from its stored keys."""
    return pa.table({"shard": keys.column("shard").slice(0, 1).cast(pa.int32()), "cells": pa.array([CuckooFilter.of(keys.column("d64").to_pylist()).store()], pa.binary())})


def _build(shards: pa.Table, keys: pa.Table) -> pa.Table:
    """The filter of one shard from its stored keys, of which it may have none."""
    return pa.table({"shard": shards.column("shard"), "cells": pa.array([CuckooFilter.of(keys.column("d64").to_pylist()).store()], pa.binary())})


CELLS = "shard int, cells binary"


class DigestIndex:
    """Live digests under ``path``: member rows, entries bucketed by shard, and one cuckoo filter a shard.

    A batch is appended: ``members`` or ``deletes`` rows as they came, the
    ``content`` entries (one a digest: its smallest row and number of members) of
    the digests that it touched, and the ``filters`` after it, whose ``_SUCCESS``
    file is its commit; what a lost driver left without it is written anew.  The
    latest entry of a digest holds.

    Inserted digests are combined, map-side first, so a hot digest moves as one
    row a task, and probe the stored filters of their shards.  A miss is new at
    once and reads no content; hits are verified by SHA-256 in the buckets of
    their shards alone.  Digests without live members leave the filter.  A filter
    that overflows is built anew, larger, from the stored keys of its shard; one
    that has become too large for a task doubles the shards, so that a shard's
    digests stay bounded however many batches come.
    """

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path, self.batch, self.shards, self.least = spark, path.rstrip("/"), 0, 0, 0
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        while fs.exists(place(f"{self.path}/filters/batch={self.batch + 1}/_SUCCESS")):
            self.batch += 1
        if self.batch:
            self.shards = self.filters().count()
            self.least = self.spark.read.schema(CELLS).parquet(self._at("filters", 0)).count()

    def _at(self, table: str, batch: int | None = None) -> str:
        return f"{self.path}/{table}/batch={self.batch if batch is None else batch}"

    def filters(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(self._at("filters"))

    def _all(self, table: str, schema: str, upto: int) -> DataFrame | None:
        """All rows of a table's batches with their number."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = place(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [k for k in range(1, upto + 1) if fs.exists(place(self._at(table, k)))]
        if not found:
            return None
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{table}").parquet(*(self._at(table, k) for k in found))

    def members(self) -> DataFrame:
        """(doc_id, row, d64, sha) of the rows that are in the index."""
        return self._live(self.batch)

    def _live(self, upto: int) -> DataFrame:
        rows = self._all("members", "doc_id long, row long, d64 long, sha string", upto)
        gone = self._all("deletes", "doc_id long, sha string", upto)
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, row long, d64 long, sha string")
        if gone is not None:
            g = gone.select(F.col("doc_id").alias("g"), F.col("sha").alias("s"), F.col("batch").alias("b"))
            rows = rows.join(g, (F.col("sha") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("batch") < F.col("b")), "left_anti")
        return rows.select("doc_id", "row", "d64", "sha")

    def _content(self, upto: int, shards: DataFrame | None = None) -> DataFrame:
        rows = self._all("content", f"{ENTRY}, shard int", upto)
        if rows is None:
            return self.spark.createDataFrame([], f"{ENTRY}, shard int")
        if shards is not None and len(hit := shards.distinct().limit(LISTED + 1).collect()) <= LISTED:
            # A digest's folder is its shard of the time, when there were fewer by some doublings.
            counts = [self.least]
            while counts[-1] < self.shards:
                counts.append(2 * counts[-1])
            rows = rows.where(F.col("shard").isin(sorted({r["shard"] % c for r in hit for c in counts})))
        if upto == 1:
            return self._sharded(rows).drop("batch")
        latest = rows.groupBy("d64", "sha").agg(F.max_by(F.struct("keep_id", "keep_row", "n"), "batch").alias("x"))
        return self._sharded(latest.select("d64", "sha", "x.keep_id", "x.keep_row", "x.n").where("n > 0"))

    def entries(self) -> DataFrame:
        """(d64, sha, keep_id, keep_row, n): the live digests, their smallest (doc_id, row) and number of members."""
        return self._content(self.batch).drop("shard")

    def _cogroup(self, kernel, keys: DataFrame, schema: str) -> DataFrame:
        return self.filters().groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(kernel, schema)

    def _commit(self, touched: DataFrame, keys: DataFrame) -> None:
        """Write the touched entries and the filters after ``keys`` (shard, d64, live); the batch is then in the index."""
        k = self.batch + 1
        touched.repartition(F.col("shard")).write.mode("overwrite").partitionBy("shard").parquet(self._at("content", k))
        revised = materialise(self._cogroup(_revise, keys, CELLS), "filters")
        full = revised.where("cells is null").select("shard")
        if not full.isEmpty():
            stored = self._content(k, full).select("shard", "d64").distinct()
            revised = materialise(revised.where("cells is not null").unionByName(stored.groupBy("shard").applyInArrow(_rebuild, CELLS)), "filters")
            while revised.agg(F.max(F.length("cells"))).first()[0] > CELL_BYTES:
                revised = materialise(self._split(k), "filters")
        revised.write.mode("overwrite").parquet(self._at("filters", k))
        self.batch = k

    def _split(self, k: int) -> DataFrame:
        """The filters of twice as many shards, from the keys stored up to batch ``k``."""
        self.shards *= 2
        keys = self._content(k).select("shard", "d64").distinct()
        every = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        return every.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(_build, CELLS)

    def _start(self, digests: int) -> None:
        self.shards = self.least = max(1, -(-digests // SHARD_DIGESTS), min(8, digests))
        empty = F.lit(CuckooFilter().store())
        self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"), empty.alias("cells")).write.mode("overwrite").parquet(self._at("filters", 0))

    def _sharded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod("d64", F.lit(self.shards)).cast("int"))

    def insert(self, rows: DataFrame) -> None:
        """Add ``rows`` of digests() (doc_id, row, d64, sha) as one batch."""
        k = self.batch + 1
        delete(self.spark, self._at("deletes", k))  # of a batch that was never committed
        rows.select("doc_id", "row", "d64", "sha").write.mode("overwrite").parquet(self._at("members", k))
        own = self.spark.read.schema("doc_id long, row long, d64 long, sha string").parquet(self._at("members", k))
        order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
        combined = own.groupBy("d64", "sha").agg(F.min(order).alias("k"), F.count("*").alias("n"))
        changes = materialise(combined.select("d64", "sha", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "n"), "digest-changes")
        if not self.shards:
            self._start(changes.count())
            return self._add(self._sharded(changes), None)
        changes = self._sharded(changes)
        hits = materialise(self._cogroup(_hits, changes.select("shard", "d64").distinct(), "shard int, d64 long"), "filter-hits")
        return self._add(changes, None if hits.isEmpty() else hits)

    def _add(self, changes: DataFrame, hits: DataFrame | None) -> None:
        new = changes.select("shard", "d64").distinct()
        if hits is not None:
            known = materialise(self._content(self.batch, hits.select("shard")).join(hits.select("d64"), "d64", "left_semi"), "verified")
            old = known.select(F.col("d64").alias("od"), F.col("sha").alias("os"), F.struct(F.col("keep_id").isNull().alias("null"), "keep_id", "keep_row").alias("ok"), F.col("n").alias("on"))
            both = changes.join(old, (F.col("d64") == F.col("od")) & (F.col("sha") == F.col("os")), "left")
            least = F.least(F.struct(F.col("keep_id").isNull().alias("null"), "keep_id", "keep_row"), F.col("ok"))
            changes = both.select("d64", "sha", least["keep_id"].alias("keep_id"), least["keep_row"].alias("keep_row"), (F.col("n") + F.coalesce("on", F.lit(0))).alias("n"), "shard")
            new = new.join(known.select("d64").distinct(), "d64", "left_anti")
        self._commit(changes, new.select("shard", "d64", F.lit(True).alias("live")))

    def delete(self, rows: DataFrame) -> None:
        """Take out the members with the ids and digests of ``rows`` (doc_id, d64, sha); unknown ones are ignored."""
        if not self.batch:
            return
        k = self.batch + 1
        delete(self.spark, self._at("members", k))
        rows.select("doc_id", "sha").distinct().write.mode("overwrite").parquet(self._at("deletes", k))
        asked = materialise(self._sharded(rows.select("d64", "sha").distinct()), "asked")
        hits = materialise(self._cogroup(_hits, asked.select("shard", "d64").distinct(), "shard int, d64 long"), "filter-hits")
        before = self._content(self.batch, hits.select("shard")).join(hits.select("d64"), "d64", "left_semi")
        known = materialise(before.join(asked.select("d64", "sha"), ["d64", "sha"], "left_semi"), "verified")
        order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
        left = self._live(k).groupBy("d64", "sha").agg(F.min(order).alias("k"), F.count("*").alias("m"))  # combined before the join, as a digest may be hot
        after = known.select("d64", "sha", "shard").join(left, ["d64", "sha"], "left")
        touched = materialise(after.select("d64", "sha", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), F.coalesce("m", F.lit(0)).alias("n"), "shard"), "touched")
        still = before.select("d64", "sha").join(touched.where("n = 0").select("d64", "sha"), ["d64", "sha"], "left_anti").select("d64").distinct()
        gone = touched.where("n = 0").select("shard", "d64").distinct().join(still, "d64", "left_anti")
        self._commit(touched, gone.select("shard", "d64", F.lit(False).alias("live")))


def normalised(text: str | Column) -> Column:
    """The text with each run of space and \\x09-\\x0D as one space; null counts as empty."""
    return F.regexp_replace(same_text(text), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, row, d64, sha) of every row; ``row`` tells repeated rows apart: the column of that name, or numbers of this scan."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), normalised("text").alias("t"))
    return clean.select("doc_id", "row", F.xxhash64("t").alias("d64"), F.sha2("t", 256).alias("sha"))


def indexed(docs: DataFrame, row: str | None = None, batches: int = BATCHES) -> tuple[DigestIndex, DataFrame]:
    """A new index of ``docs`` and their ``digests``, written once and inserted in ``batches`` by a hash of doc_id.

    From the second batch on, digests probe the filters: only hits are looked up
    in the stored content.
    """
    index = DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    rows = materialise(digests(docs, row), "digests")
    for k in range(batches):
        index.insert(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index, rows


def decisions(index: DigestIndex) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every member of the index."""
    groups = index.entries().select(F.col("sha").alias("s"), "keep_id", "keep_row", "n")
    joined = index.members().join(groups, F.col("sha") == F.col("s"))
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs`` (doc_id, text).

    Texts are equal when identical after ``normalised``.  Of equal texts the row
    with the smallest doc_id stays: nulls come last, and of repeated rows with
    one doc_id just one is kept.  Null texts count as empty, very long ones are
    digested whole.  An empty table gives an empty result; other columns are
    ignored.
    """
    return decisions(indexed(docs)[0])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by a number that is written with them once: two scans of
    ``docs`` may split it differently, as after the loss of an executor.
    """
    (row,) = fresh(docs.columns, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    kept = indexed(numbered, row)[0].entries().select(F.col("keep_row").alias(row))
    return numbered.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
