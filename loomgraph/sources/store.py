"""Stored tables: several tables of one store change together, a version at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.storage import cut


class Conflict(RuntimeError):
    """Another commit changed the same buckets after the version that this one was made from."""


@dataclass(frozen=True)
class Table:
    """A table's columns, its key, and how many files hold it.

    Rows go to buckets by a hash of the key, or of those of its columns in
    ``spread``, or by column ``by`` (a whole number below ``buckets``), which
    readers can then prune by.
    """

    schema: str
    key: tuple[str, ...]
    buckets: int = 16
    by: str | None = None
    spread: tuple[str, ...] = ()

    def bucket(self) -> Column:
        return F.col(self.by).cast("int") if self.by else F.pmod(F.xxhash64(*(self.spread or self.key)), F.lit(self.buckets)).cast("int")

    def struct(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)


@dataclass
class Change:
    """Rows to put over a table by key, keys to take out, and what to ``clear``: values of the ``spread`` columns whose rows all go.

    Of several rows of one key the one with the greatest ``order`` (a column of
    ``upserts`` that need not be one of the table's) holds; without it the
    greatest row, so reruns agree.  Rows of ``upserts`` win over the others.
    ``keep`` columns of known keys stay as they were; with ``only`` "known" rows
    whose key is new are left out, with "new" those whose key is known.
    """

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    clear: DataFrame | None = None
    order: str | None = None
    keep: tuple[str, ...] = ()
    only: str | None = None


class Store:
    """Tables under one path, whose versions list the folders that hold them.

    ``_tables.json`` has the tables; ``_versions/<n>.json`` has, for version n, the
    batch that made it and the folder of every bucket.  A commit reads the
    buckets that its keys fall in, writes them anew aside, and publishes the next
    version by creating its file, which fails where there is one.  So readers see
    whole versions, all tables change at once, a lost driver leaves only folders that no
    version names, and of two commits from one version the second sees the first:
    if both changed a bucket it raises ``Conflict`` or, without a ``base``, is made
    again from the newer version.  A batch id is applied once.

    A bucket should fit a few tasks: its rows are read and written by Spark, not
    held, and large ones are split among tasks.  The driver holds a version's list
    of buckets and the names of all batches.  The file system must
    create files exclusively, as HDFS and local ones do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._read("_tables.json")
        if found is None:
            raise FileNotFoundError(f"no store in {path}")
        self.tables = {n: Table(t["schema"], tuple(t["key"]), t["buckets"], t["by"], tuple(t["spread"])) for n, t in json.loads(found).items()}

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, Table]) -> Store:
        """The store of these tables, made where there is none; ValueError where there is another one."""
        self = object.__new__(cls)
        self.spark, self.path = spark, path.rstrip("/")
        for name, t in tables.items():
            columns = set(t.struct().names)
            if not t.key or not set(t.key) <= columns or not set(t.spread) <= set(t.key) or (t.by and (t.spread or t.by not in columns)):
                raise ValueError(f"{name}: the key and the bucket must be columns")
        spec = {n: {"schema": t.schema, "key": list(t.key), "buckets": t.buckets, "by": t.by, "spread": list(t.spread)} for n, t in tables.items()}
        self._create("_tables.json", json.dumps(spec))
        self = cls(spark, path)
        if self.tables != tables:
            raise ValueError(f"another store is in {path}")
        return self

    # Files ------------------------------------------------------------------

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        place, fs = self._place(name)
        if not fs.exists(place):
            return None
        with_ = fs.open(place)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_)).decode()
        finally:
            with_.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a whole file that is not there; False where it is."""
        aside, fs = self._place(f"_aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        place, _ = self._place(name)
        fs.mkdirs(place.getParent())
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs
        try:  # a rename without the option to overwrite fails where the target is
            files.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(aside, place, sc._gateway.new_array(files.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # Versions ---------------------------------------------------------------

    def versions(self) -> list[int]:
        place, fs = self._place("_versions")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(place) if s.getPath().getName().endswith(".json")) if fs.exists(place) else []

    def manifest(self, version: int | None = None) -> dict:
        """The list of a version, the newest without one; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "batch": None, "batches": {}, "tables": {n: {} for n in self.tables}, "rows": {n: {} for n in self.tables}, "changed": {}, "stats": {}}
        text = self._read(f"_versions/{version}.json")
        if text is None:
            raise ValueError(f"no version {version}")
        return json.loads(text)

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a version; ``buckets`` reads these alone."""
        folders = self.manifest(version)["tables"][table]
        if version is not None and not all(fs.exists(place) for place, fs in map(self._place, {p.rpartition("/")[0] for p in folders.values()})):
            raise ValueError(f"version {version} was vacuumed")
        return self._rows(table, folders, buckets)

    def _rows(self, table: str, folders: dict[str, str], buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/{p}" for b, p in sorted(folders.items()) if wanted is None or b in wanted]
        schema = self.tables[table].struct()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """(version, batch, table, buckets_changed, n_upserts, n_deletes) of every commit."""
        rows = []
        for v in self.versions():
            m = self.manifest(v)
            rows += [(v, m["batch"], n, len(b), m["stats"][n]["upserts"], m["stats"][n]["deletes"]) for n, b in m["changed"].items()]
        return self.spark.createDataFrame(rows, "version int, batch string, table string, buckets_changed int, n_upserts long, n_deletes long")

    def committed(self, batch: str) -> int | None:
        """The version that a batch made."""
        return self.manifest()["batches"].get(batch)

    # Commits ----------------------------------------------------------------

    def _signed(self, table: str, change: Change) -> DataFrame:
        """(key, row, put) once a key: the row to put, or null to take the key out."""
        t, parts = self.tables[table], []
        kinds = {f.name: f.dataType for f in t.struct().fields}
        keys = [F.col(c).cast(kinds[c]).alias(c) for c in t.key]
        ordered = change.upserts.schema[change.order].dataType if change.order else T.IntegerType()
        if change.upserts is not None:
            row = F.struct(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
            parts.append(change.upserts.select(*keys, F.struct(F.lit(True).alias("put"), (F.col(change.order) if change.order else F.lit(0)).alias("order"), row.alias("row")).alias("last")))
        if change.deletes is not None or not parts:
            gone = self.spark.createDataFrame([], t.struct()) if change.deletes is None else change.deletes
            parts.append(gone.select(*keys, F.struct(F.lit(False).alias("put"), F.lit(None).cast(ordered).alias("order"), F.lit(None).cast(t.struct()).alias("row")).alias("last")))
        signed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return signed.groupBy(*t.key).agg(F.max("last").alias("last"))

    def commit(self, batch: str, changes: dict[str, Change], base: int | None = None, tries: int = 5) -> int:
        """Apply ``changes`` of tables as one version and return its number; a batch that is in gives the one it made.

        With ``base``, the version that the changes were computed from, a commit
        since then to any bucket of theirs raises ``Conflict``.  Null keys are
        errors; tables without a change stay.
        """
        if (done := self.committed(batch)) is not None:
            return done
        work = {n: c for n, c in changes.items() if any(x is not None for x in (c.upserts, c.deletes, c.clear))}
        with ThreadPoolExecutor(max(1, len(work))) as pool:  # tables side by side
            ready = dict(zip(work, pool.map(lambda n: self._ready(n, work[n]), work)))
            for _ in range(tries):
                now = self.manifest()
                new = {"version": now["version"] + 1, "batch": batch, "batches": now["batches"] | {batch: now["version"] + 1}, "tables": dict(now["tables"]), "rows": dict(now["rows"]), "changed": {}, "stats": {}}
                for n, (touched, folders, rows, stats) in zip(work, pool.map(lambda n: self._write(n, *ready[n], work[n], now), work)):
                    new["tables"][n] = {b: p for b, p in now["tables"][n].items() if int(b) not in touched} | folders
                    new["rows"][n] = {b: k for b, k in now["rows"][n].items() if int(b) not in touched} | rows
                    new["changed"][n], new["stats"][n] = sorted(touched), stats
                if base is not None and base < now["version"]:
                    since = [self.manifest(v)["changed"] for v in range(base + 1, now["version"] + 1)]
                    if any(set(new["changed"].get(n, ())) & set(b) for m in since for n, b in m.items()):
                        raise Conflict(f"versions after {base} changed the same buckets")
                if self._create(f"_versions/{new['version']}.json", json.dumps(new)):
                    return new["version"]
                if (done := self.committed(batch)) is not None:
                    return done
        raise Conflict(f"{tries} other commits came first")

    def _ready(self, table: str, change: Change) -> tuple[DataFrame, DataFrame | None, set[int]]:
        """The signed rows, what to clear, and the buckets of both."""
        t = self.tables[table]
        if change.clear is not None and t.by:
            raise ValueError(f"{table}: only tables bucketed by their key can be cleared")
        signed = cut(self._signed(table, change))
        put = signed.select(*t.key, F.col("last.put").alias("put"), (F.col(f"last.row.{t.by}").cast("int") if t.by else t.bucket()).alias("bucket"))
        where = put.groupBy("bucket").agg(F.count_if("put").alias("put"), *(F.count_if(F.col(k).isNull()).alias(f"no_{k}") for k in t.key)).collect()  # as many as buckets
        if any(r[f"no_{k}"] for r in where for k in t.key):
            raise ValueError(f"{table}: a null key")
        if t.by and any(r["put"] and (r["bucket"] is None or not 0 <= r["bucket"] < t.buckets) for r in where):
            raise ValueError(f"{table}: {t.by} must be 0 to {t.buckets - 1}")
        touched = {r["bucket"] for r in where if not t.by or r["put"]}
        clear = None
        if change.clear is not None:
            clear = cut(change.clear.select(*(t.spread or t.key)).distinct())
            touched |= {r[0] for r in clear.select(t.bucket()).distinct().collect()}
        return signed, clear, touched

    def _write(self, table: str, signed: DataFrame, clear: DataFrame | None, touched: set[int], change: Change, now: dict) -> tuple[set[int], dict[str, str], dict[str, int], dict]:
        """Write the buckets of the changed keys anew: (their numbers, the folders and the rows of those with rows, counts)."""
        t, folders = self.tables[table], now["tables"][table]
        columns = t.struct().names
        if t.by:  # a key's old row may lie in any bucket
            keys = self._rows(table, folders).select(*t.key, F.col(t.by).cast("int").alias("old")).join(signed.select(*t.key), list(t.key), "left_semi")
            touched = touched | {r[0] for r in keys.select("old").distinct().collect()}
        rows = self._rows(table, folders, touched)
        cleared = F.lit(False).alias("cleared")
        if clear is not None:
            rows, cleared = rows.join(clear.withColumn("cleared", F.lit(True)), clear.columns, "left"), F.coalesce("cleared", F.lit(False)).alias("cleared")
        old = rows.select(cleared, *(F.col(k).alias(f"{k}_") for k in t.key), F.struct(*columns).alias("was"))
        same = [F.col(k) == F.col(f"{k}_") for k in t.key]
        joined = old.join(signed, same, "full_outer").withColumn("is_new", F.col("was").isNull())
        put, known = F.coalesce(F.col("last.put"), F.lit(False)), ~F.col("is_new")
        if change.only == "known":
            put = put & known
        if change.only == "new":
            put = put & ~known
        gone = F.coalesce(F.col("cleared") | ~F.col("last.put"), F.col("cleared"), F.lit(False))
        value = lambda c: F.when(put & (F.lit(c not in change.keep) | ~known), F.col(f"last.row.{c}")).otherwise(F.col(f"was.{c}")).alias(c)
        stays = put | (known & ~gone)
        mark = F.when(put & known, 1).when(put, 2).otherwise(0).cast("byte").alias("put_")
        rows = joined.where(stays).select(*(value(c) for c in columns), mark).withColumn("bucket_", t.bucket())
        place = f"data/{table}-{uuid.uuid4().hex}"
        rows.hint("rebalance", F.col("bucket_")).sortWithinPartitions("bucket_", *t.key).write.partitionBy("bucket_").parquet(f"{self.path}/{place}")
        root, fs = self._place(place)
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        written = self.spark.read.schema("put_ byte, bucket_ int").parquet(f"{self.path}/{place}").groupBy("bucket_").agg(F.count("*").alias("n"), F.count_if(F.col("put_") == 1).alias("u"), F.count_if(F.col("put_") == 2).alias("i")).collect()
        n, u, i = (sum(r[k] for r in written) for k in "nui")
        stats = {"upserts": u + i, "deletes": sum(k for b, k in now["rows"][table].items() if int(b) in touched) + i - n}
        return touched, {x.removeprefix("bucket_="): f"{place}/{x}" for x in names if x.startswith("bucket_=")}, {str(r["bucket_"]): r["n"] for r in written}, stats

    def changed(self, table: str, version: int) -> DataFrame:
        """The rows that a version put, with ``is_new``; keys taken out are in ``removed``."""
        t, m = self.tables[table], self.manifest(version)
        schema = t.struct().add("put_", T.ByteType())
        paths = [f"{self.path}/{m['tables'][table][str(b)]}" for b in m["changed"].get(table, ()) if str(b) in m["tables"][table]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where("put_ > 0").withColumn("is_new", F.col("put_") == 2).drop("put_")

    def removed(self, table: str, version: int) -> DataFrame:
        """The keys that a version took out."""
        t, m = self.tables[table], self.manifest(version)
        buckets, key = m["changed"].get(table, ()), list(t.key)
        return self.read(table, version - 1, buckets).select(*key).join(self.read(table, version, buckets).select(*key), key, "left_anti")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that only versions before the newest ``keep`` name; their number.

        Those versions can't be read any more, but their batches stay applied.
        Run it while nothing is committed or read at them.
        """
        live = {p.split("/")[1] for v in self.versions()[-keep:] for t in self.manifest(v)["tables"].values() for p in t.values()}
        root, fs = self._place("data")
        dead = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in live] if fs.exists(root) else []
        for p in dead:
            fs.delete(p, True)
        return len(dead)
