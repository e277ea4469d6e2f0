"""Upserts, deletions, snapshots and key-value tables, as joins of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.storage import cut


def last_rows(changes: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """One row of each key: that with the greatest ``order`` column, of equal ones (or without it) the greatest row."""
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*([F.col(order).alias("order_")] if order else []), *(F.col(c) for c in changes.columns))
    return changes.groupBy(*(F.col(k).alias(f"{k}_key") for k in keys)).agg(F.max(row).alias("row_")).select(*(F.col(f"row_.{c}").alias(c) for c in changes.columns))


def upsert(base: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """base with ``changes`` (its columns) put over it by key; ``keep`` columns of known rows stay as they were.

    Of several changes of a key the one with the greatest ``order`` holds (see ``last_rows``).
    """
    c = last_rows(changes, key, order).select(*(F.col(x).alias(f"{x}_new") for x in base.columns)).withColumn("hit_", F.lit(True))
    out = base.join(c, F.col(key) == F.col(f"{key}_new"), "full_outer")
    known = F.col(key).isNotNull()

    def pick(x: str) -> Column:
        if x in keep:
            return F.when(known, F.col(x)).otherwise(F.col(f"{x}_new")).alias(x)
        return F.when(F.col("hit_"), F.col(f"{x}_new")).otherwise(F.col(x)).alias(x)

    return out.select(*map(pick, base.columns))


def delete_nodes(skills: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skills and edges without the nodes in ``gone`` (id)."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.toDF("source"), "source", "left_anti").join(ids.toDF("target"), "target", "left_anti").select(*edges.columns)
    return skills.join(ids, "id", "left_anti"), left


def edge_upsert(edges: DataFrame, changes: DataFrame, skills: DataFrame, order: str | None = None) -> DataFrame:
    """Edges with changes over them by (source, target, edge_type); changes with an unknown end are left out.

    Of several changes of an edge the one with the greatest ``order`` holds (see ``last_rows``).
    """
    key = ["source", "target", "edge_type"]
    ids = skills.select("id")
    ok = last_rows(changes, key, order).join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi").select(*edges.columns)
    return edges.join(ok, key, "left_anti").select(*edges.columns).unionByName(ok)


def normalise_edges(edges: DataFrame) -> DataFrame:
    """Undirected types with their ends in order, once a pair; self-edges go."""
    undirected = F.col("edge_type").isin("CONFLICTS_WITH", "SUBSTITUTES")
    s, t = F.col("source"), F.col("target")
    out = edges.where("source <> target").select(F.when(undirected, F.least(s, t)).otherwise(s).alias("source"), F.when(undirected, F.greatest(s, t)).otherwise(t).alias("target"), "edge_type", "weight")
    return out.groupBy("source", "target", "edge_type").agg(F.max("weight").alias("weight"))


def update(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """base with the rows of ``changes`` put over known keys, and the keys of ``changes`` that aren't known.

    Of several changes of a key the one with the greatest ``order`` holds (see ``last_rows``).
    """
    known = last_rows(changes, key, order).join(base.select(key), key, "left_semi").select(*base.columns)
    out = base.join(known.select(key), key, "left_anti").select(*base.columns).unionByName(known)
    return out, changes.select(key).distinct().join(base.select(key), key, "left_anti")


def edge_delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those in ``gone`` (source, target, edge_type)."""
    return edges.join(gone.select("source", "target", "edge_type").distinct(), ["source", "target", "edge_type"], "left_anti").select(*edges.columns)


def dangling(edges: DataFrame, skills: DataFrame) -> DataFrame:
    """(source, target, edge_type, lost): edges with an unknown end; lost is ``source``, ``target`` or ``both``."""
    ids = skills.select("id")
    e = edges.select("source", "target", "edge_type").join(ids.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    lost = F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").when(F.col("t").isNull(), "target")
    return e.select("source", "target", "edge_type", lost.alias("lost")).where("lost is not null")


def vector_write(vectors: DataFrame, upserts: DataFrame | None = None, gone: DataFrame | None = None, dim: int | None = None, order: str | None = None) -> DataFrame:
    """The vector table (id, vector, ...) after upserts by id and deletions (id); vectors of another length than ``dim`` are left out.

    Of several upserts of an id the one with the greatest ``order`` holds (see ``last_rows``).
    """
    out = vectors
    if upserts is not None:
        good = upserts if dim is None else upserts.where(F.size("vector") == dim)
        out = out.join(good.select("id"), "id", "left_anti").select(*vectors.columns).unionByName(last_rows(good, "id", order).select(*vectors.columns))
    return out if gone is None else out.join(gone.select("id").distinct(), "id", "left_anti").select(*vectors.columns)


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): created, modified, deleted or unchanged, from two (path, hash) snapshots."""
    joined = old.toDF("path", "was").join(new.toDF("path", "is"), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified").otherwise("unchanged")
    return joined.select("path", change.alias("change"))


def apply_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after a sync: what is created or modified comes in, what is deleted goes."""
    c = file_changes(old, new)
    stay = old.join(c.where("change = 'unchanged'"), "path", "left_semi")
    return stay.unionByName(new.join(c.where("change in ('created', 'modified')"), "path", "left_semi"))


def reconcile(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, state) of ids that only one of two stores holds."""
    a = graph.select("id").join(vectors.select("id"), "id", "left_anti").withColumn("state", F.lit("missing_vector"))
    return a.unionByName(vectors.select("id").join(graph.select("id"), "id", "left_anti").withColumn("state", F.lit("extra_vector")))


def live_entries(log: DataFrame, now: Column) -> DataFrame:
    """(key, value, ttl_seconds): the latest write of each key that has not expired (log: key, value, ts, seq, ttl_seconds)."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq"))
    last = log.withColumn("n", F.row_number().over(w)).where("n = 1")
    left = F.col("ttl_seconds") - (F.unix_seconds(now) - F.unix_seconds(F.col("ts").cast("timestamp")))
    return last.select("key", "value", left.alias("ttl_seconds")).where("ttl_seconds > 0")


def kv_state(log: DataFrame, now: Column) -> DataFrame:
    """(key, value, ttl_seconds): what a log (key, op, value, ts, seq, ttl_seconds) of set, expire, delete and flush leaves.

    The latest set of a key holds unless it was deleted or all keys were flushed
    after it; a later expire gives it a new time to live from then on.
    """
    at = F.struct("ts", "seq")
    flush = log.where("op = 'flush'").agg(F.max(at).alias("flushed"))
    last = log.where("op <> 'flush'").groupBy("key").agg(
        F.max(F.when(F.col("op") == "set", F.struct(at.alias("at"), "value", "ttl_seconds"))).alias("s"),
        F.max(F.when(F.col("op") == "delete", at)).alias("d"),
        F.max(F.when(F.col("op") == "expire", F.struct(at.alias("at"), "ttl_seconds"))).alias("e"),
    )
    after = lambda x: F.coalesce(x > F.col("s.at"), F.lit(False))
    live = last.join(F.broadcast(flush)).where(F.col("s").isNotNull() & ~after(F.col("d")) & ~after(F.col("flushed")))
    renewed = after(F.col("e.at"))
    since, ttl = F.when(renewed, F.col("e.at.ts")).otherwise(F.col("s.at.ts")), F.when(renewed, F.col("e.ttl_seconds")).otherwise(F.col("s.ttl_seconds"))
    left = ttl - (F.unix_seconds(now) - F.unix_seconds(since.cast("timestamp")))
    return live.select("key", F.col("s.value").alias("value"), left.alias("ttl_seconds")).where("ttl_seconds is null or ttl_seconds > 0")


def kv_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found, ttl_seconds) of each asked key."""
    return keys.select("key").distinct().join(state.withColumn("found", F.lit(True)), "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"), "ttl_seconds")


def cached(requests: DataFrame, entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``requests`` (with ``key``) that have a live result in ``entries`` (key, value, ts, seq, ttl_seconds), with it, and those to compute."""
    live = live_entries(entries, now).select("key", "value")
    return requests.join(live, "key"), requests.join(live.select("key"), "key", "left_anti")


SNAPSHOT = "path string, hash string, modified timestamp, length long"


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = place(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(place(f"{path.rstrip('/')}/{n}/_SUCCESS")))


def save_snapshot(snapshot: DataFrame, path: str, version: int | None = None) -> None:
    """Store (path, hash[, modified, length]) under ``path`` as a version, the one after the latest without a number; a version is whole or absent."""
    if version is None:
        version = max(_snapshots(snapshot.sparkSession, path), default=-1) + 1
    snapshot.select(*(c for c in ("path", "hash", "modified", "length") if c in snapshot.columns)).write.mode("overwrite").json(f"{path.rstrip('/')}/version={version}")


def load_snapshot(spark: SparkSession, path: str, schema: str = "path string, hash string") -> DataFrame:
    """The latest whole version of a stored snapshot; empty without one."""
    whole = _snapshots(spark, path)
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/version={whole[-1]}") if whole else spark.createDataFrame([], schema)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """(conv_id, history): the last n turns of each session as ``role: text`` lines."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    item = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("h")).select("conv_id", F.array_join(F.transform("h", lambda x: x["line"]), "\n").alias("history"))


def accepted(events: DataFrame, seconds: float, key: str) -> DataFrame:
    """(key, event_id, ts): events at least ``seconds`` after the last accepted one of their key, in order of (ts, event_id).

    An event that long after the one before it is accepted whatever came earlier,
    so the events of a key are cut there; only those of one burst, each
    closer than ``seconds`` to the one before, are folded together.
    """
    wait = int(seconds * 1_000_000)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy(key).orderBy("t", "event_id")
    rows = events.select(key, t.alias("t"), "event_id")
    first = rows.withColumn("first", F.coalesce((F.col("t") - F.lag("t").over(order) >= wait).cast("long"), F.lit(1)))
    bursts = first.withColumn("burst", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "burst").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("e"))
    # Of a burst, the places of accepted events: each the first that is late enough after the one before.
    taken = F.expr(f"""aggregate(sequence(1, size(e) - 1), array(0), (s, i) -> if(e[i].t - e[element_at(s, -1)].t >= {wait}, array_append(s, i), s))""")
    taken = F.when(F.size("e") == 1, F.array(F.lit(0))).otherwise(taken)
    out = bursts.select(key, F.explode(F.transform(taken, lambda i: F.get("e", i))).alias("x"))
    return out.select(key, "x.event_id", F.timestamp_micros("x.t").alias("ts"))


def debounced(events: DataFrame, seconds: float, key: str) -> DataFrame:
    """(key, accepted): the number of ``accepted`` events of each key."""
    return accepted(events, seconds, key).groupBy(key).agg(F.count("*").alias("accepted"))


def moved_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, old_path) of what changed between two (path, hash) snapshots: created, modified, deleted or moved.

    A deleted and a created file of one hash are a move.  Of several, those of
    one name are paired first, then the others, each in order of their paths.
    """
    changed = cut(old.toDF("path", "was").join(new.toDF("path", "is"), "path", "full_outer").where("was is null or is is null or was <> is"))
    gone, came = changed.where("is is null").select(F.col("path").alias("old_path"), F.col("was").alias("hash")), changed.where("was is null").select("path", F.col("is").alias("hash"))
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    pairs = None
    for by in (["hash", "name"], ["hash"]):
        number = lambda df, c: df.withColumn("name", name(c)).withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(c)))  # noqa: E731, B023
        left, right = gone, came
        if pairs is not None:
            left, right = gone.join(pairs, "old_path", "left_anti"), came.join(pairs, "path", "left_anti")
        met = number(left, "old_path").join(number(right, "path").drop(*({"name"} - set(by))), [*by, "k"]).select("path", "old_path")
        pairs = cut(met if pairs is None else pairs.unionByName(met))
    none = F.lit(None).cast("string").alias("old_path")
    return (
        pairs.select("path", F.lit("moved").alias("kind"), "old_path")
        .unionByName(came.join(pairs, "path", "left_anti").select("path", F.lit("created").alias("kind"), none))
        .unionByName(gone.join(pairs, "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit("deleted").alias("kind"), none))
        .unionByName(changed.where("was is not null and is is not null").select("path", F.lit("modified").alias("kind"), none))
    )
