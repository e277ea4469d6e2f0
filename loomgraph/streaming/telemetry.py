"""Telemetry streams: sampling, redaction, codes, sinks, stateful reliability, watched folders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.operators.reliability import ALPHA, DEPRECATE, FLOOR, RECOVER
from loomgraph.storage import cut

#: Event types and their codes.
CODES = {
    "SKILL_CALLED": "E001", "SKILL_SUCCESS": "E002", "SKILL_FAILED": "E003", "ROUTING_STARTED": "E004", "ROUTING_COMPLETED": "E005",
    "ROUTING_FALLBACK": "E006", "PERMISSION_CHECK": "E007", "PERMISSION_DENIED": "E008", "CONTEXT_OVERFLOW": "E009", "CONFLICT_DETECTED": "E010",
}
#: Sampling rates other than 1, and names of fields that are filtered.
RATES = {"SKILL_SUCCESS": 0.1}
SENSITIVE = ["password", "token", "secret", "api_key", "credential"]


def event_code(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))[kind]


def sampled(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Keep events by a hash of their key under their type's rate, so a replay keeps the same ones."""
    rate = F.lit(1.0)
    for name, r in RATES.items():
        rate = F.when(F.col(kind) == name, F.lit(r)).otherwise(rate)
    return df.where(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10_000)) < rate * 10_000)


def is_sensitive(key: Column) -> Column:
    """Equal to a sensitive name, or ending in ``_`` and one."""
    return F.lower(key).rlike("(^|_)(" + "|".join(SENSITIVE) + ")$")


def redact(fields: str | Column) -> Column:
    """A map<string,string> with the values of sensitive keys filtered."""
    return F.transform_values(fields, lambda k, v: F.when(is_sensitive(k), F.lit("[FILTERED]")).otherwise(v))


def redact_json(value, keys: tuple[str, ...] = tuple(SENSITIVE)):
    """The same for nested mappings."""
    if not isinstance(value, dict):
        return value
    hit = lambda k: any(k.lower() == s or k.lower().endswith(f"_{s}") for s in keys)
    return {k: "[FILTERED]" if hit(k) else redact_json(v, keys) for k, v in value.items()}


def _redacted(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> str | None:
        try:
            return json.dumps(redact_json(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return text

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def redacted(fields: str | Column) -> Column:
    """JSON of any shape and depth with the values of sensitive keys filtered in all nested mappings; what isn't JSON stays.

    Lists are left as they are.  ``parse_json`` makes the result a VARIANT.
    """
    return F.arrow_udf(_redacted, "string")(fields)


def _reliability(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rate, deprecated, n = state.get if state.exists else (1.0, False, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ok in rows["ok"]:
        rate = max(FLOOR, min(1.0, ALPHA * rate + (1 - ALPHA) * (1.0 if ok else 0.0)))
        deprecated = True if rate < DEPRECATE else False if deprecated and ok and rate >= RECOVER else deprecated
        n += 1
    state.update((rate, deprecated, n))
    yield pd.DataFrame({"skill_id": [key[0]], "n_events": [n], "reliability": [round(rate, 6)], "is_deprecated": [deprecated]})


def stream_reliability(events: DataFrame) -> DataFrame:
    """The reliability of each skill after every micro-batch of events (skill_id, ts, event_id, ok).

    Events are ordered within a micro-batch; the state of a skill is one small
    tuple.  Late events of an earlier micro-batch are applied as they come.
    """
    schema = "skill_id long, n_events long, reliability double, is_deprecated boolean"
    return events.groupBy("skill_id").applyInPandasWithState(_reliability, schema, "rate double, deprecated boolean, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and failures per tumbling window, late ones dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures")).select(F.col("window.start").alias("start"), "n", "failures")


EVENT = "event_id long, trace_id string, event_type string, ts timestamp, fields map<string,string>"


def prepared(events: DataFrame) -> DataFrame:
    """(key, value) of sampled events (see EVENT), sensitive fields filtered, as JSON records with their code; batch or stream."""
    kept = sampled(events, "event_id", "event_type").withColumn("fields", redact("fields")).withColumn("code", event_code(F.col("event_type")))
    return kept.select(F.col("trace_id").alias("key"), F.to_json(F.struct("event_id", "trace_id", "event_type", "code", "ts", "fields")).alias("value"))


def flush(records: DataFrame, path: str, checkpoint: str, sink: str = "parquet", once: bool = False, seconds: int = 10, **options: str):
    """Write a stream of (key, value) to a sink (parquet, json, or kafka with its options); the query that runs.

    A micro-batch is the buffer: every ``seconds``, or all there is when
    ``once``.  The checkpoint makes a restart go on where the last batch ended, so
    a record reaches file sinks exactly once and Kafka at least once.
    """
    writer = records.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.option(k.replace("_", "."), v)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start() if sink == "kafka" else writer.start(path)


def dispatch(messages: DataFrame, handlers: dict, checkpoint: str, once: bool = False):
    """Give each micro-batch's messages (event_type, ...) to the handler of their type (a function of a DataFrame); others go to ``None``'s, if any.

    A batch in which a handler fails runs again, for all handlers: those must be
    able to take a batch twice, as the commits of a ``Store`` are.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            for kind, handle in handlers.items():
                handle(df.where(F.col("event_type") == kind) if kind is not None else df.where(~F.col("event_type").isin([k for k in handlers if k is not None]) | F.col("event_type").isNull()))
        finally:
            df.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def compare_folder(spark: SparkSession, path: str, known: str, handle, name: str = "*.md") -> None:
    """Give ``handle`` what changed in a folder since the snapshot stored under ``known``, and store the present one after it.

    ``handle`` gets (path, kind, old_path) with kind created, modified, deleted or
    moved; if it fails the snapshot stays, and the changes come again.  The folder
    is listed; only files whose time or length changed are opened and hashed.
    """
    from loomgraph.operators.mutations import SNAPSHOT, load_snapshot, moved_files, save_snapshot

    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(path)
    now = files.select("path", F.col("modificationTime").alias("modified"), "length")
    old = load_snapshot(spark, known, SNAPSHOT)
    same = ["path", "modified", "length"]
    changed = cut(now.join(old, same, "left_anti"))
    since = changed.agg(F.min("modified")).first()[0]
    kept = now.join(old, same).select("path", "hash", "modified", "length")
    if since is not None:
        opened = files.where(F.col("modificationTime") >= F.lit(since)).join(changed.select("path"), "path", "left_semi")
        kept = kept.unionByName(opened.select("path", F.md5("content").alias("hash"), F.col("modificationTime").alias("modified"), "length"))
    kept = cut(kept)
    handle(moved_files(old.select("path", "hash"), kept.select("path", "hash")))
    save_snapshot(kept, known)


def stream_files(spark: SparkSession, path: str, known: str, checkpoint: str, handle, name: str = "*.md", seconds: int = 10):
    """``compare_folder`` every so many seconds; the query that runs.

    A file source tells of new files alone, not of rewritten, moved or deleted
    ones, so the batches are timed by a rate source.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(df: DataFrame, number: int) -> None:
        compare_folder(df.sparkSession, path, known, handle, name)

    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
