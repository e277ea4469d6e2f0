"""Action parsing results, audits, listings, error codes, write accounting and other runtime tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: HTTP status by the thousands of an error number, and the numbers that differ.
STATUS = {1: 400, 2: 500, 3: 400, 4: 503, 5: 403, 6: 500, 7: 504, 8: 401, 9: 429}
STATUS_OF = {2001: 504, 2002: 404, 3003: 500, 4004: 500}


def http_status(number: Column) -> Column:
    """The status of an error number; 500 for unknown ones."""
    by_class = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    own = F.create_map(*(F.lit(x) for pair in STATUS_OF.items() for x in pair))
    return F.coalesce(own[number], by_class[F.floor(number / 1000).cast("int")], F.lit(500))


def write_statistics(outcomes: DataFrame) -> DataFrame:
    """One row of ``outcomes`` (success, rolled_back, ms): totals, success in percent, rollbacks, mean time."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("succeeded"),
        F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)) * 100, 2).alias("success_rate"),
        F.count_if("rolled_back").alias("rollbacks"),
        F.round(F.avg("ms"), 2).alias("avg_ms"),
    )


def audit(events: DataFrame, start: str, end: str, kinds: list[str], size: int, page: int = 0) -> DataFrame:
    """A page of the events of some kinds within [start, end), latest first."""
    found = events.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")) & F.col("event_type").isin(kinds))
    return found.orderBy(F.desc("ts"), F.desc("event_id")).offset(page * size).limit(size)


def listing(skills: DataFrame, namespace: str | None = None, deprecated: bool | None = None, size: int = 50, page: int = 0, tag: str | None = None, sort: str = "uid", descending: bool = False) -> DataFrame:
    """A page of skills by namespace, state and tag, in order of a column and then uid."""
    out = skills
    if namespace is not None:
        out = out.where(F.col("uid").startswith(f"{namespace}:"))
    if deprecated is not None:
        out = out.where(F.col("is_deprecated") == deprecated)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    return out.orderBy(F.desc(sort) if descending else F.asc(sort), "uid").offset(page * size).limit(size)


def cache_key(kind: str, *parts: Column) -> Column:
    """``kind:part:part...``; a missing part is empty."""
    return F.array_join(F.array(F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), ":")


def hit_rate(lookups: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, hit_rate): the share of lookups that hit, in percent."""
    return lookups.groupBy(group).agg(F.round(F.count_if(hit) * 100.0 / F.count("*"), 2).alias("hit_rate"))


def counters(increments: DataFrame, key: Column, by: Column) -> DataFrame:
    """(key, total): increments summed."""
    return increments.groupBy(key.alias("key")).agg(F.sum(by).alias("total"))


def to_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): each row as a JSON record, nulls kept."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_records(records: DataFrame, schema: str) -> DataFrame:
    """The rows of ``to_records`` again; a value that isn't JSON gives nulls."""
    return records.select(F.from_json("value", schema).alias("r")).select("r.*")


def summaries(results: DataFrame) -> DataFrame:
    """Add ``summary`` of ``result`` (JSON): success, ``error: type`` or unknown."""
    status = F.get_json_object("result", "$.status")
    return results.withColumn("summary", F.when(status == "success", "success").when(status == "error", F.concat(F.lit("error: "), F.coalesce(F.get_json_object("result", "$.type"), F.lit("unknown")))).otherwise("unknown"))


def parse_topology(responses: DataFrame) -> DataFrame:
    """(source, target, edge_type, confidence) from ``responses`` (response): a JSON topology map by skill.

    Malformed JSON, unknown types and confidences under 0.85 give no row.
    """
    kind = "struct<topology_map:map<string,struct<relations:array<struct<target_uid:string,edge_type:string,confidence:double>>>>>"
    m = responses.select(F.explode(F.from_json("response", kind)["topology_map"]).alias("source", "x"))
    r = m.select("source", F.explode("x.relations").alias("r")).select("source", F.col("r.target_uid").alias("target"), F.upper("r.edge_type").alias("edge_type"), F.col("r.confidence").alias("confidence"))
    return r.where("edge_type in ('REQUIRES', 'CONFLICTS_WITH', 'ENHANCES', 'SUBSTITUTES') and confidence >= 0.85")


def prompt(skills: DataFrame) -> DataFrame:
    """(category, prompt): a request to infer relations among the skills of a category, as JSON."""
    item = F.struct("uid", "description")
    g = skills.groupBy("category").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return g.select("category", F.format_string("Name the relations among these skills as JSON:\n%s", F.to_json("s")).alias("prompt"))


def deadlocks(events: DataFrame, retries: int = 5) -> DataFrame:
    """(session_id, a, b): pairs of skills that both failed at least ``retries`` times in one session."""
    bad = events.where("not ok").groupBy("session_id", "skill_id").agg(F.count("*").alias("n")).where(F.col("n") >= retries)
    x, y = bad.alias("x"), bad.alias("y")
    return x.join(y, (F.col("x.session_id") == F.col("y.session_id")) & (F.col("x.skill_id") < F.col("y.skill_id"))).select(F.col("x.session_id").alias("session_id"), F.col("x.skill_id").alias("a"), F.col("y.skill_id").alias("b"))


def upgrade(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edges with both ends moved to the new ids of ``renamed`` (old, new)."""
    a, b = renamed.toDF("source", "new_source"), renamed.toDF("target", "new_target")
    out = edges.join(a, "source", "left").join(b, "target", "left")
    return out.select(F.coalesce("new_source", "source").alias("source"), F.coalesce("new_target", "target").alias("target"), "edge_type", "weight")


def events_of(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, kind): the file events of a sync, created for every file of a first scan (``changes`` empty)."""
    return changes.where("change <> 'unchanged'").select("path", F.col("change").alias("kind")).unionByName(files.select("path", F.lit("created").alias("kind")).join(changes.select("path").distinct(), "path", "left_anti"))


def hashed_embedding(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(id, vector): signed hashed word counts of ``texts`` (id, text), unit length; zero for texts without words.

    A deterministic stand-in for a model, made of column expressions: words are
    counted per cell before the vector is built.
    """
    words = texts.select("id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\W+")).alias("w")).where("w <> ''")
    h = F.crc32(F.col("w").cast("binary"))
    cells = words.select("id", (h % dim).cast("int").alias("cell"), F.when(F.floor(h / dim) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")).groupBy("id", "cell").agg(F.sum("sign").alias("x"))
    whole = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k) / F.col("norm"), F.lit(0.0)))
    out = texts.select("id").join(whole, "id", "left")
    return out.select("id", F.when(F.coalesce("norm", F.lit(0.0)) > 0, value).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vector"))


def latest_first(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n latest rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def dag_text(report: DataFrame) -> DataFrame:
    """A validation report as lines of text."""
    return report.select(F.concat_ws("\n", F.when(F.col("is_valid"), "valid").otherwise("invalid"), F.concat(F.lit("nodes: "), "n_nodes"), F.concat(F.lit("edges: "), "n_edges"), F.concat(F.lit("cycles: "), "n_cycles"), F.concat(F.lit("isolated: "), "n_isolated")).alias("report"))
