"""Reliability from execution events: ordered folds, batch updates, runs of failures, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, FLOOR, DEPRECATE, RECOVER = 0.95, 0.1, 0.3, 0.8


def ewma(rate: Column, ok: Column, alpha: float = ALPHA, floor: float = FLOOR) -> Column:
    """alpha * rate + (1 - alpha) * outcome, kept in [floor, 1]."""
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), F.lit(alpha) * rate + F.lit(1 - alpha) * F.when(ok, 1.0).otherwise(0.0)))


#: Events of a key are folded in parts of this many seconds, one array each.
PART_SECONDS = 86_400

#: A clamped step x -> min(hi, max(lo, a * x + b)) after another one is again such a step.
COMPOSE = """
aggregate({steps}, named_struct('a', 1D, 'b', 0D, 'lo', -1e300D, 'hi', 1e300D), (s, x) -> named_struct(
  'a', x.a * s.a, 'b', x.a * s.b + x.b,
  'lo', least(x.hi, greatest(x.lo, x.a * s.lo + x.b)), 'hi', least(x.hi, greatest(x.lo, x.a * s.hi + x.b))))
"""


def _apply(f: Column, x: Column) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], f["a"] * x + f["b"]))


def _parts(events: DataFrame, key: str, step: Column) -> DataFrame:
    """(key, part, n, e, f): the events of each part of a key's time in order, and their steps as one."""
    part = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / PART_SECONDS)
    item = F.struct("ts", "event_id", "ok", step.alias("x"))
    g = events.withColumn("part", part).groupBy(key, "part").agg(F.array_sort(F.collect_list(item)).alias("e"), F.count("*").alias("n"))
    return g.withColumn("f", F.expr(COMPOSE.format(steps="transform(e, v -> v.x)")))


def _starts(parts: DataFrame, key: str, initial: Column) -> DataFrame:
    """Add ``start``, the value with which each part begins: the steps of the parts before it, applied in order."""
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list("f").over(before)  # one small struct a part
    return parts.withColumn("earlier", earlier).withColumn("start", _apply(F.expr(COMPOSE.format(steps="earlier")), initial)).drop("earlier")


def fold(events: DataFrame, initial: float = 1.0, alpha: float = ALPHA, floor: float = FLOOR) -> DataFrame:
    """(skill_id, n_events, reliability, is_deprecated) after all events of each skill in order of (ts, event_id).

    Deprecated once the rate falls under 0.3, recovered by a success at 0.8 or
    more.  A skill's events are folded by parts of its time: steps compose, so
    each part's first rate is known from the parts before it, and each part then
    tells what it makes of either state.  No task holds all events of a hot skill.
    """
    step = F.struct(F.lit(alpha).alias("a"), F.when(F.col("ok"), F.lit(1 - alpha)).otherwise(F.lit(0.0)).alias("b"), F.lit(floor).alias("lo"), F.lit(1.0).alias("hi"))
    parts = _starts(_parts(events, "skill_id", step), "skill_id", F.lit(initial))

    def advance(s: Column, e: Column) -> Column:
        r = ewma(s["r"], e["ok"], alpha, floor)
        turn = lambda d: F.when(r < DEPRECATE, True).when(d & e["ok"] & (r >= RECOVER), False).otherwise(d)
        return F.struct(r.alias("r"), turn(s["on"]).alias("on"), turn(s["off"]).alias("off"))

    begin = F.struct(F.col("start").alias("r"), F.lit(True).alias("on"), F.lit(False).alias("off"))
    done = parts.withColumn("s", F.aggregate("e", begin, advance)).select("skill_id", "n", F.struct("part", "s").alias("p"))
    g = done.groupBy("skill_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("n").alias("n_events"))
    flag = F.aggregate("p", F.lit(False), lambda d, p: F.when(d, p["s"]["on"]).otherwise(p["s"]["off"]))
    return g.select("skill_id", "n_events", F.round(F.element_at("p", -1)["s"]["r"], 6).alias("reliability"), flag.alias("is_deprecated"))


#: Fixed value: the reason of a deprecation by reliability.
REASON = "low_reliability"


def deprecation_writes(skills: DataFrame, folded: DataFrame) -> DataFrame:
    """(skill_id, is_deprecated, deprecation_reason, deprecation_reliability): the skills whose state changes after ``fold``.

    ``skills`` (id, is_deprecated); a skill that recovers loses its reason.
    """
    now = folded.select(F.col("skill_id"), F.col("is_deprecated").alias("now"), "reliability")
    changed = skills.select(F.col("id").alias("skill_id"), "is_deprecated").join(now, "skill_id").where(F.col("now") != F.coalesce("is_deprecated", F.lit(False)))
    why = lambda x: F.when(F.col("now"), x)
    return changed.select("skill_id", F.col("now").alias("is_deprecated"), why(F.lit(REASON)).alias("deprecation_reason"), why(F.col("reliability")).alias("deprecation_reliability"))


def batch_update(current: DataFrame, results: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One step for every (skill_id, reliability); a skill without a result counts as success."""
    out = current.join(results.select("skill_id", "ok"), "skill_id", "left")
    return out.select("skill_id", F.round(ewma(F.col("reliability"), F.coalesce("ok", F.lit(True)), alpha), 6).alias("reliability"))


def failing(events: DataFrame, least: int = 2) -> DataFrame:
    """(skill_id, failures): skills whose latest events are at least that many failures in a row."""
    w = Window.partitionBy("skill_id").orderBy(F.desc("ts"), F.desc("event_id"))
    tail = events.withColumn("good", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("good = 0")
    return tail.groupBy("skill_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def cooccurrence(events: DataFrame, seconds: int = 3600, least: int = 2) -> DataFrame:
    """(a, b, n, success, avg_gap): skills a then b in one session within a time, at least ``least`` times.

    Sessions are cut into slots of that time: an event meets those of its own slot
    and of the next, so a busy session isn't one group.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select("session_id", "skill_id", at.alias("t"), "ok").withColumn("slot", F.floor(F.col("t") / (seconds * 1_000_000)))
    x = e.withColumn("meets", F.explode(F.array(F.col("slot"), F.col("slot") + 1))).alias("x")
    y = e.alias("y")
    gap = (F.col("y.t") - F.col("x.t")) / 1e6
    pairs = x.join(y, (F.col("x.session_id") == F.col("y.session_id")) & (F.col("x.meets") == F.col("y.slot")) & (F.col("x.skill_id") != F.col("y.skill_id")) & (F.col("y.t") > F.col("x.t")) & (gap <= seconds))
    out = pairs.groupBy(F.col("x.skill_id").alias("a"), F.col("y.skill_id").alias("b")).agg(F.count("*").alias("n"), F.avg((F.col("x.ok") & F.col("y.ok")).cast("double")).alias("success"), F.avg(gap).alias("avg_gap"))
    return out.where(F.col("n") >= least).withColumns({"success": F.round("success", 6), "avg_gap": F.round("avg_gap", 3)})


def implicit_edges(pairs: DataFrame, confidence: float = 0.0) -> DataFrame:
    """(source, target, edge_type, confidence) from co-occurrences: min(n / 100, 1) * success decides."""
    out = pairs.withColumn("confidence", F.round(F.least(F.col("n") / 100, F.lit(1.0)) * F.col("success"), 6)).where(F.col("confidence") >= confidence)
    return out.select(F.col("a").alias("source"), F.col("b").alias("target"), F.when((F.col("avg_gap") < 5) & (F.col("success") > 0.8), "REQUIRES").otherwise("ENHANCES").alias("edge_type"), "confidence")


def reinforce(edges: DataFrame, events: DataFrame, step: float = 0.05) -> DataFrame:
    """(source, target, weight): each outcome of the target, in order, moves an edge's weight by +-step within [0.1, 1].

    The moves of a target compose to one clamped step, by parts of its time, so
    an edge gets one small struct.
    """
    move = F.struct(F.lit(1.0).alias("a"), F.when(F.col("ok"), F.lit(step)).otherwise(F.lit(-step)).alias("b"), F.lit(0.1).alias("lo"), F.lit(1.0).alias("hi"))
    parts = _parts(events, "skill_id", move).groupBy(F.col("skill_id").alias("target")).agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("p"))
    whole = parts.select("target", F.expr(COMPOSE.format(steps="transform(p, v -> v.f)")).alias("f"))
    moved = edges.join(whole, "target", "left")
    return moved.select("source", "target", F.round(F.when(F.col("f").isNull(), F.col("weight")).otherwise(_apply(F.col("f"), F.col("weight"))), 6).alias("weight"))


def promote(edges: DataFrame, at: float = 0.85) -> DataFrame:
    """ENHANCES edges at a weight become REQUIRES, unless the pair already has one."""
    req = edges.where("edge_type = 'REQUIRES'").select("source", "target").distinct()
    ready = edges.where((F.col("edge_type") == "ENHANCES") & (F.col("weight") >= at))
    return ready.join(req, ["source", "target"], "left_anti").select("source", "target", F.lit("REQUIRES").alias("edge_type"), "weight")


def latencies(events: DataFrame, key: str | None = None, accuracy: int | None = None) -> DataFrame:
    """p50, p90, p99 and maximum of durations, error rate, count and events a second.

    Exact percentiles keep the distinct durations of a group in one task;
    ``accuracy`` gives approximate ones of rank error 1 / accuracy in a sketch of
    that size instead.
    """
    g = events.groupBy(key) if key else events.groupBy()
    p = (lambda q: F.round(F.percentile("duration_ms", F.lit(q)), 6)) if accuracy is None else (lambda q: F.round(F.percentile_approx("duration_ms", q, accuracy), 6))
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    rate = F.round(F.count("*") / F.greatest(span / 1e6, F.lit(1.0)), 6)
    return g.agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.round(F.max("duration_ms"), 6).alias("max_ms"), F.round(F.avg((~F.col("ok")).cast("double")), 6).alias("error_rate"), F.count("*").alias("n"), rate.alias("per_second"))
