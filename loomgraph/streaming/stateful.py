"""Streams whose state follows event time and ends: debouncing, sessions, co-occurrence, and their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """A fold over each key's rows in order of (ts, event_id), however they arrive within the watermark.

    Rows wait in the key's list until the watermark passes them; then ``step`` takes them
    in order and may give rows out.  ``until`` says up to which time (in
    microseconds) the state matters: when the watermark has passed it ``end`` may
    give a last row, and all state of the key goes.  Subclasses set ``rows``
    (schema of the waiting rows, ts and event_id first) and ``kept`` (that of the state).
    """

    rows = kept = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.state = handle.getValueState("state", self.kept)

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def until(self, state: tuple) -> int | None:
        raise NotImplementedError

    def end(self, state: tuple) -> list[tuple]:
        return []

    def out(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _alarm(self, micros: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        names = [c.split()[0] for c in self.rows.split(", ")]
        new["ts"] = new["ts"].astype("datetime64[us]").astype("int64")
        self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in new[names].itertuples(index=False, name=None)])
        self._alarm(min(r[0] for r in self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        state, found = tuple(self.state.get()) if self.state.exists() else None, []
        for r in ready:
            state, given = self.step(state, r)
            found += given
        last = None if state is None else self.until(state)
        if last is not None and last < passed and not later:
            found += self.end(state)
            state = None
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        if state is not None:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        times = [r[0] for r in later[:1]] + ([max(last, passed)] if state is not None and last is not None else [])
        if times:
            self._alarm(min(times))
        if found:
            yield self.out(key, found)

    def close(self) -> None:
        pass


def _stamp(values: list[int]) -> pd.Series:
    return pd.Series(values, dtype="int64").astype("datetime64[us]")


class Debounce(InOrder):
    rows, kept = "ts long, event_id long", "last long"

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1_000_000)

    def step(self, state, row):
        if state is not None and row[0] - state[0] < self.wait:
            return state, []
        return (row[0],), [row]

    def until(self, state):
        return state[0] + self.wait  # later rows are taken without it

    def out(self, key, found):
        return pd.DataFrame({"path": key[0], "event_id": [r[1] for r in found], "ts": _stamp([r[0] for r in found])})


def stream_debounce(events: DataFrame, seconds: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """Events (path, event_id, ts) at least ``seconds`` after the last accepted one of their path.

    Events are taken in order of time once the watermark, ``late`` behind the
    newest event, has passed them; later ones are dropped and counted by Spark.  So
    the result is that of ``mutations.accepted`` whatever the arrival.  A path's
    state goes once ``seconds`` have passed since its last accepted event.  The
    session's state store must be RocksDB (``ROCKS``).
    """
    rows = events.select("path", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("path").transformWithStateInPandas(Debounce(seconds), "path string, event_id long, ts timestamp", "Append", "EventTime")


# Sessions -------------------------------------------------------------------

#: Fixed value: seconds that a session lives after its last use.
SESSION_SECONDS = 86_400
SESSION = "session_id long, opened timestamp, last_used timestamp, ended string, n_calls long, n_contexts long, context string"


def sessions(log: DataFrame, seconds: float = SESSION_SECONDS, now: str | None = None) -> DataFrame:
    """(session_id, opened, last_used, ended, n_calls, n_contexts, context) of every session in a log (session_id, ts, event_id, op, value).

    ``create`` opens a session, over a live one ("replaced"); ``context`` (with a
    value) changes its context, ``call`` records a call, ``terminate`` ends it
    ("terminated").  Each of these renews it; unused for over ``seconds`` it is
    "expired", judged for the last one at ``now`` (the log's end without one).  What
    comes for a session that is not live is ignored, and renews nothing.  Sessions
    are found by windows in order of (ts, event_id), without gathering a key's rows.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    wait = int(seconds * 1_000_000)
    order = Window.partitionBy("session_id").orderBy("t", "event_id")
    each = Window.partitionBy("session_id", "nth").orderBy("t", "event_id")
    rows = log.where("op in ('create', 'context', 'call', 'terminate')").select("session_id", t.alias("t"), "event_id", "op", "value")
    opened = F.sum((F.col("op") == "create").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut_off = F.coalesce((F.col("t") - F.lag("t").over(each)) > wait, F.lit(False)) | F.coalesce(F.lag("op").over(each) == "terminate", F.lit(False))
    live = rows.withColumn("nth", opened).where("nth > 0").withColumn("off", cut_off)
    live = live.withColumn("off", F.max("off").over(each.rowsBetween(Window.unboundedPreceding, 0))).where("not off")
    one = live.groupBy("session_id", "nth").agg(
        F.min("t").alias("opened"),
        F.max("t").alias("last"),
        F.max_by("op", F.struct("t", "event_id")).alias("last_op"),
        F.count_if(F.col("op") == "call").alias("n_calls"),
        F.count_if(F.col("op") == "context").alias("n_contexts"),
        F.max_by("value", F.when(F.col("op") == "context", F.struct("t", "event_id"))).alias("context"),
    )
    stop = F.unix_micros(F.lit(now).cast("timestamp")) if now else F.lit(rows.agg(F.max("t")).first()[0]).cast("long")
    follow = F.lead("opened").over(Window.partitionBy("session_id").orderBy("nth"))
    ended = F.when(F.col("last_op") == "terminate", "terminated").when(F.col("next") - F.col("last") <= wait, "replaced").when(F.coalesce("next", stop) - F.col("last") > wait, "expired").otherwise("live")
    one = one.withColumn("next", follow).withColumn("ended", ended)
    return one.select("session_id", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("last").alias("last_used"), "ended", "n_calls", "n_contexts", "context")


class Session(InOrder):
    rows = "ts long, event_id long, op string, value string"
    kept = "opened long, last long, n_calls long, n_contexts long, context string"

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1_000_000)

    def step(self, state, row):
        ts, _, op, value = row
        found = []
        if state is not None and ts - state[1] > self.wait:
            found, state = [(*state, "expired")], None
        if op == "create":
            return (ts, ts, 0, 0, None), found + ([(*state, "replaced")] if state is not None else [])
        if state is None:
            return None, found
        opened, _, calls, contexts, context = state
        if op == "terminate":
            return None, found + [(opened, ts, calls, contexts, context, "terminated")]
        if op == "context":
            return (opened, ts, calls, contexts + 1, value), found
        return (opened, ts, calls + 1, contexts, context), found

    def until(self, state):
        return state[1] + self.wait

    def end(self, state):
        return [(*state, "expired")]

    def out(self, key, found):
        opened, last, calls, contexts, context, ended = zip(*found)
        return pd.DataFrame({"session_id": key[0], "opened": _stamp(opened), "last_used": _stamp(last), "ended": ended, "n_calls": calls, "n_contexts": contexts, "context": pd.Series(context, dtype=object)})


def stream_sessions(log: DataFrame, seconds: float = SESSION_SECONDS, late: str = "1 minute") -> DataFrame:
    """The sessions of ``sessions`` as they end; live ones are in the state, which holds a small row a live session."""
    rows = log.where("op in ('create', 'context', 'call', 'terminate')").select(F.col("session_id").cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "op", F.col("value").cast("string").alias("value"))
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(Session(seconds), SESSION, "Append", "EventTime")


# Co-occurrence --------------------------------------------------------------


def pairs_within(events: DataFrame, seconds: int, late: str | None = None) -> DataFrame:
    """(session_id, a, b, ts, gap, ok): skills a then b in one session within a time; ``ts`` is b's.

    Sessions are cut into slots of that time, so a busy session isn't one group.
    With ``late`` both sides have that watermark and the bounded difference of their
    times ends the state of either; events later than it are dropped and counted.
    """
    at = events.select("session_id", "skill_id", F.col("ts").cast("timestamp").alias("ts"), "ok")
    slot = F.floor(F.unix_micros("ts") / (seconds * 1_000_000))
    x = at.select(F.col("session_id").alias("s"), F.col("skill_id").alias("a"), F.col("ts").alias("t"), F.col("ok").alias("first_ok"), F.explode(F.array(slot, slot + 1)).alias("meets"))
    y = at.select("session_id", F.col("skill_id").alias("b"), "ts", "ok", slot.alias("slot"))
    if late is not None:
        x, y = x.withWatermark("t", late), y.withWatermark("ts", late)
    near = F.expr(f"s = session_id and meets = slot and a <> b and ts > t and ts <= t + interval {seconds} seconds")
    return x.join(y, near).select("session_id", "a", "b", "ts", ((F.unix_micros("ts") - F.unix_micros("t")) / 1e6).alias("gap"), (F.col("ok") & F.col("first_ok")).alias("ok"))


def windowed_cooccurrence(events: DataFrame, seconds: int = 3600, width: str = "7 days", late: str | None = None) -> DataFrame:
    """(start, a, b, n, success, avg_gap) of ``pairs_within`` per window of b's time; batch, or a stream with ``late``."""
    g = pairs_within(events, seconds, late).groupBy(F.window("ts", width), "a", "b").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("success"), F.avg("gap").alias("avg_gap"))
    return g.select(F.col("window.start").alias("start"), "a", "b", "n", F.round("success", 6).alias("success"), F.round("avg_gap", 3).alias("avg_gap"))
