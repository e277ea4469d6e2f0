"""Streams with state by event time give what their batch forms give, in any order of arrival and across restarts."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import mutations
from loomgraph.streaming import stateful, telemetry

T0 = dt.datetime(2024, 1, 1)
END = T0 + dt.timedelta(days=60)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, stream, source, out, chunks, schema, tmp_path):
    """Each chunk of rows is a run of its own, from the checkpoint of the one before; the rows and the progress of all."""
    progress = []
    for rows in chunks:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        df = stream(spark.readStream.schema(schema).parquet(source))
        q = df.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{out}").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/{out}")
        q.awaitTermination()
        progress += [p["stateOperators"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/{out}"), progress


def shuffled(rows, seconds, parts, seed=0):
    """Rows in chunks by time, disordered by at most ``seconds``."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.uniform(0, seconds)))
    size = -(-len(late) // parts)
    return [late[k : k + size] for k in range(0, len(late), size)]


def test_debounce(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(T0 + dt.timedelta(milliseconds=rng.randrange(0, 120_000)), k, f"p{min(rng.randrange(9), 4)}") for k in range(400)]
    chunks = shuffled(rows, 5, 3) + [[(END, 10_000, "end")], [(END + dt.timedelta(days=1), 10_001, "end")]]
    schema = "ts timestamp, event_id long, path string"
    got, progress = run(rocks, lambda s: stateful.stream_debounce(s, 0.5, "6 seconds"), f"{tmp_path}/in", "out", chunks, schema, tmp_path)
    events = rocks.createDataFrame(rows, schema)
    want = mutations.accepted(events, 0.5, "path")
    plain = []
    for p in sorted({r[2] for r in rows}):
        last = None
        for t, k, _ in sorted(r for r in rows if r[2] == p):
            if last is None or t - last >= dt.timedelta(seconds=0.5):
                last = t
                plain.append((p, k, t))
    key = lambda r: (r[0], r[2], r[1])
    assert sorted(map(tuple, want.collect()), key=key) == sorted(plain, key=key)
    assert sorted((tuple(r) for r in got.where("path <> 'end'").collect()), key=key) == sorted(plain, key=key)
    held = [p[0]["numRowsTotal"] for p in progress]
    assert max(held) > 5 and held[-1] < max(held)


def test_sessions(rocks, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        op = rng.choices(["create", "call", "context", "terminate", "other"], [2, 6, 3, 1, 1])[0]
        rows.append((T0 + dt.timedelta(seconds=rng.randrange(0, 5_000)), k, rng.randrange(6), op, f"v{k}"))
    schema = "ts timestamp, event_id long, session_id long, op string, value string"
    chunks = shuffled(rows, 50, 3) + [[(END, 10_000, 99, "create", None)], [(END + dt.timedelta(days=1), 10_001, 99, "call", None)]]
    got, progress = run(rocks, lambda s: stateful.stream_sessions(s, 300, "1 minute"), f"{tmp_path}/in", "out", chunks, schema, tmp_path)
    want = stateful.sessions(rocks.createDataFrame(rows, schema), 300, now=str(END))
    plain, live = [], {}
    for t, k, s, op, value in sorted(rows):
        if s in live and (t - live[s][1]).total_seconds() > 300:
            plain.append((s, *live.pop(s), "expired"))
        if op == "create":
            if s in live:
                plain.append((s, *live.pop(s), "replaced"))
            live[s] = [t, t, 0, 0, None]
        elif s in live and op != "other":
            live[s][1] = t
            live[s][2] += op == "call"
            live[s][3] += op == "context"
            live[s][4] = value if op == "context" else live[s][4]
            if op == "terminate":
                plain.append((s, *live.pop(s), "terminated"))
    plain += [(s, *x, "expired") for s, x in live.items()]
    told = lambda df: sorted((r.session_id, r.opened, r.last_used, r.n_calls, r.n_contexts, r.context, r.ended) for r in df.where("session_id < 99").collect())
    assert told(want) == sorted(plain) and told(got) == sorted(plain)
    assert {r[-1] for r in plain} == {"expired", "replaced", "terminated"} and progress[-1][0]["numRowsTotal"] < max(p[0]["numRowsTotal"] for p in progress)


def test_cooccurrence_in_a_stream(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(T0 + dt.timedelta(seconds=rng.randrange(0, 20 * 86_400)), rng.randrange(3), rng.randrange(5), rng.random() < 0.8) for _ in range(250)]
    schema = "ts timestamp, session_id long, skill_id long, ok boolean"
    chunks = shuffled(rows, 3_000, 3)
    stop = [[(END, 99, 1, True)], [(END + dt.timedelta(days=30), 99, 1, True)]]
    stream = lambda s: stateful.windowed_cooccurrence(s, 86_400, "7 days", "1 hour")
    got, progress = run(rocks, stream, f"{tmp_path}/in", "out", chunks + [[(T0, 1, 1, True), (T0, 1, 2, True)]] + stop, schema, tmp_path)
    want = stateful.windowed_cooccurrence(rocks.createDataFrame(rows, schema), 86_400)
    told = lambda df: sorted(map(tuple, df.where(F.col("start") < F.lit(END)).collect()))
    assert told(got) == told(want) and len(told(want)) > 20
    assert sum(x["numRowsDroppedByWatermark"] for p in progress for x in p) >= 2
    assert progress[-1][-1]["numRowsTotal"] < max(p[-1]["numRowsTotal"] for p in progress)


def test_watched_folder_sees_moves(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    name = lambda p: p.rsplit("/", 1)[1] if p else None
    handle = lambda df: seen.append(sorted((name(r.path), r.kind, name(r.old_path)) for r in df.collect()))
    watch = lambda: telemetry.compare_folder(spark, str(folder), f"file:{tmp_path}/known", handle)
    for n, text in (("a.md", "1"), ("b.md", "2"), ("c.md", "3"), ("skip.txt", "4")):
        (folder / n).write_text(text)
    watch()
    (folder / "a.md").rename(folder / "z.md")
    (folder / "b.md").write_text("22")
    (folder / "c.md").unlink()
    (folder / "d.md").write_text("5")
    watch()
    (folder / "d.md").write_text("55")
    watch()
    watch()
    assert seen == [[("a.md", "created", None), ("b.md", "created", None), ("c.md", "created", None)], [("b.md", "modified", None), ("c.md", "deleted", None), ("d.md", "created", None), ("z.md", "moved", "a.md")], [("d.md", "modified", None)], []]


def test_folder_is_compared_again_and_again(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.md").write_text("1")
    q = telemetry.stream_files(spark, str(folder), f"file:{tmp_path}/known", f"{tmp_path}/cp", lambda df: seen.extend((r.path[-4:], r.kind) for r in df.collect()), seconds=1)
    try:
        for step, text in ((1, "22"), (2, "333")):
            until = time.time() + 60
            while len(seen) < step and time.time() < until and q.isActive:
                time.sleep(0.2)
            (folder / "a.md").write_text(text)
        while len(seen) < 3 and time.time() < until and q.isActive:
            time.sleep(0.2)
    finally:
        q.stop()
    assert seen[0] == ("a.md", "created") and set(seen[1:]) == {("a.md", "modified")}
