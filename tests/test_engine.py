"""Golden values, properties and streams of the routing engine."""

import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph import queries as engine
from loomgraph.functions import text as tx
from loomgraph.operators import assembly, code_facts, conflicts, graph, mutations, reliability, retrieval, scoring
from loomgraph.plans import ingest
from loomgraph.sources import skill_files
from loomgraph.streaming import telemetry

SCORED = "request_id long, id long, similarity double, is_seed boolean, edge_type string, score double"
EDGE = "source long, target long, edge_type string, weight double"


@pytest.mark.parametrize(("rate", "ok", "expected"), [(0.9, True, 0.905), (0.9, False, 0.855), (0.3, True, 0.335), (0.3, False, 0.285), (0.1, True, 0.145), (0.1, False, 0.1), (1.0, True, 1.0)])
def test_ewma(spark, rate, ok, expected):
    got = spark.range(1).select(reliability.ewma(F.lit(rate), F.lit(ok)).alias("r")).first()["r"]
    assert got == pytest.approx(expected)


def test_protected_independent_set(spark):
    rows = [(1, 1, 0.0, False, None, 0.9), (1, 2, 0.0, True, None, 0.5), (1, 3, 0.0, False, None, 0.4), (1, 4, 0.0, True, None, 0.3), (2, 1, 0.0, False, None, 0.9), (2, 3, 0.0, False, None, 0.7), (2, 5, 0.0, False, None, 0.5)]
    edges = [(1, 2, "CONFLICTS_WITH", 1.0), (2, 3, "SUBSTITUTES", 1.0), (1, 3, "CONFLICTS_WITH", 1.0), (3, 5, "CONFLICTS_WITH", 1.0)]
    s, e = spark.createDataFrame(rows, SCORED), spark.createDataFrame(edges, EDGE)
    kept = lambda protect: {r: [x.id for x in conflicts.independent_set(s, e, protect).where(F.col("request_id") == r).orderBy("position").collect()] for r in (1, 2)}
    assert kept(True) == {1: [2, 4], 2: [1, 5]}
    assert kept(False) == {1: [1, 4], 2: [1, 5]}
    assert conflicts.violations(conflicts.independent_set(s, e), e).count() == 0


def test_packing_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, 1, 3.0, 0, 5), (1, 2, 2.0, 0, 8), (1, 3, 1.0, 0, 3)], "request_id long, id long, priority double, topo int, tokens int")
    r = assembly.pack_budget(items, 9, 0).first()
    assert (r.ids, r.used) == ([1, 3], 8)
    assert assembly.pack_budget(items, 5, 10).first().ids == []


def test_cap_swaps_a_seed_in(spark):
    rows = [(1, k, 0.1 * k, k == 6, None, 1.0 - 0.1 * k) for k in range(1, 7)]
    got = {r.id for r in assembly.cap(spark.createDataFrame(rows, SCORED), 5).collect()}
    assert got == {2, 3, 4, 5, 6}


def test_levels_and_cycles(spark):
    e = lambda pairs: spark.createDataFrame(pairs, "source long, target long")
    chain = {r.id: (r.depth, r.level) for r in graph.levels(e([(1, 2), (2, 3), (3, 4), (4, 5)])).collect()}
    assert chain == {1: (4, "deep"), 2: (3, "medium"), 3: (2, "medium"), 4: (1, "shallow"), 5: (0, "root")}
    loop = e([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)])
    assert {r.id: r.component for r in graph.components(loop).collect()} == {1: 1, 2: 1, 3: 1}
    assert graph.cycle_paths(loop).first().path == [1, 2, 3, 1]
    assert {r.id: r.level for r in graph.levels(loop).collect()}[4] == "unknown"
    got = {(r.source, r.target): r.creates_cycle for r in graph.would_cycle(e([(1, 2), (2, 3)]), e([(3, 1), (1, 3), (7, 7)])).collect()}
    assert got == {(3, 1): True, (1, 3): False, (7, 7): True}


def test_pagerank_without_edges_is_uniform(spark):
    pool = spark.createDataFrame([(1, k, 0.0, True, None, 0.0) for k in range(4)], SCORED)
    none = spark.createDataFrame([], EDGE)
    assert {r.pagerank for r in scoring.pagerank(pool, none).collect()} == {0.25}
    one = spark.createDataFrame([(0, 1, "REQUIRES", 1.0)], EDGE)
    got = {r.id: r.pagerank for r in scoring.pagerank(pool, one).collect()}
    assert got[1] == 1.0 and got[0] == pytest.approx(got[2]) and got[0] < 1


def test_top_k_block_and_join_agree(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(40)] + [(99, [0.0, 0.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 1.0]), (2, [0.0, 0.0, 0.0])], "request_id long, query_vector array<float>")
    fast = sorted(map(tuple, retrieval.top_k(q, v, 7).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    assert fast == sorted(map(tuple, retrieval.top_k(q, v, 7).collect()))


def test_text_functions(spark):
    df = spark.createDataFrame([("  Commit   my été!  提交 (now) ", "a b c"), ("", ""), (None, "   ")], "q string, t string")
    got = df.select(tx.clean("q").alias("c"), tx.word_tokens("t").alias("n")).collect()
    assert [r.c for r in got] == ["commit my été 提交 now", "", None] and [r.n for r in got] == [3, 0, 0]
    assert tx.language  # names resolve in ingest tests


def test_ingest_reports_errors(spark, tmp_path):
    good = "---\nskill_id: a:b\nversion: 1.0.0\nintent_description: " + "x" * 60 + "\npermissions:\n  - fs:read:/x\ntopology_hints:\n  requires:\n    - a:c\n---\n# T\n\n```py\nimport os\n```\n"
    for name, text in (("one", good), ("two", "---\nskill_id: [bad\n---\nx\n"), ("three", "no front matter")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    skills, edges, errors = ingest.ingest(spark, str(tmp_path))
    assert [r.uid for r in skills.collect()] == ["a:b"]
    assert [tuple(r) for r in edges.collect()] == [("a:b", "a:c", "REQUIRES", 1.0)]
    assert {r.path.split("/")[-2] for r in errors.collect()} == {"two", "three"}
    assert skill_files.fenced("x\n```js {a=1, entrypoint=true}\nf()\n```\n")[0][2:] == (2, 4, {"a": "1", "entrypoint": "true"}, True)


@pytest.mark.parametrize(("language", "code", "names"), [("python", "async def run(a, b):\n    return a\n\nx = 1", ["run"]), ("bash", "main() {\n  echo\n}", ["main"]), ("go", "func Run(a int) {\n}", ["Run"]), ("rust", "pub fn main() -> u8 {\n}", ["main"]), ("java", "public static void main(String a) {\n}", ["main"]), ("javascript", "export async function handler(e) {\n}", ["handler"]), ("cobol", "x", [])])
def test_code_facts(language, code, names):
    functions, _, _ = code_facts.extract(code, language)
    assert [f[0] for f in functions] == names and all(f[7] for f in functions)


def test_redaction_is_exact_or_suffix():
    assert telemetry.redact_json({"bearer_token": 1, "max_tokens": 2, "a": {"Password": 3}}) == {"bearer_token": "[FILTERED]", "max_tokens": 2, "a": {"Password": "[FILTERED]"}}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=8, unique_by=lambda x: x[0]))
def test_upsert_is_idempotent(spark, rows):
    base = spark.createDataFrame([(0, 9), (7, 9)], "id long, v long")
    change = spark.createDataFrame(rows, "id long, v long")
    once = mutations.upsert(base, change, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, mutations.upsert(once, change, "id").collect()))


def _events(spark, tmp_path, n=60):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 4, start + dt.timedelta(seconds=k), k, k % 5 != 0) for k in range(n)]
    schema = "skill_id long, ts timestamp, event_id long, ok boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, schema), schema


def test_stream_equals_batch(spark, tmp_path):
    batch, schema = _events(spark, tmp_path)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = telemetry.stream_reliability(stream).writeStream.format("memory").queryName("rel").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("rel").groupBy("skill_id").agg(F.max_by(F.struct("n_events", "reliability", "is_deprecated"), "n_events").alias("x")).select("skill_id", "x.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, reliability.fold(batch).collect()))


def test_permission_conflicts_cover_every_owner(spark, monkeypatch):
    rows = [(1, "fs:read:/a"), (150, "fs:delete:/a"), (250, "fs:delete:/a"), (3000, "exec:write"), (3001, "exec:execute"), (3002, "exec:execute:/x"), (3003, "fs:read"), (3004, "fs:write:/a"), (3004, "fs:read:/a")]
    monkeypatch.setattr(engine.fx, "permissions", lambda s, d: spark.createDataFrame(rows, "id long, permission string"))
    kinds = {frozenset(("read", "delete")): "read_delete_conflict", frozenset(("write", "execute")): "write_execute_conflict"}
    want = []
    for i, p in rows:
        for j, q in rows:
            (c, a, *t), (e, b, *u) = p.split(":"), q.split(":")
            if i < j and c == e and t == u and frozenset((a, b)) in kinds:
                want.append((i, j, kinds[frozenset((a, b))], p, q))
    got = [tuple(r) for r in engine.permission_conflicts(spark, "").select("id_a", "id_b", "type", "permission_a", "permission_b").collect()]
    assert sorted(got) == sorted(want) and len(want) == 5


def test_masks(spark):
    rows = spark.createDataFrame([("a 3163220311217393 b me@x.org\nc 3163220311217394", None), (None, None)], "t string, u string")
    got = rows.select(tx.mask_personal("t", "partial").alias("p"), tx.mask_personal("t", "full", ["card"]).alias("f"), tx.mask_personal("t", "hash", ["email"]).alias("h"), tx.mask_personal("t").alias("r")).collect()
    assert got[0].p == "a ************7393 b *****org\nc ************7394" and got[0].f.count("*") == 32 and got[0].r == "a [card] b [email]\nc [card]"
    assert got[0].h == "a 3163220311217393 b " + hashlib.sha256(b"me@x.org").hexdigest()[:12] + "\nc 3163220311217394" and tuple(got[1]) == ("", "", "", "")


def test_snapshots_are_stored_whole(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert mutations.load_snapshot(spark, path).count() == 0
    for k, rows in enumerate([[("a", "1")], [("a", "2"), ("b", "3")]]):
        mutations.save_snapshot(spark.createDataFrame(rows, "path string, hash string"), path, k)
    (tmp_path / "snap" / "version=7").mkdir()  # left by a lost driver
    assert sorted(map(tuple, mutations.load_snapshot(spark, path).collect())) == [("a", "2"), ("b", "3")]


def test_telemetry_stream_reaches_its_sink_once(spark, tmp_path):
    rows = [(k, f"t{k % 3}", kind, {"password": "x", "note": "y"}) for k, kind in enumerate(["SKILL_CALLED", "SKILL_FAILED", "SKILL_SUCCESS"] * 40)]
    events = spark.createDataFrame(rows, "event_id long, trace_id string, event_type string, fields map<string,string>").withColumn("ts", F.timestamp_seconds("event_id"))
    events = events.select("event_id", "trace_id", "event_type", "ts", "fields")
    events.where("event_id < 60").write.parquet(str(tmp_path / "in"))
    stream = lambda: telemetry.prepared(spark.readStream.schema(telemetry.EVENT).parquet(str(tmp_path / "in")))
    for _ in range(2):  # a second start goes on after the first
        telemetry.flush(stream(), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
        events.where("event_id >= 60").write.mode("append").parquet(str(tmp_path / "in")) if _ == 0 else None
    got = [json.loads(r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {r.event_id for r in telemetry.sampled(events, "event_id", "event_type").collect()}
    assert sorted(g["event_id"] for g in got) == sorted(want) and 80 <= len(want) < 120
    assert all(g["fields"] == {"password": "[FILTERED]", "note": "y"} and g["code"] in ("E001", "E002", "E003") for g in got)


def test_messages_go_to_the_handlers_of_their_types(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "event_type string, n long").write.parquet(str(tmp_path / "in"))
    seen = {}
    take = lambda name: lambda df: seen.setdefault(name, []).extend(r.n for r in df.collect())
    stream = spark.readStream.schema("event_type string, n long").parquet(str(tmp_path / "in"))
    telemetry.dispatch(stream, {"a": take("a"), None: take("rest")}, str(tmp_path / "check"), once=True).awaitTermination()
    assert {k: sorted(v) for k, v in seen.items()} == {"a": [1, 4], "rest": [2, 3]}


def test_file_events_of_a_watched_folder(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    seen = []

    def run():
        handle = lambda df: seen.extend(tuple((r.path.rsplit("/", 1)[-1], r.kind)) for r in df.collect())
        telemetry.compare_folder(spark, str(folder), str(tmp_path / "known"), handle)

    (folder / "a.md").write_text("1")
    (folder / "b.md").write_text("1")
    run()
    assert sorted(seen) == [("a.md", "created"), ("b.md", "created")]
    seen.clear()
    (folder / "b.md").unlink()
    (folder / "c.md").write_text("3")
    run()
    assert sorted(seen) == [("b.md", "deleted"), ("c.md", "created")]


def test_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=4)]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    requests = vectors.where("id < 9").toDF("request_id", "query_vector")
    whole = sorted(map(tuple, retrieval.top_k(requests, vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 64)
    assert sorted(map(tuple, retrieval.top_k(requests, vectors, 3).collect())) == whole and len(whole) == 27
    assert retrieval.top_k(requests.limit(0), vectors, 3).count() == 0


def test_graphs_without_order(spark):
    """Components, depths and searches against brute force on random graphs."""
    rng = np.random.default_rng(5)
    for n, m in ((16, 21),):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))})
        e = spark.createDataFrame(pairs, "source long, target long")
        reach = {(a, b) for a, b in pairs}
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
            if more == reach:
                break
            reach = more
        mates = {a: {b for b in range(n) if b != a and (a, b) in reach and (b, a) in reach} for a in range(n)}
        assert {r.id: r.component for r in graph.components(e).collect()} == {a: min(a, *s) for a, s in mates.items() if s}
        loops = {a for a in range(n) if (a, a) in reach}
        bad = loops | {a for a, b in reach if b in loops}
        depth = {r.id: r.depth for r in graph.peel(e)[0].collect()}

        def longest(a):
            return max((1 + longest(c) for b, c in pairs if b == a), default=0)

        assert depth == {a: longest(a) for a in {a for a, _ in pairs} - bad}
        asked = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (25, 2))})
        got = {(r.source, r.target): r.creates_cycle for r in graph.would_cycle(e, spark.createDataFrame(asked, "source long, target long")).collect()}
        assert got == {(a, b): a == b or (b, a) in reach for a, b in asked}


def test_bpe_tokens(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    path = vocabularies.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    texts = ["push the branch", "", None, "größer 日本"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", tx.bpe_tokens("t", path).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_deprecation_writes_tell_changes(spark):
    skills = spark.createDataFrame([(1, False), (2, True), (3, True), (4, None)], "id long, is_deprecated boolean")
    folded = spark.createDataFrame([(1, True, 0.2), (2, False, 0.9), (3, True, 0.2), (4, False, 0.9)], "skill_id long, is_deprecated boolean, reliability double")
    assert sorted(map(tuple, reliability.deprecation_writes(skills, folded).collect())) == [(1, True, "low_reliability", 0.2), (2, False, None, None)]


def test_strict_parsing_ends_at_an_invalid_file(spark):
    head = "---\nskill_id: a:b\nversion: 1.0.0\nintent_description: " + "does a thing " * 5 + "\npermissions:\n  - fs:read:/x\nauthor: 7\ncolour: red\n---\n# T\n"
    good = spark.createDataFrame([("/s/a/b/SKILL.md", head)], "path string, text string")
    row = ingest.parse(good, strict=True).first()
    assert row.is_valid and row.warnings == ["author:type", "colour:unknown"]
    bad = good.unionByName(spark.createDataFrame([("/s/a/c/SKILL.md", head.replace("1.0.0", "one"))], "path string, text string"))
    assert sorted(r.is_valid for r in ingest.parse(bad).collect()) == [False, True]
    with pytest.raises(Exception, match="version:pattern"):
        ingest.parse(bad, strict=True).select("is_valid").collect()
