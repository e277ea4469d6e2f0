"""Stored tables, incremental imports and vector collections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import mutations, retrieval
from loomgraph.operators.collection import Collection
from loomgraph.plans import ingest, sync
from loomgraph.queries import QUERIES
from loomgraph.sources.store import Change, Conflict, Store, Table

N = Table("id long, v string, w double", ("id",), 4)
E = Table("a long, b long, w double", ("a", "b"), 4, spread=("a",))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"file:{tmp_path}/s", {"n": N, "e": E})


def nodes(spark, *ids, v="x"):
    return spark.createDataFrame([(i, v, float(i)) for i in ids], N.schema)


def test_store_is_made_once(spark, store):
    assert Store.create(spark, store.path, store.tables).tables == store.tables == Store(spark, store.path).tables
    with pytest.raises(ValueError):
        Store.create(spark, store.path, {"n": N})
    with pytest.raises(ValueError):
        Store.create(spark, f"{store.path}-2", {"n": Table("id long", ("key",))})
    with pytest.raises(FileNotFoundError):
        Store(spark, f"{store.path}-3")
    assert store.read("n").collect() == [] and store.versions() == []


def test_versions_are_snapshots_and_batches_apply_once(spark, store):
    assert store.commit("a", {"n": Change(nodes(spark, *range(10))), "e": Change(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.5)], E.schema))}) == 1
    twice = spark.createDataFrame([(3, "late", 9.0, 2), (3, "early", 8.0, 1), (70, "new", 7.0, 0)], N.schema + ", turn int")
    second = {"n": Change(twice, spark.createDataFrame([(5,), (71,), (70,)], "id long"), order="turn", keep=("w",)), "e": Change(clear=spark.createDataFrame([(1,), (9,)], "a long"))}
    assert store.commit("b", second) == 2
    before = store.manifest(1)["tables"]["n"]
    assert store.commit("b", {"n": Change(deletes=nodes(spark, 1))}) == 2 and store.commit("a", second) == 1
    assert rows(store.read("n", 1)) == rows(nodes(spark, *range(10)))
    want = {(i, "x", float(i)) for i in range(10) if i not in (3, 5)} | {(3, "late", 3.0), (70, "new", 7.0)}
    assert set(rows(store.read("n"))) == want and rows(store.read("e")) == [(2, 3, 0.5)] and len(rows(store.read("e", 1))) == 3
    assert rows(store.changed("n", 2)) == [(3, "late", 3.0, False), (70, "new", 7.0, True)] and rows(store.removed("n", 2)) == [(5,)]
    now = store.manifest(2)
    untouched = set(now["tables"]["n"]) - {str(b) for b in now["changed"]["n"]}
    assert all(now["tables"]["n"][b] == before[b] for b in untouched)
    assert {(r.version, r.table): (r.n_upserts, r.n_deletes) for r in store.history().collect()} == {(1, "n"): (10, 0), (1, "e"): (3, 0), (2, "n"): (2, 1), (2, "e"): (0, 2)}


def test_only_known_and_only_new(spark, store):
    store.commit("a", {"n": Change(nodes(spark, 1, 2))})
    store.commit("b", {"n": Change(nodes(spark, 2, 3, v="y"), only="known")})
    assert rows(store.read("n")) == [(1, "x", 1.0), (2, "y", 2.0)]
    store.commit("c", {"n": Change(nodes(spark, 2, 3, v="z"), only="new")})
    assert rows(store.read("n")) == [(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0)]


def test_failed_commits_leave_nothing(spark, store):
    store.commit("a", {"n": Change(nodes(spark, 1))})
    bad = spark.createDataFrame([(None, 2, 1.0)], E.schema)
    with pytest.raises(ValueError):
        store.commit("b", {"n": Change(nodes(spark, 2)), "e": Change(bad)})
    assert rows(store.read("n")) == [(1, "x", 1.0)] and store.versions() == [1] and store.committed("b") is None


def test_two_drivers(spark, store, monkeypatch):
    """The other driver commits between this one's reading and publishing."""
    store.commit("load", {"n": Change(nodes(spark, *range(8)))})
    other, write, once = Store(spark, store.path), Store._write, []

    def late(self, *args):
        out = write(self, *args)
        if self is store and not once:
            once.append(other.commit("other", {"n": Change(nodes(spark, 3, v="theirs"))}))
        return out

    monkeypatch.setattr(Store, "_write", late)
    assert store.commit("mine", {"n": Change(nodes(spark, 3, 4, v="mine"))}) == 3 and once == [2]
    assert {r.id: r.v for r in store.read("n").collect()} == dict.fromkeys(range(8), "x") | {3: "mine", 4: "mine"}
    assert {r.v for r in store.read("n", 2).where("id = 3").collect()} == {"theirs"}
    with pytest.raises(Conflict):
        store.commit("stale", {"n": Change(nodes(spark, 3))}, base=1)
    assert store.commit("fresh", {"n": Change(nodes(spark, 3, v="again"))}, base=3) == 4


def test_vacuum_keeps_what_the_newest_names(spark, store):
    for k in range(3):
        store.commit(f"b{k}", {"n": Change(nodes(spark, *range(20), v=str(k)))})
    assert store.vacuum() == 2 and {r.v for r in store.read("n").collect()} == {"2"}
    with pytest.raises(ValueError, match="vacuumed"):
        store.read("n", 1)
    assert store.commit("b0", {"n": Change(deletes=nodes(spark, 1))}) == 1


def skill(path, version="1.0.0", requires=(), uid=None, valid=True):
    hints = "".join(f"\n    - {r}" for r in requires)
    name = path.split("/")[1]
    return path, f"---\nskill_id: {uid or f'ns:{name}'}\nversion: {version if valid else 'x'}\nintent_description: {'does a thing well and then rests ' * 2}\npermissions:\n  - fs:read:/data" + (f"\ntopology_hints:\n  requires:{hints}" if hints else "") + "\n---\n# T\n"


STATES = [
    [skill("/a/SKILL.md", requires=("ns:b", "ns:c")), skill("/b/SKILL.md"), skill("/c/SKILL.md", valid=False), skill("/d/SKILL.md", uid="ns:b", version="9.0.0")],
    [skill("/a/SKILL.md", requires=("ns:c",)), skill("/b/SKILL.md"), skill("/c/SKILL.md", requires=("ns:a",)), skill("/d/SKILL.md", uid="ns:b", version="9.0.0"), skill("/e/SKILL.md")],
    [skill("/a/SKILL.md", valid=False), skill("/c/SKILL.md", requires=("ns:a",)), skill("/d/SKILL.md", uid="ns:b", version="9.0.0"), skill("/e/SKILL.md")],
    [],
    [skill("/e/SKILL.md", version="2.0.0")],
]


def listing(spark, files):
    return spark.createDataFrame(files, "path string, text string").withColumn("hash", F.md5("text"))


def test_incremental_import_equals_a_full_one(spark, tmp_path, monkeypatch):
    store = sync.graph_store(spark, f"file:{tmp_path}/g")
    parsed = []
    parse = ingest.parse
    monkeypatch.setattr(sync, "parse", lambda files: parsed.append(files.count()) or parse(files))
    embed = lambda n: n.select("path", "uid", F.array(F.length("intent_description").cast("double")).alias("vector"))
    for k, files in enumerate(STATES):
        v = sync.sync(store, listing(spark, files), f"s{k}", embed)
        whole = sync.graph_store(spark, f"file:{tmp_path}/full-{k}")
        sync.sync(whole, listing(spark, files), "all", embed)
        for name in ("files", "nodes", "edges", "errors", "vectors"):
            assert rows(store.read(name, v)) == rows(whole.read(name)), (k, name)
    assert parsed[::2] == [4, 3, 1, 0, 1]
    assert {r.uid: r.version for r in sync.graph(store, 2)[0].collect()} == {"ns:a": "1.0.0", "ns:b": "1.0.0", "ns:c": "1.0.0", "ns:e": "1.0.0"}
    assert {r.uid: r.version for r in sync.graph(store, 3)[0].collect()} == {"ns:b": "9.0.0", "ns:c": "1.0.0", "ns:e": "1.0.0"}
    assert {r.table: r[1:] for r in sync.import_report(store, 2).collect()}["nodes"] == (2, 1, 0)
    assert sync.sync(store, listing(spark, STATES[0]), "s4") == 5


def test_folder_opens_only_changed_files(spark, tmp_path):
    import os

    store = sync.graph_store(spark, f"file:{tmp_path}/g")
    for path, text in STATES[0]:
        (tmp_path / "in" / path[1]).mkdir(parents=True, exist_ok=True)
        p = tmp_path / f"in{path}"
        p.write_text(text)
        os.utime(p, (1_700_000_000, 1_700_000_000))
    first = sync.folder(store, f"{tmp_path}/in")
    assert first.where("text is null").count() == 0
    sync.sync(store, first, "s0")
    (tmp_path / "in/b/SKILL.md").write_text(skill("/b/SKILL.md", version="3.0.0")[1])
    (tmp_path / "in/d/SKILL.md").unlink()
    found = sync.folder(store, f"{tmp_path}/in")
    assert {r.path.rsplit("/", 2)[1]: r.text is not None for r in found.collect()} == {"a": False, "b": True, "c": False}
    sync.sync(store, found, "s1")
    assert {r.uid: r.version for r in sync.graph(store)[0].collect()} == {"ns:a": "1.0.0", "ns:b": "3.0.0"}
    assert rows(store.read("errors"))[0][1].startswith("version")


def test_repeated_keys_of_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    twice = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (3, "c", 1), (3, "d", 0)], "id long, v string, turn int")
    assert rows(mutations.upsert(base, twice, "id", order="turn")) == [(1, "new"), (2, "b"), (3, "c")]
    assert rows(mutations.upsert(base, twice, "id")) == [(1, "old"), (2, "b"), (3, "d")]
    assert rows(mutations.update(base, twice, "id", order="turn")[0]) == [(1, "new"), (2, "b")]
    assert rows(mutations.vector_write(base, twice.withColumn("vector", F.array(F.lit(1.0))), order="turn")) == [(1, "new"), (2, "b"), (3, "c")]
    edges = spark.createDataFrame([(1, 2, "REQUIRES", 1.0)], "source long, target long, edge_type string, weight double")
    new = spark.createDataFrame([(1, 2, "REQUIRES", 0.2, 1), (1, 2, "REQUIRES", 0.4, 2), (2, 9, "REQUIRES", 1.0, 1)], "source long, target long, edge_type string, weight double, turn int")
    assert rows(mutations.edge_upsert(edges, new, base, order="turn")) == [(1, 2, "REQUIRES", 0.4)]


def blobs(spark, n=1500, dim=16, groups=12):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (groups, dim))
    v = middle[rng.integers(0, groups, n)] + rng.normal(0, 0.15, (n, dim))
    v[: n // 3] = v[0]  # a third of all are one vector
    rows = [(i, x.tolist(), int(i % 4)) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "id long, vector array<double>, kind int")


def near(v, ids, k, ok=lambda i: True):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in ids:
        sim = np.round(u @ u[i], 6)
        out[i] = [int(j) for j in sorted(range(len(v)), key=lambda j: (-sim[j], j)) if ok(j)][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.request_id, []).append(r.id)
    return out


def share(got, want):
    return np.mean([len(set(got.get(i, ())) & set(x)) / len(x) for i, x in want.items()])


def test_collection_probes_few_cells_of_grouped_vectors(spark, tmp_path):
    v, rows_ = blobs(spark)
    c = Collection.create(spark, f"file:{tmp_path}/c", 16, rows_, "kind int")
    assert c.upsert("load", rows_) == 2 and c.upsert("load", rows_) == 2 and c.rows().count() == 1500
    probes = c.tune()
    assert len(c.centers) == 39 and probes < 20 and Collection(spark, c.store.path).probes == probes
    asked = rows_.where("id % 50 = 7").selectExpr("id request_id", "vector query_vector")
    want = near(v, range(7, 1500, 50), 10)
    assert found(c.exact(asked, 10)) == want and share(found(c.search(asked, 10)), want) >= 0.9
    whole = c.search(asked, 10, probes=len(c.centers), refine=200)
    assert found(whole) == want
    some = near(v, range(7, 1500, 50), 10, lambda i: i % 4 == 1)
    assert found(c.exact(asked, 10, "kind = 1")) == some and share(found(c.search(asked, 10, "kind = 1")), some) >= 0.9
    rare = near(v, range(7, 1500, 50), 5, lambda i: i > 1490)
    assert found(c.search(asked, 5, "id > 1490", probes=1)) == rare  # too few in the cells: searched exactly


def test_collection_writes(spark, tmp_path):
    v, rows_ = blobs(spark, 200, 8, 5)
    c = Collection.create(spark, f"file:{tmp_path}/c", 8, rows_, "kind int")
    c.upsert("load", rows_)
    bad = spark.createDataFrame([(1, [1.0] * 7, 0), (2, None, 0), (None, [1.0] * 8, 0), (3, [float("nan")] + [1.0] * 7, 0), (4, [None] + [1.0] * 7, 0), (900, [2.0] * 8, 5), (900, [3.0] * 8, 4)], "id long, vector array<double>, kind int")
    assert {(r.id, r.reason) for r in c.rejected(bad).collect()} == {(1, "dimension"), (2, "no vector"), (None, "no id"), (3, "not finite"), (4, "not finite")}
    c.upsert("bad", bad, order="kind")
    assert c.rows().count() == 201 and c.rows("id = 900").first()["kind"] == 5 and c.rows("id = 1").first()["vector"] == v[1].tolist()
    c.upsert("move", spark.createDataFrame([(1, (-v[1]).tolist(), 9)], rows_.schema))
    c.delete("gone", spark.createDataFrame([(900,), (5,), (None,)], "id long"))
    assert c.rows().count() == 199 and c.rows("id = 1").count() == 1 and c.rows(version=2).where("id = 5").count() == 1
    asked = spark.createDataFrame([(0, (-v[1]).tolist()), (1, [1.0] * 7)], "request_id long, query_vector array<double>")
    assert found(c.exact(asked.where("request_id = 0"), 1)) == {0: [1]}
    with pytest.raises(ValueError):
        c.search(asked, 1)
    with pytest.raises(ValueError):
        Collection.create(spark, c.store.path, 9, rows_)
    none = Collection.create(spark, f"file:{tmp_path}/none", 8, rows_.limit(0))
    assert none.search(asked.where("request_id = 0"), 3).collect() == [] and none.tune() == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_ann_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    v = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id id", "embedding vector")
    want = found(retrieval.top_k(v.where("id % 50 = 0").selectExpr("id request_id", "vector query_vector"), v, 10))
    assert share(found(QUERIES["ann_topk"](spark, d)), want) >= 0.9


def test_top_k_in_blocks(spark, monkeypatch):
    v, rows_ = blobs(spark, 300, 8, 5)
    rows_ = rows_.unionByName(spark.createDataFrame([(None, v[0].tolist(), 0), (1001, None, 0), (1002, [1.0], 0), (1003, [float("nan")] * 8, 0)], rows_.schema))
    asked = rows_.where("id % 10 = 0").selectExpr("id request_id", "vector query_vector")
    want = near(v, range(0, 300, 10), 4)
    assert found(retrieval.top_k(asked, rows_, 4)) == want
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 64 * 7)
    monkeypatch.setattr(retrieval, "CELLS", 50)
    assert found(retrieval.top_k(asked, rows_, 4)) == want
    assert retrieval.top_k(asked.limit(0), rows_, 4).collect() == []
