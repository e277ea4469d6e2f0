"""The registered queries run on the small tables, and the pipeline's decisions hold against brute force."""

import collections
import hashlib
import re
import zlib

import public_tokenizers
import pytest
from oracle import duck, rows_of

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name.startswith("op1_"):
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    elif name.startswith("op2_"):
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(BPE).encode
        labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        want = collections.defaultdict(lambda: [0, 0, 0])
        for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
            label = labels.get(r.doc_id)
            if label is None or label.toxic != 1:
                words = "words_v2" if label is not None and label.quality == 0 else "words_v1"
                text = r.text or ""
                for kind, n in ((words, len(WORD.findall(text))), ("byte_bpe_50k", len(encode(text, add_special_tokens=False).ids))):
                    for k, x in enumerate((1, n, len(text))):
                        want[r.source, r.lang, kind][k] += x
        assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in rows} == want and any(k[2] == "words_v2" for k in want)
    elif re.match("op1[1-3]_", name):
        columns, want = duck(SF, queries.ORACLES[name])
        assert sorted(columns) == sorted(df.columns) and rows_of(df.columns, rows) == want
    else:
        ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in rows} == ids and (name.startswith("op9_") or len(rows) == len(ids))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns

    before, after = seen["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    known = [r.doc_id for r in before.collect() if r.doc_id in labels]
    wrong = sum((i in kept) == bool(labels[i]) for i in known)
    assert wrong / len(known) < 0.15 and sum(i not in kept for i in known if not labels[i]) == 0

    before, after = seen["exact_dedup"]
    groups = collections.defaultdict(list)
    for r in before.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(g) for g in groups.values())

    before, after = seen["ngram_jaccard_join"]
    sets = {}
    for r in before.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    assert sorted(r.doc_id for r in after.collect()) == [i for i in ids if find(i) == i]

    before, after = seen["mix_sources"]
    digest = lambda df: collections.Counter((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in df.collect())
    had, has = digest(before), digest(after)
    assert set(has) <= set(had) and max(has.values()) <= 3

    _, packed = seen["best_fit_packing"]
    whole = collections.Counter()
    for r in packed.where("piece = 0").collect():
        whole[r.doc_id] += 1
    assert whole == collections.Counter({i: n for (i, _), n in has.items()})


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, timeout=120).returncode == 0


def test_held_out_rule(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


EDGE = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, score string, Sid string, d int"


def edge_rows():
    words = " ".join(f"w{k * 7919 % 9973}" for k in range(300))
    rows = [(1, words, "en", "a"), (2, words + " ", "en", "a"), (3, words.replace("w3", "v3", 2), "en", "b"), (3, words.replace("w3", "v3", 2), "en", "b"), (4, None, None, None), (5, "", "de", "a"), (6, " \t", "de", None)]
    rows += [(None, "no id here at all but words", "en", "a"), (None, None, None, None), (7, words * 40, "en", "c"), (8, "x" * 60_000, "en", "c"), (9, "one", "en", "a"), (10, "日本 語 é", "ja", "b")]
    return [(i, t, lang, s, 1, 2, 3, "x", "y", 4) for i, t, lang, s in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_edge_cases(spark, tmp_path, name):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = edge_rows()
    docs = spark.createDataFrame(rows, EDGE)
    labels = spark.createDataFrame([(1, 0, 0), (9, 0, 1), (None, 1, 1), (10, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, docs, str(tmp_path)).collect()
    ids = collections.Counter(r.doc_id for r in got)
    every = collections.Counter(r[0] for r in rows)
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0
    if name != "best_fit_packing":
        assert none.columns == docs.columns and all(tuple(r) in set(rows) for r in got)
    if name == "toxicity":
        assert all(ids[i] in (0, every[i]) for i in every)
    elif name == "exact_dedup":  # a trailing space tells 1 and 2 apart; null and empty texts are one
        assert ids == collections.Counter([1, 2, 3, 4, 6, None, 7, 8, 9, 10])
    elif name == "ngram_jaccard_join":
        assert all(ids[i] == every[i] for i in (4, 5, 6, 8, 9, 10)) and ids[1] == 1 and not {2, 3, 7} & set(ids) and ids[None] == 2
    elif name == "mix_sources":
        assert not {4, 5, 6} & set(ids) and all(n <= 3 * every[i] for i, n in ids.items())
    else:
        assert collections.Counter(r.doc_id for r in got if r.piece == 0) == every
        assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)


def test_stages_of_no_labels(spark, tmp_path):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
