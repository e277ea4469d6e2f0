"""Models behind an interface: embeddings, inferred relations, nested redaction."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomgraph.sources import models
from loomgraph.streaming import telemetry


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def lengths(dim):
    def run(texts):
        assert sum(len(t.encode()) for t in texts) <= 40 or len(texts) == 1
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])[:, :dim]

    return run


TEXTS = ["a b a", "", None, "x" * 90, "é" * 30, "banana", "a"]


def frame(spark):
    return spark.createDataFrame([(k, t, "extra") for k, t in enumerate(TEXTS)], "id long, text string, model string").repartition(3)


def test_embeddings(spark):
    got = {r.id: r.vector for r in models.embed(frame(spark), 3, lengths, batch_bytes=40).collect()}
    for k, t in enumerate(TEXTS):
        v = np.array([len(t or ""), (t or "").count("a"), 1.0])
        assert np.allclose(got[k], v / np.linalg.norm(v))
    a, b = ({r.id: r.vector for r in models.embed(frame(spark), 16, batch_bytes=n).collect()} for n in (1, 1 << 20))
    assert a == b and not any(a[1]) and not any(a[2]) and all(len(v) == 16 for v in a.values())
    with pytest.raises(ValueError, match="no backend"):
        models.embed(frame(spark), 3, "other")
    with pytest.raises(Exception, match="not .*4"):
        models.embed(frame(spark), 4, lengths, batch_bytes=40).collect()
    assert models.embed(frame(spark).limit(0), 3).collect() == []


def test_runs_of_texts():
    texts = ["aa", "b", "", "cccccc", "dd"]
    assert [texts[s] for s in models.by_bytes(texts, 3)] == [["aa", "b", ""], ["cccccc"], ["dd"]] and list(models.by_bytes([], 3)) == []


def answer(prompts):
    """A service that fails on batches with a bad prompt, and always on bad ones."""
    if any("bad" in p for p in prompts):
        raise RuntimeError("down")
    if len(prompts) > 1 and any("short" in p for p in prompts):
        return ["too few"]
    out = []
    for p in prompts:
        uid = p.split()[1]
        whole = {"topology_map": {uid: {"relations": [{"target_uid": "t", "edge_type": "requires", "confidence": 0.9}, {"target_uid": "u", "edge_type": "requires", "confidence": 0.2}]}}}
        out.append("{not json" if "broken" in p else json.dumps({"other": 1}) if "empty" in p else json.dumps(whole))
    return out


def test_relations_fall_back_to_hints(spark):
    kinds = ["good", "bad", "broken", "empty", "short", "good"]
    rows = [(f"s{k}", f"{kind} s{k}", {"requires": [f"h{k}"]}) for k, kind in enumerate(kinds)] + [("s9", "bad s9", None)]
    skills = spark.createDataFrame(rows, "uid string, prompt string, hints struct<requires:array<string>,conflicts_with:array<string>,enhances:array<string>,substitutes:array<string>>").coalesce(1)
    asked = {r.uid: r for r in models.ask(skills.drop("hints"), answer, tries=2, batch=3, pause=0).collect()}
    assert len(asked) == 7 and asked["s1"].error == "RuntimeError: down" and asked["s1"].attempts == 2 and asked["s0"].attempts == 1
    found, errors = models.infer_relations(skills, answer, tries=2, batch=3, pause=0)
    got = sorted((r.source, r.target, r.confidence, r.origin) for r in found.collect())
    assert got == [("s0", "t", 0.9, "inferred"), ("s1", "h1", 1.0, "declared"), ("s2", "h2", 1.0, "declared"), ("s3", "h3", 1.0, "declared"), ("s4", "t", 0.9, "inferred"), ("s5", "t", 0.9, "inferred")]
    assert {r.uid: r.error for r in errors.collect()} == {"s1": "RuntimeError: down", "s2": "not a topology map", "s3": "not a topology map", "s9": "RuntimeError: down"}
    found, errors = models.infer_relations(skills, None)
    assert {r.origin for r in found.collect()} == {"declared"} and errors.count() == 7


def test_nested_redaction(spark):
    cases = ['{"a":{"b":{"c":{"api_key":{"x":1}}}},"max_tokens":3}', '{"Token":null}', '[{"token":1}]', "not json", None, '"text"', '{"n":1.5,"é":"日"}']
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id long, body string")
    got = {r.id: r.out for r in rows.select("id", telemetry.redacted("body").alias("out")).collect()}
    assert got == {0: '{"a":{"b":{"c":{"api_key":"[FILTERED]"}}},"max_tokens":3}', 1: '{"Token":"[FILTERED]"}', 2: '[{"token":1}]', 3: "not json", 4: None, 5: '"text"', 6: '{"n":1.5,"é":"日"}'}
    typed = rows.where("id = 0").select(F.parse_json(telemetry.redacted("body")).alias("v")).select(F.variant_get("v", "$.max_tokens", "int").alias("n"))
    assert typed.first().n == 3
