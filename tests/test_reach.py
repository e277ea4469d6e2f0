"""Transitive counts and added cycles against plain searches."""

import random

import pytest

from loomgraph import fixtures as fx
from loomgraph.operators import graph

SF = "/root/testdata/sf0.001"


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def reach(pairs):
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)
    found = {}
    for s in out:
        seen, todo = set(), [s]
        while todo:
            for t in out.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        found[s] = seen
    return found


def counts(df):
    return {r.id: r.n_transitive for r in df.collect()}


@pytest.mark.parametrize("cyclic", [False, True])
def test_reach_counts(spark, monkeypatch, cyclic):
    monkeypatch.setattr(graph, "WORDS", 1)
    monkeypatch.setattr(graph, "BLOCKS", 2)  # 128 nodes a pass
    rng = random.Random(5)
    pairs = {(a, b) for a, b in ((rng.randrange(140), rng.randrange(140)) for _ in range(150)) if cyclic or a > b} | {(7, 7)}
    want = {s: len(x - {s}) for s, x in reach(p for p in pairs if p[0] != p[1]).items()}
    assert counts(graph.reach_counts(frame(spark, sorted(pairs)))) == want
    near = counts(graph.reach_sketch(frame(spark, sorted(pairs))))
    own = {s: len(x) for s, x in reach(p for p in pairs if p[0] != p[1]).items()}
    assert set(near) == set(own) and all(abs(near[s] - n) <= max(1, 0.05 * n) for s, n in own.items())
    assert graph.reach_counts(frame(spark, [])).collect() == []


def test_estimates_are_within_their_error(spark):
    e = fx.requires(spark, SF)
    exact, near = counts(graph.reach_counts(e)), counts(graph.reach_sketch(e))
    assert exact == {s: len(x - {s}) for s, x in reach((r.source, r.target) for r in e.collect() if r.source != r.target).items()}
    assert set(near) == set(exact) and all(abs(near[k] - n) <= max(1, 4 * 0.013 * n) for k, n in exact.items())


@pytest.mark.parametrize("seed", [0, 3])
def test_added_cycles(spark, seed):
    rng = random.Random(seed)
    order = list(range(120))
    rng.shuffle(order)
    old = {(order[a], order[b]) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(110)) if a > b}
    new = {(rng.randrange(120), rng.randrange(120)) for _ in range(2 + 3 * seed)} | {(9, 9)}
    if seed == 3:  # a cycle for sure
        a, b = next(iter(old))
        new |= {(b, a)}
    found, looked = graph.added_cycles(frame(spark, sorted(old)), frame(spark, sorted(new)))
    want = graph.new_cycles(frame(spark, sorted(old)), frame(spark, sorted(new)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and looked <= 120


def test_few_nodes_are_looked_at(spark):
    old = [(k, k - 100) for k in range(100, 600)]
    found, looked = graph.added_cycles(frame(spark, old), frame(spark, [(120, 320), (550, 230), (3000, 1)]))
    assert [tuple(r) for r in found.collect()] == [(120, 3, 1)] and looked < 20
    none, looked = graph.added_cycles(frame(spark, old), frame(spark, [(599, 0)]))
    assert none.collect() == [] and looked == 0
    with pytest.raises(ValueError):
        graph.added_cycles(frame(spark, [(1, 2), (2, 1)]), frame(spark, [(1, 3)]))
