"""Chat formatting, sort-means and vector codes on hand-made rows, against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from loomgraph.llm import chat_format, sort_means, vector_codes

TURNS = [
    (1, 1, "user", "a<|b"), (1, 0, "user", r"<\|im_next|>x<"), (1, 2, "assistant", "|>é 日本"), (1, 3, "assistant", ""), (1, 3, "assistant", None), (1, 4, "user", "<|im_end|>\n<|im_start|>assistant\nno"),
    (2, 0, None, None), (None, 1, "a\n<|b +%", " + %"), (None, None, "assistant", "null turn"), (3, 5, "assistant", "<<||<|im_end|>\n"), (3, None, "x", "q\\"), (3, 5, "assistant", "<<||<|im_end|>\n"),
    (4, 0, "user", "y" * 200_000), (4, 1, "assistant", "ü" * 100_001), *[(5, k, "assistant" if k % 5 else "user", f"turn {k} <\\\\|") for k in range(300)], *[(6, 7, "assistant", "tie")] * 130,
]


def chats(spark, rows=TURNS):
    return spark.createDataFrame([(*r, "t", 0, "b") for r in rows], "conv_id long, turn long, role string, text string, turns string, part int, formatted string").repartition(3)


def told(rows):
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}


@pytest.mark.parametrize("most_turns", [4096, 100, 1])
def test_chats_come_back_whole(spark, monkeypatch, most_turns):
    monkeypatch.setattr(chat_format, "LONG_TURNS", most_turns)
    formatted = chat_format.format_chats(chats(spark)).cache()
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    want = told(TURNS)
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == want
    assert {c: r.loss_texts for c, r in back.items()} == {c: [t for role, t in x if role == "assistant"] for c, x in want.items()}
    for r in formatted.collect():
        roles = [role for role, _ in want[r.conv_id]]
        runs = 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert r.formatted.count(chat_format.OPEN) == r.formatted.count(chat_format.CLOSE) == runs
        assert r.formatted.count(chat_format.NEXT) == len(roles) - runs
        assert r.formatted.count("<|") == len(re.findall(r"<\|im_(start|end|next)\|>", r.formatted))
        assert back[r.conv_id].formatted_chars == len(r.formatted)


def test_chats_take_any_path_alike(spark, monkeypatch):
    found = []
    for most in (4096, 2):
        monkeypatch.setattr(chat_format, "LONG_TURNS", most)
        found.append(sorted(map(repr, chat_format.format_chats(chats(spark)).collect())))
    assert found[0] == found[1]
    assert chat_format.format_chats(chats(spark, [])).collect() == []


def test_chats_stay_in_the_jvm(spark):
    plan = chat_format.format_chats(chats(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def vectors(n, dim, seed=0, spread=0.2, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, dim)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    rows += [(n + k, rows[0][1], 1) for k in range(copies)]
    bad = rows[1][1]
    return rows + [(rows[2][0], rows[2][1], 2), (None, rows[3][1], None), (9001, None, 0), (9002, [None] + bad[1:], 0), (9003, [float("nan")] + bad[1:], 0), (9004, [float("-inf")] + bad[1:], 1), (9005, bad[1:], 1), (9006, [], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, [1], 2, 3, "c") for r in rows], "vec_id long, embedding array<float>, label int, q array<int>, cluster int, n long, codes string").repartition(3)


def kept(rows, scale, dim):
    good = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in good]


def lloyd(points, centers, rounds):
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        of = [near(v)[1] for v in points]
        for j in range(len(centers)):
            if own := [v for v, c in zip(points, of) if c == j]:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    return [near(v) for v in points], centers


@pytest.mark.parametrize(("n", "k", "spread", "scale"), [(120, 9, 0.2, 256), (120, 9, 0.01, 256), (60, 12, 0.5, 3), (5, 40, 0.2, 256)])
def test_sort_means(spark, n, k, spread, scale):
    rows = vectors(n, 4, spread=spread, copies=40)
    points = kept(rows, scale, 4)
    first = sorted(points, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    found, centers = lloyd([q for _, q, _ in points], [q for _, q, _ in first], 3)
    inertia = collections.Counter()
    for d, c in found:
        inertia[c] += d
    want = [(i, c, d, inertia[c], sum(inertia.values()), ",".join(map(str, centers[c]))) for (i, *_), (d, c) in zip(points, found)]
    got = sort_means.sort_means(frame(spark, rows), k=k, rounds=3, scale=scale, dim=4).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sort_means_of_nothing(spark):
    assert sort_means.sort_means(frame(spark, []), dim=4).collect() == []
    assert sort_means.sort_means(frame(spark, [(9005, [1.0], 1)]), dim=4).collect() == []
    with pytest.raises(ValueError):
        sort_means.sort_means(frame(spark, []), k=0)
    with pytest.raises(Exception, match="too large"):
        sort_means.sort_means(frame(spark, [(1, [1e30] * 4, 1)]), dim=4).collect()


def test_sort_means_scans_end_early_and_keep_ties():
    rng = np.random.default_rng(3)
    centers = np.floor(rng.normal(0, 300, (30, 2)))
    centers[7] = centers[3]
    x = np.repeat(centers, 20, axis=0) + np.floor(rng.normal(0, 9, (600, 2)))
    x[:50] = centers[7]
    order, gaps = sort_means.ordered(centers)
    all_ = ((x[:, None] - centers) ** 2).sum(2)
    for previous in (np.zeros(600, int), all_.argmin(1), rng.integers(0, 30, 600)):
        number, d = sort_means.nearest(x, previous, centers, order, gaps)
        assert (number == all_.argmin(1)).all() and (d == all_.min(1)).all()
    d = ((x - centers[all_.argmin(1)]) ** 2).sum(1)
    scanned = sum((gaps[a] <= 4 * y).sum() for a, y in zip(all_.argmin(1), d))
    assert scanned < 0.2 * 600 * 29


@pytest.mark.parametrize(("n", "entries", "spread", "scale"), [(150, 16, 0.2, 1024), (150, 16, 0.002, 1024), (90, 20, 1.0, 2), (5, 256, 0.2, 1024)])
def test_vector_codes(spark, n, entries, spread, scale):
    rows = vectors(n, 8, seed=1, spread=spread, copies=50)
    points = kept(rows, scale, 8)
    first = sorted(points, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    parts, books = [], []
    for p in range(4):
        found, centers = lloyd([q[2 * p : 2 * p + 2] for _, q, _ in points], [q[2 * p : 2 * p + 2] for _, q, _ in first], 4)
        parts.append(found)
        books.append(centers)
    got, own_books = vector_codes.vector_codes(frame(spark, rows), entries=entries, scale=scale, dim=8)
    assert [b.tolist() for b in own_books] == books
    error = [sum(f[k][0] for f in parts) for k in range(len(points))]
    by = collections.Counter()
    for (_, _, label), e in zip(points, error):
        by[label] += e
    want = [(i, None if label is None else str(label), "".join(f"{f[k][1]:02x}" for f in parts), error[k], by[label]) for k, (i, _, label) in enumerate(points)]
    assert sorted(map(repr, map(tuple, vector_codes.with_label_errors(got).collect()))) == sorted(map(repr, want))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert vector_codes.codebooks_sha256(own_books) == digest


def test_vector_codes_of_nothing(spark):
    rows, books = vector_codes.vector_codes(frame(spark, [(1, None, 1)]), dim=8)
    assert rows.collect() == [] and books == [] and vector_codes.with_label_errors(rows).collect() == []
    for bad in ({"entries": 257}, {"parts": 3}):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(frame(spark, []), **bad)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_exclude_strictly_farther_entries_alone(seed):
    rng = np.random.default_rng(seed)
    entries = np.floor(rng.normal(0, 200, (64, 4)))
    entries[9] = entries[5]
    x = np.floor(np.repeat(entries, 40, axis=0) + rng.normal(0, 8, (2560, 4)))
    book = vector_codes.Codebook(entries)
    state, computed = None, []
    for _ in range(5):
        codes, upper, lower, n = vector_codes.coded([book], x, *(state or (None, None, None)))
        d = ((x[:, None] - book.entries) ** 2).sum(2)
        assert (codes[:, 0] == d.argmin(1)).all()
        assert (upper[:, 0] >= np.sqrt(d.min(1))).all() and (lower[:, 0].astype(int) * book.step <= np.sqrt(d)).all()
        state = codes, upper, lower
        computed.append(n)
        moved = book.entries.copy()
        for c in np.unique(codes):
            moved[c] = np.floor(x[codes[:, 0] == c].mean(0))
        book = vector_codes.Codebook(moved, book)
    assert computed[0] == 2560 * 64 and max(computed[1:]) < 0.5 * computed[0]
