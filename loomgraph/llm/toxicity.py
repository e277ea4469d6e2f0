"""Toxicity: a linear character n-gram classifier over naive-Bayes scaled features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._shared import same_text, ship
from loomgraph.llm._words import BYTE_BASE, BYTE_VALUE, IS_SPACE, LOWER, U64, buffers, chunks, distinct, inverse, mix, powers

#: Character n-grams of the lower-cased text (A-Z); white space counts as one space each.
ORDERS = (4, 5, 6, 7)
#: Labelled rows of either class that training reads at most.
TRAIN_ROWS = 2500
#: Features of a model at most: those whose counts weigh most.
FEATURES = 40_000
TABLE_BITS = 22
#: Numbers that training handles at once, which bounds its memory.
STEP = 1 << 18

VALUE = BYTE_VALUE[np.where(IS_SPACE, 32, LOWER)]


def gram_hashes(data: np.ndarray):
    """For each order (hashes, starts, ends) of the runs of that many characters, by bytes of the UTF-8 ``data``."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUE[data] * powers(BYTE_BASE, n), out=total[1:])
    back = powers(inverse(BYTE_BASE), n + 1)
    at = np.arange(n + 1) if n == 0 or data.max() < 128 else np.r_[np.flatnonzero((data & 0xC0) != 0x80), n]
    if len(at) <= n:
        total, back = total[at], back[at]
    for k in ORDERS:
        m = max(0, len(at) - k)
        yield mix((total[k : k + m] - total[:m]) * back[:m], k), at[:m], at[k : k + m]


@dataclass
class Model:
    """``hashes`` (sorted), the weights (log-count ratio times coefficient) and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> U64(64 - TABLE_BITS)).astype(np.int64)] = True

    def features(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, once each, of consecutive texts: a feature is present or not."""
        out = []
        for h, first, end in gram_hashes(data):
            at = np.flatnonzero(self.table[(h >> U64(64 - TABLE_BITS)).astype(np.int64)])
            if len(at):
                f = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                text = np.searchsorted(bounds, first[at], side="right") - 1
                ok = (self.hashes[f] == h[at]) & (end[at] <= bounds[text + 1])
                out.append(text[ok] * len(self.hashes) + f[ok])
        pairs = distinct(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return (pairs // len(self.hashes), pairs % len(self.hashes)) if len(self.hashes) else (pairs, pairs)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = np.full(len(bounds) - 1, self.intercept)
        if len(self.hashes):
            text, f = self.features(data, bounds)
            z += np.bincount(text, self.weights[f], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_ratio(p: np.ndarray, q: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """log of the smoothed shares of the two classes' texts that hold a feature."""
    return np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))


def worth(p: np.ndarray, q: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """By which features are chosen; 0 where fewer than three texts hold one."""
    return np.abs(log_ratio(p, q, pos, neg)) * np.sqrt(p + q) * (p + q >= 3)


def choose(texts: list[bytes], labels: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log-count ratios) of the ``features`` n-grams of most worth.

    One pass counts texts by hashed cells of n-grams, another tells the n-grams
    of the promising cells apart: a cell counts for at least as many texts as
    any n-gram of a class in it, so few cells remain.
    """
    pos, neg = int(labels.sum()), int((~labels).sum())
    cells = np.zeros((2, 1 << TABLE_BITS), np.int32)

    def grams_of(t: bytes) -> np.ndarray:
        return distinct(np.concatenate([h for h, _, _ in gram_hashes(np.frombuffer(t, np.uint8))]))

    for t, y in zip(texts, labels, strict=True):  # sorted hashes have sorted cells
        c = (grams_of(t) >> U64(64 - TABLE_BITS)).astype(np.int64)
        cells[int(y), c[np.r_[True, c[1:] != c[:-1]]] if len(c) else c] += 1
    w = np.concatenate([worth(*cells[::-1, k : k + STEP], pos, neg) for k in range(0, cells.shape[1], STEP)])
    many = min(len(w), 4 * features)
    good = (w > 0) & (w >= np.partition(w, len(w) - many)[len(w) - many])
    del cells, w
    known, p, q = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list = [[], []]

    def counted(parts: list) -> tuple[np.ndarray, np.ndarray]:
        s = np.sort(np.concatenate(parts)) if parts else known[:0]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        return s[at], np.diff(np.r_[at, len(s)])

    def count() -> None:
        nonlocal known, p, q
        (a, m), (b, n) = counted(held[0]), counted(held[1])
        every = distinct(np.concatenate([known, a, b]))
        sums = np.zeros((2, len(every)), np.int64)
        for row, g, c in ((1, known, p), (0, known, q), (0, a, m), (1, b, n)):
            sums[row, np.searchsorted(every, g)] += c
        known, p, q = every, sums[1], sums[0]
        held[:] = [], []

    for t, y in zip(texts, labels, strict=True):
        g = grams_of(t)
        held[int(y)].append(g[good[(g >> U64(64 - TABLE_BITS)).astype(np.int64)]])
        if sum(map(len, held[0])) + sum(map(len, held[1])) > 4 * STEP:
            count()
    count()
    w = worth(p, q, pos, neg)
    best = np.argsort(-w, kind="stable")[:features]
    best = np.sort(best[w[best] > 0])
    return known[best], log_ratio(p, q, pos, neg)[best]


def fit(texts: list[bytes], labels: np.ndarray, features: int = FEATURES, rounds: int = 200, c: float = 1.0, tolerance: float = 1e-2) -> Model:
    """Choose the features, then weigh them by logistic regression.

    Every feature is its presence times the log-count ratio of the two classes.
    Quasi-Newton steps go on until the gradient is ``tolerance`` of the first
    one, ``rounds`` at most; all is in a fixed order, so reruns agree.
    """
    labels = np.asarray(labels, bool)
    pos, neg = int(labels.sum()), int((~labels).sum())
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((pos + 1) / (neg + 1))))
    hashes, r = choose(texts, labels, features)
    model = Model(hashes, r, 0.0)
    cols = [model.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1].astype(np.int32) for t in texts]
    row, col = np.repeat(np.arange(len(texts), dtype=np.int32), [len(f) for f in cols]), np.concatenate(cols)
    parts = [slice(k, k + STEP) for k in range(0, len(row), STEP)]

    def add(at, size, values):  # sums by row or column, a part of the pairs at a time
        out = np.zeros(size)
        for s in parts:
            out += np.bincount(at[s], values(s), minlength=size)
        return out

    y = labels.astype(float)
    share = np.where(labels, 0.5 / pos, 0.5 / neg)  # the classes weigh the same
    scale = 1.0 / max(1e-9, float(np.mean(add(row, len(texts), lambda s: r[col[s]] ** 2))))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        beta, w = x[:-1], r * x[:-1]  # a feature is its presence times the ratio
        z = x[-1] + add(row, len(texts), lambda s: w[col[s]])
        e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * share
        value = float(share @ (np.logaddexp(0, z) - y * z) + 0.5 * c * scale * (beta @ beta))
        return value, np.r_[r * add(col, len(hashes), lambda s: e[row[s]]) + c * scale * beta, e.sum()]

    x = minimise(loss, np.zeros(len(hashes) + 1), rounds, tolerance)
    return Model(hashes, x[:-1] * r, float(x[-1]))


def minimise(loss, x: np.ndarray, rounds: int, tolerance: float, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps on a convex ``loss`` (value, gradient), until the gradient is ``tolerance`` of the first."""
    value, g = loss(x)
    first, past = np.linalg.norm(g), []
    for _ in range(rounds):
        if np.linalg.norm(g) <= tolerance * first:
            break
        d, kept = -g, []
        for s, v in reversed(past):
            a = (s @ d) / (s @ v)
            d = d - a * v
            kept.append(a)
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, v), a in zip(past, reversed(kept), strict=True):
            d = d + (a - (v @ d) / (s @ v)) * s
        step, slope = 1.0 if past else 1.0 / max(1.0, first), float(g @ d)
        while True:
            new, (lower, h) = x + step * d, loss(x + step * d)
            if lower <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        if (h - g) @ (new - x) > 1e-14:
            past = [*past[1 - memory :], (new - x, h - g)]
        if step < 1e-12:
            break
        x, value, g = new, lower, h
    return x


def _fit(features: int):
    """Train in one task on the rows of the bounded sample, which come in order of l."""

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += [t.as_buffer().to_pybytes() for t in batch.column("text")]
            labels += batch.column("toxic").to_pylist()
        m = fit(texts, np.array([y == 1 for y in labels], bool), features)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((m.hashes.tobytes(), pa.binary()), (m.weights.tobytes(), pa.binary()), (m.intercept, pa.float64()))], names=["hashes", "weights", "intercept"])

    return run


def _score(model, name: str = "score", keep_text: bool = False):
    def run(batches):
        m = model.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = [m.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets)]
            score = pa.array(np.concatenate(out) if out else np.zeros(0))
            names = [k for k in batch.schema.names if keep_text or k != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), score], names=[*names, name])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents of each class, the smallest by a hash of doc_id.

    ``labels`` (doc_id, toxic); null labels and ids are left out, of conflicting
    labels the larger holds.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l")).agg(F.max("toxic").alias("toxic"))
    known = known.where(allowed)
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("l"), "l").limit(rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # At most 2 * rows ids, so the broadcast is bounded.
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), same_text("text").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("d") == F.col("l")).groupBy("l").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """A model of the bounded sample; ``allowed`` is a condition on the column l (a document's id).

    Training is one task of an executor, so texts never reach the driver: it
    gets the model, of at most ``features`` features.  Without labelled rows of
    both classes the model has no features and its intercept is their log-odds.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, allowed, rows).select("l", "toxic", F.encode("text", "UTF-8").alias("text"))
    one = sample.repartition(1).sortWithinPartitions("l").mapInArrow(_fit(features), "hashes binary, weights binary, intercept double")
    found = one.first()
    if found is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    return Model(np.frombuffer(found["hashes"], np.uint64), np.frombuffer(found["weights"], np.float64), found["intercept"])


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score 0 to 1) per row of ``docs`` (doc_id, text).

    Scores depend on the whole text alone: null and empty texts get the
    intercept's score, repeated rows equal ones, and a null doc_id stays null;
    very long texts are scored one at a time; an empty table gives an empty
    result; other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same_text("text").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, score double")


def score_documents(docs: DataFrame, model: Model, name: str = "score_") -> DataFrame:
    """``docs`` with all its columns and the score of its text as column ``name``.

    Null texts score as empty ones do and stay null, repeated rows score alike,
    an empty table stays empty; ``name`` must not be a column yet.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared, name, True), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 3, is 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
