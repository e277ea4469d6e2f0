"""Codes of vectors by a codebook for each part, trained by Elkan's form of Lloyd's rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import materialise, scrap, ship
from loomgraph.llm._vectors import integer_vectors, lists, matrix, no_lists, squared

#: Entries of a codebook at most, as a code is a byte a part.
MOST_ENTRIES = 256
#: Rows whose distances to a codebook are held at once.
ROWS = 2048
#: Share of (row, entry) pairs left by the bounds from which one product is cheaper than single pairs.
DENSE = 0.25

STATE = "vec_id bigint, label string, q array<int>, codes binary, upper array<int>, lower binary, part int, entry int, n bigint, sums array<bigint>"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def down(d: np.ndarray) -> np.ndarray:
    """floor(sqrt(d)) of whole numbers."""
    r = np.floor(np.sqrt(d))
    return (r - (r * r > d)).astype(np.int32)


def up(d: np.ndarray) -> np.ndarray:
    """ceil(sqrt(d)) of whole numbers."""
    r = np.ceil(np.sqrt(d))
    return (r + (r * r < d)).astype(np.int32)


class Codebook:
    """The entries of one part with what a round needs of them.

    ``step`` is the unit of the stored lower bounds, a byte each: rounded down
    and cut off at 255 steps they stay lower bounds.  ``move`` is how far each
    entry has moved since the bounds were stored, rounded up.
    """

    def __init__(self, entries: np.ndarray, before: Codebook | None = None):
        self.entries = entries
        gaps = squared(entries, entries)
        self.gaps = down(np.maximum(gaps, 0))
        self.step = before.step if before else max(1, int(self.gaps.max()) // 255 + 1)
        self.move = up(((entries - before.entries) ** 2).sum(1)) if before else np.zeros(len(entries), np.int32)
        others = self.gaps + np.diag(np.full(len(entries), np.iinfo(np.int32).max // 2, np.int32) - np.diag(self.gaps))
        self.nearest_other = others.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(code, upper bound, lower bounds in steps, distances computed) of rows that have no bounds yet."""
        d = squared(x, self.entries)
        code = d.argmin(1)  # of equal ones the first
        return code, up(d[np.arange(len(x)), code]), np.minimum(down(d) // self.step, 255).astype(np.uint8), d.size

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same of rows with their last code and bounds.

        An entry is left out only where a bound says that it is strictly farther
        than the row's own, so entries at equal distance are compared by their
        squared distances, which are whole numbers; the lower index wins.
        """
        code, upper = code.copy(), upper + self.move[code]
        low = np.maximum(lower.astype(np.int32) * self.step - self.move, 0)
        open_ = np.flatnonzero(self.nearest_other[code] <= 2 * upper)
        own = ((x[open_] - self.entries[code[open_]]) ** 2).sum(1)
        computed = len(open_)
        upper[open_] = up(own)
        low[open_, code[open_]] = down(own)
        still = self.nearest_other[code[open_]] <= 2 * upper[open_]
        open_, own = open_[still], own[still]
        a, u = code[open_], upper[open_][:, None]
        left = (low[open_] <= u) & (self.gaps[a] <= 2 * u)
        left[np.arange(len(a)), a] = False
        row, entry = np.nonzero(left)
        if len(row):
            if len(row) > DENSE * left.size:
                d = squared(x[open_], self.entries)[row, entry]
            else:
                d = ((x[open_[row]] - self.entries[entry]) ** 2).sum(1)
            computed += len(row)
            low[open_[row], entry] = down(d)
            key = d.astype(np.int64) * MOST_ENTRIES + entry
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            at = row[starts]
            best = np.minimum(np.minimum.reduceat(key, starts), own[at].astype(np.int64) * MOST_ENTRIES + a[at])
            code[open_[at]] = best % MOST_ENTRIES
            upper[open_[at]] = up((best // MOST_ENTRIES).astype(np.float64))
        return code, upper, np.minimum(low // self.step, 255).astype(np.uint8), computed


def coded(books: list[Codebook], q: np.ndarray, codes: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """(codes, upper bounds, lower bounds, distances computed) of rows q, in blocks of ``ROWS``; without codes from scratch."""
    parts, k, width = len(books), len(books[0].entries), books[0].entries.shape[1]
    out = np.zeros((len(q), parts), np.int64), np.zeros((len(q), parts), np.int32), np.zeros((len(q), parts, k), np.uint8)
    computed = 0
    for at in range(0, len(q), ROWS):
        s = slice(at, at + ROWS)
        for p, book in enumerate(books):
            x = q[s, p * width : (p + 1) * width]
            found = book.first(x) if codes is None else book.again(x, codes[s, p], upper[s, p], lower[s, p])
            for part, values in zip(out, found[:3]):
                part[s, p] = values
            computed += found[3]
    return *out, computed


def _fixed(column: pa.Array, n: int, width: int) -> np.ndarray:
    """The bytes of a binary column whose values are all ``width`` long."""
    return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * width : (column.offset + n) * width].reshape(n, width)


def _binary(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.uint8))])


def _round(books: list[Codebook], first: bool):
    """Per task: its rows with new codes and bounds, then a row of sums for each entry that it used."""
    parts, k, width = len(books), len(books[0].entries), books[0].entries.shape[1]

    def run(batches):
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = matrix(batch.column("q"), parts * width)
            state = (None, None, None)
            if not first:
                state = _fixed(batch.column("codes"), n, parts).astype(np.int64), matrix(batch.column("upper"), parts).astype(np.int32), _fixed(batch.column("lower"), n, parts * k).reshape(n, parts, k)
            codes, upper, lower, _ = coded(books, q, *state)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(sums[p], codes[:, p], q[:, p * width : (p + 1) * width])
            nulls = [pa.nulls(n, pa.int32())] * 2 + [pa.nulls(n, pa.int64()), no_lists(n, pa.int64())]
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("q"), _binary(codes), lists(upper), _binary(lower.reshape(n, -1)), *nulls]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)
        part, entry = np.nonzero(counts)
        if m := len(part):
            nulls = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), no_lists(m, pa.int32()), pa.nulls(m, pa.binary()), no_lists(m, pa.int32()), pa.nulls(m, pa.binary())]
            columns = [*nulls, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists(sums[part, entry].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return run


def _last(books: list[Codebook]):
    """Per row (vec_id, label, code, error) by the final codebooks."""
    parts, k, width = len(books), len(books[0].entries), books[0].entries.shape[1]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q = matrix(batch.column("q"), parts * width)
            codes, *_ = coded(books, q, _fixed(batch.column("codes"), n, parts).astype(np.int64), matrix(batch.column("upper"), parts).astype(np.int32), _fixed(batch.column("lower"), n, parts * k).reshape(n, parts, k))
            error = sum(((q[:, p * width : (p + 1) * width] - book.entries[codes[:, p]]) ** 2).sum(1) for p, book in enumerate(books))
            text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.astype(np.int64))], names=["vec_id", "label", "code", "error"])

    return run


def moved(state: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The next codebooks: floor(sum / count) of an entry's parts, unused entries as they are."""
    width = books[0].entries.shape[1]
    parts = state.where("n is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    entries = [b.entries.copy() for b in books]
    for row in parts.collect():  # a row an entry
        entries[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return [Codebook(e, b) for e, b in zip(entries, books)]


def vector_codes(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dim: int = 64) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) per kept row of ``embeddings`` (vec_id, embedding, label), and the codebooks.

    Vectors with ``dim`` components, none null, NaN or infinite, are kept, turned
    into whole numbers, floor(scale * x), and cut into ``parts``.  A part's codebook
    starts as that part of the ``entries`` smallest ids (all where there are fewer;
    null ids last, repeated ids by vector).  A round codes every part by its nearest entry
    (squared distance, ties to the lower index) and moves each entry to the floor
    of its parts' mean; then all are coded once more.  ``code`` has two hex digits
    a part, ``error`` is the squared distance from the coded vector.

    Every row keeps, a part, an upper bound of the distance from its entry and a
    lower bound of that from every entry (a byte each, so a round's table
    holds ``parts * entries`` bytes a row beside the vector).  A round is one pass
    over that table, which shifts the bounds by how far entries moved, computes
    distances only where no bound excludes the entry strictly, and writes the next
    table and a row of sums for each entry a task used.  The driver sees
    ``parts * entries`` sums, whatever the data.  Repeated rows are rows of their
    own; an empty table gives none; other columns are ignored.
    """
    if not 0 < entries <= MOST_ENTRIES or dim % parts:
        raise ValueError(f"entries must be 1 to {MOST_ENTRIES} and parts must divide dim")
    spark = embeddings.sparkSession
    ship(spark)
    kept = integer_vectors(embeddings.withColumn("label", F.col("label").cast("string")), scale, dim, "label")
    start = [r["q"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    if not start:
        return spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint"), []
    first = np.array(start, dtype=np.float64)
    width = dim // parts
    books = [Codebook(first[:, p * width : (p + 1) * width]) for p in range(parts)]
    state, before = kept, None
    for _ in range(rounds):
        rows = state if before is None else state.where("n is null").select(NAMES[:6])
        state = materialise(rows.mapInArrow(_round(books, before is None), STATE), "vector-codes")
        if before is not None:
            scrap(spark, before)
        before = state
        books = moved(state, books)
    if before is None:  # no round: code by the first codebooks
        state = materialise(kept.mapInArrow(_round(books, True), STATE), "vector-codes")
    out = materialise(state.where("n is null").select(NAMES[:6]).mapInArrow(_last(books), "vec_id bigint, label string, code string, error bigint"), "coded-vectors")
    scrap(spark, state)
    return out, [b.entries.astype(np.int64) for b in books]


def with_label_errors(coded_rows: DataFrame) -> DataFrame:
    """The rows with label_error, the sum of error over equal labels, nulls together."""
    sums = coded_rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded_rows.join(sums, F.col("label").eqNullSafe(F.col("l"))).drop("l")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e.tolist()).encode()).hexdigest()
