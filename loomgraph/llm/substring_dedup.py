"""Substring deduplication by seeds and extension over winnowed anchors."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import materialise, same_text, scrap, ship
from loomgraph.llm._words import Words, buffers, chunks, grams, mix

#: Words of an anchor. Every window of min_words words holds an anchor chosen by its own words alone.
ANCHOR_WORDS = 8
#: Seeds of one anchor that a task holds at once; larger groups are taken apart.
HOT = 20_000


def _winnow(words: Words, min_words: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, their anchors' places, hashes of anchors, hashes of windows); all by word number.

    The anchor of a window is the leftmost smallest of its gram hashes, so equal
    windows have equal anchors at equal offsets.
    """
    h = words.hashes()
    g = grams(h, anchor)
    span = min_words - anchor + 1
    sizes = np.diff(words.word_of)
    long = np.flatnonzero(sizes >= min_words)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, g, g[:0]
    counts = sizes[long] - min_words + 1
    first = np.repeat(words.word_of[long] - np.r_[0, np.cumsum(counts)[:-1]], counts)
    starts = first + np.arange(counts.sum())
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 16):
        part = starts[lo : lo + (1 << 16)]
        at[lo : lo + (1 << 16)] = part + view[part].argmin(axis=1)
    return starts, at, g, grams(h, min_words)


def _alike(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row's keys are met again, whether it is the first of them), by row."""
    order = np.lexsort(keys[::-1])
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    edges = np.flatnonzero(new)
    many, first = np.empty(len(order), bool), np.zeros(len(order), bool)
    many[order] = np.repeat(np.diff(np.r_[edges, len(order)]) > 1, np.diff(np.r_[edges, len(order)]))
    first[order[edges]] = True
    return many, first


def _own_key(rk: np.ndarray) -> np.ndarray:
    """A key that spreads rows that need not meet others."""
    return mix(rk.view(np.uint64), 0x2545F4914F6CDD1D).view(np.int64)


def _anchors(min_words: int, anchor: int):
    """Rows (k, rk, at, known) of the anchors.

    Those met again in the same batch are known as seeds; one of them goes to
    the anchor's key for all, the others to keys of their own, so a hot anchor is
    one row a batch.
    """

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys, found = batch.column("rk").to_numpy(), []
            for lo, hi in chunks(offsets):
                words = Words(data, offsets[lo : hi + 1])
                _, at, g, _ = _winnow(words, min_words, anchor)
                if len(at):
                    at = at[np.r_[True, at[1:] != at[:-1]]]  # places grow with the windows
                    text = np.searchsorted(words.word_of, at, side="right") - 1
                    found.append((g[at].view(np.int64), keys[lo + text], (at - words.word_of[text]).astype(np.int32)))
            if found:
                h, rk, at = (np.concatenate(x) for x in zip(*found, strict=True))
                known, first = _alike(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(known & ~first, _own_key(rk), h)), pa.array(rk), pa.array(at), pa.array(known)], names=["k", "rk", "at", "known"])

    return run


def _repeated(batches):
    """Of rows sorted by k, the known ones and those whose k occurs more than once; one row is carried on."""
    last, told = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        k = table.column("k").to_numpy()
        same = k[1:] == k[:-1]
        keep = np.r_[False, same] | np.r_[same, False] | table.column("known").to_numpy(zero_copy_only=False)
        if last is not None:
            keep[0] &= not told
        out = table.filter(pa.array(keep))
        if out.num_rows:
            yield out.select(["rk", "at"])
        # The last row comes again, since its run may go on; it is given out once.
        last, told = table.slice(table.num_rows - 1, 1), bool(keep[-1]) or (told and table.num_rows == 1)


ROW = "k long, rk long, at int, n int, windows binary, known boolean"


def _occurrences(min_words: int, anchor: int):
    """A row for each seed: the places and hashes of the windows that it anchors.

    Seeds that agree in all windows with another one of the same batch are
    ``known`` to repeat over their whole reach; one of them goes to the anchor's
    key for all, the others bring no windows and go to keys of their own.
    """

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys, seeds, found = batch.column("rk").to_numpy(), batch.column("seeds"), []
            for lo, hi in chunks(offsets):
                words = Words(data, offsets[lo : hi + 1])
                starts, at, g, w = _winnow(words, min_words, anchor)
                marks = np.zeros(int(words.word_of[-1]) + 1, bool)
                for k in range(lo, hi):
                    own = seeds[k].values.to_numpy() + words.word_of[k - lo]
                    marks[own[own < words.word_of[k - lo + 1]]] = True
                keep = marks[at]
                starts, at = starts[keep], at[keep]
                if not len(starts):
                    continue
                edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                text = np.searchsorted(words.word_of, starts[edge], side="right") - 1
                found.append((g[at[edge]].view(np.int64), keys[lo + text], (starts[edge] - words.word_of[text]).astype(np.int32), np.diff(np.r_[edge, len(starts)]).astype(np.int32), w[starts]))
            if not found:
                continue
            h, rk, first_at, n, flat = (np.concatenate(x) for x in zip(*found, strict=True))
            edge = np.r_[0, np.cumsum(n)]
            known, first = _alike(h, np.add.reduceat(mix(flat, 0x9FB21C651E98DF25), edge[:-1]), n)
            plain = ~known | first
            flat = flat[np.repeat(plain, n)]
            ends = np.r_[0, np.cumsum(np.where(plain, n, 0))].astype(np.int32) * 8
            windows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.where(plain, h, _own_key(rk))), pa.array(rk), pa.array(first_at), pa.array(n), windows, pa.array(known)], names=["k", "rk", "at", "n", "windows", "known"])

    return run


FOUND = "k long, rk long, start int, stop int, kind int"
FINAL, OPEN, MARK = 0, 1, 2


def _match(min_words: int, hot: int):
    """Rows sorted by anchor: how far each seed extends both ways in common with another seed of its anchor.

    Windows are compared inside one anchor's group, so a match is equal in the
    anchor and in all words around it.  Of each seed the maximal runs of windows
    that repeat come out as FINAL spans.  A group of more than ``hot`` rows is not
    held: its windows come out one by one as OPEN, to be met by their own hashes
    (MARK stands for windows whose spans are out).
    """

    def load(batch) -> dict[str, np.ndarray]:
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("k", "rk", "at", "n", "known")}
        data, offsets = buffers(batch.column("windows"))
        c["held"] = np.diff(offsets) // 8
        c["flat"] = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64)
        return c

    def cut(c, lo: int, hi: int) -> dict[str, np.ndarray]:
        edge = np.r_[0, np.cumsum(c["held"])]
        return {k: v[edge[lo] : edge[hi]] if k == "flat" else v[lo:hi] for k, v in c.items()}

    def rows(k, rk, start, stop, kind: int):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(k, len(rk)).astype(np.int64)), pa.array(rk), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(np.full(len(rk), kind, np.int32))], names=["k", "rk", "start", "stop", "kind"])

    def whole(c):
        """Known seeds without windows: the whole reach."""
        own = c["held"] == 0
        if own.any():
            yield rows(0, c["rk"][own], c["at"][own], c["at"][own] + c["n"][own] + min_words - 1, FINAL)

    def twice(c, group) -> np.ndarray:
        """By window, whether its group has it again."""
        order = np.argsort(c["flat"], kind="stable")  # groups stay in order among equal windows
        w, g = c["flat"][order], group[order]
        same = (w[1:] == w[:-1]) & (g[1:] == g[:-1])
        out = np.empty(len(w), bool)
        out[order] = np.r_[False, same] | np.r_[same, False] if len(w) else out
        return out

    def settle(c):
        yield from whole(c)
        if not len(c["flat"]):
            return
        row = np.repeat(np.arange(len(c["k"])), c["held"])
        group = np.cumsum(np.r_[False, c["k"][1:] != c["k"][:-1]])[row]
        good = twice(c, group) | c["known"][row]
        place = np.arange(len(row)) - (np.cumsum(c["held"]) - c["held"])[row]
        joined = good[1:] & good[:-1] & (row[1:] == row[:-1])
        first, last = np.flatnonzero(good & ~np.r_[False, joined]), np.flatnonzero(good & ~np.r_[joined, False])
        if len(first):
            at = c["at"][row[first]]
            yield rows(0, c["rk"][row[first]], at + place[first], at + place[last] + min_words, FINAL)

    def spread(c):
        yield from whole(c)
        if not len(c["flat"]):
            return
        row = np.repeat(np.arange(len(c["k"])), c["held"])
        start = c["at"][row] + np.arange(len(row)) - (np.cumsum(c["held"]) - c["held"])[row]
        many, first = _alike(c["flat"])
        out = many | c["known"][row]
        w, rk = c["flat"].view(np.int64), c["rk"][row]
        for pick, kind in ((out, FINAL), (out & first, MARK), (~out, OPEN)):
            if pick.any():
                yield rows(w[pick], rk[pick], start[pick], start[pick] + min_words, kind)

    def run(batches):
        held, size, hot_key = [], 0, None

        def joined(parts):
            return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            c = load(batch)
            if hot_key is not None:
                n = int(np.searchsorted(c["k"], hot_key, side="right"))
                yield from spread(cut(c, 0, n))
                if n == len(c["k"]):
                    continue
                c, hot_key = cut(c, n, len(c["k"])), None
            held.append(c)
            size += len(c["k"])
            if size <= hot:
                continue
            c = joined(held)
            n = int(np.searchsorted(c["k"], c["k"][-1], side="left"))
            yield from settle(cut(c, 0, n))
            c = cut(c, n, len(c["k"]))
            held, size = [c], len(c["k"])
            if size > hot:
                yield from spread(c)
                held, size, hot_key = [], 0, c["k"][-1]
        if held:
            yield from settle(joined(held))

    return run


def _meet(batches):
    """Of OPEN and MARK rows sorted by k, the OPEN ones whose k occurs more than once."""
    last, told = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        k = table.column("k").to_numpy()
        same = k[1:] == k[:-1]
        keep = (np.r_[False, same] | np.r_[same, False]) & (table.column("kind").to_numpy() == OPEN)
        if last is not None:
            keep[0] &= not told
        out = table.filter(pa.array(keep))
        if out.num_rows:
            yield out.select(["rk", "start", "stop"])
        last, told = table.slice(table.num_rows - 1, 1), bool(keep[-1]) or (told and table.num_rows == 1)


SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def _remove():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts, repeats = batch.column("text"), batch.column("repeats")
            total, gone, spans, kept = [], [], [], []
            for k in range(batch.num_rows):
                words = texts[k].as_py().encode().split()
                total.append(len(words))
                if not repeats[k].is_valid:
                    gone.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                own = repeats[k].values
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, own.field("start").to_numpy(), 1)
                np.add.at(step, own.field("stop").to_numpy(), -1)
                stay = np.cumsum(step[:-1]) == 0
                turn = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
                gone.append(int((~stay).sum()))
                spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
                kept.append(b" ".join(compress(words, stay.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50, anchor_words: int = ANCHOR_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) per row of ``docs`` (doc_id, text).

    Removes each word that a window of ``min_words`` words covers whose word
    sequence also starts anywhere else, in the same document or another.
    ``spans`` are the maximal covered runs, as word numbers from 0, end
    exclusive; ``kept_text`` is the kept words joined by one space.

    Seeds: winnowed anchors (the smallest gram hash of each window) that occur
    more than once.  Extension: documents are joined on their seeds, and each
    seed's reach to the left and right, as far as a window holds it, is compared
    with that of the other seeds of its anchor; its maximal repeats are kept.  No
    pairs are formed: a group is settled by one sort.  Seeds that agree within a
    batch are one row of their group, and a group of more than ``hot`` rows is
    taken apart into windows that meet by their own hashes, so no task holds or
    gets all of a hot passage.

    Null and blank texts have no words, a null doc_id stays null.  Repeated rows
    repeat their windows, so both lose them.  Texts under min_words words keep
    all; very long ones are read whole.  An empty table gives an empty result;
    other columns are ignored.
    """
    if not 0 < anchor_words <= min_words:
        raise ValueError("anchor_words must be between 1 and min_words")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same_text("text").alias("text"))
    rows = rows.withColumn("rk", F.xxhash64("doc_id", "text"))
    keyed = rows.select("text", "rk")
    anchors = keyed.mapInArrow(_anchors(min_words, anchor_words), "k long, rk long, at int, known boolean")
    seeds = anchors.repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_repeated, "rk long, at int")
    seeds = materialise(seeds.groupBy("rk").agg(F.collect_set("at").alias("seeds")), "seeds")
    scrap(spark)
    occurrences = keyed.join(seeds.hint("shuffle_hash"), "rk").mapInArrow(_occurrences(min_words, anchor_words), ROW)
    matched = occurrences.repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_match(min_words, hot), FOUND)
    found = materialise(matched, "matches")
    scrap(spark, seeds)
    more = found.where(F.col("kind") != FINAL).repartition(F.col("k")).sortWithinPartitions("k").mapInArrow(_meet, "rk long, start int, stop int")
    spans = found.where(F.col("kind") == FINAL).select("rk", "start", "stop").unionByName(more)
    repeats = materialise(spans.groupBy("rk").agg(F.collect_set(F.struct("start", "stop")).alias("repeats")), "repeats")
    scrap(spark, found)
    marked = rows.join(repeats.hint("shuffle_hash"), "rk", "left").select("doc_id", "text", "repeats")
    return marked.mapInArrow(_remove(), SPANS)
