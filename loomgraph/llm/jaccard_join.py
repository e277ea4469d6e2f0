"""N-gram Jaccard similarity join by prefix filters under several token orders."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import materialise, scrap, ship
from loomgraph.llm._words import U64, Words, buffers, chunks, distinct, grams, mix
from loomgraph.llm.components import connected_components

#: Counters of the frequency sketch that fixes the first order: 2**20, whatever the input.
SKETCH_BITS = 20
SLOTS = 64
#: Rows of one token that a task pairs with each other at once.
CELL = 4096


def shingle_sets(column, n: int):
    """Yield (row, sorted distinct 64-bit shingles) of every text, in order; lower-cases A-Z.

    A text of fewer than n words has its whole sequence as its one shingle, one
    without words has none.
    """
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets):
        words = Words(data, offsets[lo : hi + 1], fold=True)
        h = words.hashes()
        g = grams(h, n)
        for k in range(hi - lo):
            a, b = words.word_of[k], words.word_of[k + 1]
            if b - a >= n:
                yield lo + k, distinct(g[a : b - n + 1])
            elif b > a:
                yield lo + k, grams(h[a:b], int(b - a))
            else:
                yield lo + k, h[:0]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set: a mixed sum over its members and its size."""
    total = mix(mix(s, 0x1F83D9ABFB41BD6B).sum(keepdims=True), len(s))
    return int(total.view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _measure(n: int):
    """Per document its key, set size and set id."""

    def run(batches):
        for batch in batches:
            sizes, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, s in shingle_sets(batch.column("text"), n):
                sizes[k], ids[k] = len(s), set_id(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(sizes), pa.array(ids)], names=["doc_id", "tk", "n", "sid"])

    return run


def _frequencies(n: int):
    """Per task the document frequencies by sketch slot, deflated."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            held, rows = [], 0
            for _, s in shingle_sets(batch.column("text"), n):
                held.append((s >> U64(64 - SKETCH_BITS)).astype(np.int64))
                rows += len(s)
                if rows > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, rows = [], 0
            if rows:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
        if counts.any():
            blobs = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(counts, SLOTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array(blobs, pa.binary())], names=["slot", "counts"])

    return run


def _sum_slots(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, blob in zip(batch.column("slot").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32)
            total[slot] = total.get(slot, 0) + part.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slot", "counts"])


def token_levels(keyed: DataFrame, n: int) -> np.ndarray:
    """The logarithm of the document frequency of each sketch slot, over all of ``keyed`` (text)."""
    parts = keyed.select("text").mapInArrow(_frequencies(n), "slot int, counts binary").repartition(F.col("slot"))
    counts = np.ones(1 << SKETCH_BITS, dtype=np.int64)
    width = len(counts) // SLOTS
    for slot, blob in parts.mapInArrow(_sum_slots, "slot int, counts binary").collect():  # 2**20 counters
        counts[slot * width : (slot + 1) * width] += np.frombuffer(blob, np.int64)
    return np.minimum(8 * np.log2(counts), 255).astype(np.uint8)


def _prefixes(n: int, percent: int, level):
    """Rows (token, sid, n, r) of the prefix of each set, under the rarest-first order.

    r: tokens from this one on.  A set met again in the same task is left out:
    its rows would be the same.
    """

    def run(batches):
        levels = level.value
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, s in shingle_sets(batch.column("text"), n):
                if not len(s) or (own := set_id(s)) in seen:
                    continue
                seen.add(own)
                if len(seen) > 1 << 20:
                    seen.clear()
                size, keep = len(s), prefix_length(len(s), percent)
                rank = (levels[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U64(56)) | (s >> U64(8))
                first = s[np.argsort(rank, kind="stable")[:keep]]
                for column, x in zip(out, (first.view(np.int64), np.full(keep, own), np.full(keep, size, np.int32), np.arange(size, size - keep, -1, dtype=np.int32)), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "sid", "n", "r"])

    return run


def _caps(n: np.ndarray, r: np.ndarray, percent: int) -> np.ndarray:
    """The largest partner size with which a first common token at this place leaves enough overlap.

    A pair of sizes n, m needs an overlap of percent * (n + m) / (100 + percent),
    and has at most r from its first common token on.
    """
    return ((100 + percent) * r.astype(np.int64) - percent * n) // percent


def _buckets(percent: int):
    """Read rows sorted by (token, n, sid), write one partner a row and the rows whose bucket has partners.

    Partners: of the earlier rows whose cap admits this row, and which this
    row's cap admits, that with the largest cap.  Of earlier rows only the
    running maxima of the cap matter, so that is all that is carried on.
    """

    def run(batches):
        names = ["token", "sid", "n", "r", "other"]
        carry = {k: np.zeros(0, np.int64) for k in ("token", "sid", "n", "r")}
        for batch in batches:
            new = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in carry}
            rows = {k: np.concatenate([carry[k], new[k]]) for k in carry}
            fresh = np.arange(len(rows["token"])) >= len(carry["token"])
            repeat = np.zeros(len(fresh), bool)  # the same set, from another task
            repeat[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["sid"][1:] == rows["sid"][:-1])
            rows, fresh = {k: v[~repeat] for k, v in rows.items()}, fresh[~repeat]
            edges = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1], True])
            caps = _caps(rows["n"], rows["r"], percent)
            found: list[list] = [[], [], [], [], []]
            for a, b in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1], strict=True):
                n, cap, sid = rows["n"][a:b], caps[a:b], rows["sid"][a:b]
                top = np.maximum.accumulate(cap)
                at = np.maximum.accumulate(np.where(np.r_[True, cap[1:] > top[:-1]], np.arange(b - a), 0))
                last = np.minimum(np.searchsorted(n, cap, side="right"), np.arange(b - a)) - 1
                ok = fresh[a:b] & (last >= 0)
                ok[ok] = top[last[ok]] >= n[ok]
                # Every row of a bucket goes on: a later round compares those that this one leaves apart.
                other = np.where(ok, sid[at[np.maximum(last, 0)]], sid)
                for column, x in zip(found, (rows["token"][a:b], sid, n, rows["r"][a:b], other), strict=True):
                    column.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=names)
            if len(edges) > 1:
                a = edges[-2]
                cap = caps[a:]
                keep = np.r_[True, cap[1:] > np.maximum.accumulate(cap)[:-1]]
                keep[-1] = True  # its set may come again
                carry = {k: v[a:][keep] for k, v in rows.items()}

    return run


def _apart(percent: int):
    """Rows sorted by (token, i, j, own): every pair of a cell that the caps admit and whose labels differ.

    A cell holds the rows of parts i and j of one token's bucket and pairs those
    of i with those of j (each with the rows before it where i is j), a bounded
    number of pairs at a time.
    """
    names = ("token", "i", "j", "own", "n", "r", "sid", "label")

    def pairs(c: dict[str, np.ndarray]):
        rows = np.arange(len(c["n"]))
        edges = np.flatnonzero(np.r_[True, (c["token"][1:] != c["token"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])])
        size = np.diff(np.r_[edges, len(rows)])
        start = np.repeat(edges, size)
        firsts = np.repeat(np.add.reduceat((c["own"] == c["i"]).astype(np.int64), edges), size)
        stop = np.where(c["i"] == c["j"], rows, np.where(c["own"] == c["j"], start + firsts, start))
        mixed = np.repeat(np.minimum.reduceat(c["label"], edges) < np.maximum.reduceat(c["label"], edges), size)
        count = np.where(mixed, stop - start, 0)
        total, cap, at = np.cumsum(count), _caps(c["n"], c["r"], percent), 0
        while at < len(rows):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + (1 << 20), side="right")))
            own = count[at:to]
            x = np.repeat(rows[at:to], own)
            y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + start[x]
            ok = (c["n"][y] <= cap[x]) & (cap[y] >= c["n"][x]) & (c["label"][y] != c["label"][x])
            a, b = c["sid"][x[ok]], c["sid"][y[ok]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            at = to

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {k: batch.column(k).to_numpy().astype(np.int64) for k in names}
            c = {k: np.concatenate([held[k], new[k]]) for k in names} if held else new
            if not len(c["n"]):
                continue
            same = (c["token"] == c["token"][-1]) & (c["i"] == c["i"][-1]) & (c["j"] == c["j"][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last cell may go on
            if last:
                yield from pairs({k: v[:last] for k, v in c.items()})
            held = {k: v[last:] for k, v in c.items()}
        if held and len(held["n"]):
            yield from pairs(held)

    return run


def apart(named: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """(a, b): the admissible pairs of ``named`` (token, sid, n, r, label) rows of one token whose labels differ.

    A token met by more than ``cell`` rows is cut into parts by a hash of the
    set, and each pair of parts is a cell of its own, so no task holds a whole
    hot bucket.
    """
    tokens = named.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rows = named.join(materialise(tokens.select("t", "c"), "mixed-tokens"), F.col("token") == F.col("t"))
    parts = F.ceil(F.col("c") / cell).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("token", "sid", "n", "r", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sorted_rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "own")
    return sorted_rows.mapInArrow(_apart(percent), "a long, b long").distinct()


def _signatures(n: int, percent: int, orders: int):
    """(sid, marks) of each set: its size and its prefixes under the hashed orders, as sorted 32-bit ranks."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sids, blobs = [], []
            for _, s in shingle_sets(batch.column("text"), n):
                if not len(s) or (own := set_id(s)) in seen:
                    continue
                seen.add(own)
                if len(seen) > 1 << 20:
                    seen.clear()
                k = prefix_length(len(s), percent)
                ranks = [np.sort(x if k >= len(x) else np.partition(x, k - 1)[:k]) >> U64(32) for x in (mix(s, order) for order in range(1, orders))]
                sids.append(own)
                blobs.append(np.concatenate([[len(s)], *ranks]).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], names=["sid", "marks"])

    return run


def may_link(n: int, m: int, p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether sets of sizes n and m can link, going by their sorted prefixes p and q under one order.

    They must share a token.  Below the end of the shorter prefix both are
    complete, so the tokens shared there and the rest of the smaller remainder
    bound the overlap.  Equal tokens have equal ranks: two that share a rank only
    let more pairs pass.
    """
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    same = q[at] == p
    if not same.any():
        return False
    end = min(p[-1], q[-1])
    i, j = int(np.searchsorted(p, end)), int(np.searchsorted(q, end))
    most = int(same[:i].sum()) + min(n - i, m - j)
    return 100 * most >= percent * (n + m - most)


def _meet(percent: int, orders: int):
    """Of pairs with the marks of both sets, those that may link under every hashed order."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                keep[row] = all(may_link(int(s[0]), int(t[0]), p, q, percent) for p, q in zip(np.split(s[1:], orders - 1), np.split(t[1:], orders - 1), strict=True))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sids, blobs, seen = [], [], set()
            for _, s in shingle_sets(batch.column("text"), n):
                if (own := set_id(s)) not in seen:
                    seen.add(own)
                    sids.append(own)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], names=["sid", "tokens"])

    return run


def _verify(percent: int):
    """Of pairs with both sets, those whose sizes make a link."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                keep[row] = 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both sets, as x and y; ``table`` is a written one, dealt once."""
    x = table.select(F.col("sid").alias("a"), F.col(column).alias("x"))
    y = table.select(F.col("sid").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, stays) per row of ``docs`` (doc_id, text).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their
    sets of distinct n-word shingles; component_id is the smallest doc_id
    reachable by links.

    Equal sets are one representative.  The first token order is rarest-first,
    by document frequencies of all documents summed in a fixed-size sketch: a
    pair must share a token of both prefixes, early enough in both for the
    needed overlap.  The other orders are hashes.  Candidates of the first order
    are met with the stored prefixes of all the others (``may_link``), and only
    pairs that pass every one of them have their sets fetched and compared.

    A first round takes one admissible partner a row of a bucket; after
    contraction a second round takes every admissible pair that is still apart.
    Pairs within one component are never listed.

    Null and blank texts have no shingles and link with nothing, their
    component_id is their own doc_id; a null doc_id counts as larger than any
    other and is ignored by the minimum (null if a component has no other).
    ``stays`` marks the component's smallest (doc_id, text_hash), the latter
    being xxhash64 of the text, and all texts without shingles.
    Repeated rows come back as often as they came.  Very long texts are read
    whole, one at a time.  An empty table gives none.
    Columns other than doc_id and text are ignored.
    """
    if orders < 2:
        raise ValueError("orders must be at least 2")
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tk"))
    level = spark.sparkContext.broadcast(token_levels(keyed, n))
    rows = materialise(keyed.mapInArrow(_measure(n), "doc_id long, tk long, n long, sid long"), "shingle-sets")

    prefix = keyed.select("text").mapInArrow(_prefixes(n, percent, level), "token long, sid long, n int, r int")
    sorted_rows = prefix.repartition(F.col("token")).sortWithinPartitions("token", "n", "sid")
    buckets = materialise(sorted_rows.mapInArrow(_buckets(percent), "token long, sid long, n long, r long, other long"), "buckets")
    scrap(spark)
    first = materialise(buckets.where("sid <> other").select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct(), "first-pairs")

    # The prefixes under the other orders, of sets in buckets, one row a set.
    wanted = buckets.select("sid").distinct()
    marks = keyed.select("text").mapInArrow(_signatures(n, percent, orders), "sid long, marks binary")
    marks = materialise(marks.join(wanted.hint("shuffle_hash"), "sid", "left_semi").dropDuplicates(["sid"]), "prefixes")
    scrap(spark)

    def links_of(pairs: DataFrame) -> DataFrame:
        met = materialise(_with_both(pairs, marks, "marks").mapInArrow(_meet(percent, orders), "a long, b long"), "candidates")
        # The sets of candidates alone, read from the first document of each.
        ends = met.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        chosen = rows.join(ends, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "tk")).alias("k")).select(F.col("k.doc_id").alias("d"), F.col("k.tk").alias("t"))
        texts = keyed.join(chosen.distinct().hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left_semi").select("text")
        sets = materialise(texts.mapInArrow(_sets(n), "sid long, tokens binary").dropDuplicates(["sid"]), "sets")
        scrap(spark)
        links = materialise(_with_both(met, sets, "tokens").mapInArrow(_verify(percent), "a long, b long"), "links")
        scrap(spark, met, sets)
        return links

    links = links_of(first)
    label = connected_components(links)
    named = buckets.select("token", "sid", "n", "r").join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid"))
    named = materialise(named.drop("root"), "labelled-buckets")
    scrap(spark, buckets)
    second = materialise(apart(named, percent).join(first, ["a", "b"], "left_anti"), "second-pairs")
    more = links_of(second)
    label = connected_components(links.union(more))
    scrap(spark, first, second, named, marks, links, more)

    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tk")
    smallest = materialise(rows.where("n > 0").groupBy("sid").agg(F.min(order).alias("least")), "smallest")
    linked = smallest.join(label, F.col("sid") == F.col("node")).select("sid", "root", "least")
    # Written tables on both sides let Spark split a root that a third of all sets belong to.
    roots = materialise(linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("first")), "roots")
    firsts = materialise(label.join(roots, F.col("root") == F.col("r")).select("node", "first"), "firsts")
    classes = materialise(smallest.join(firsts, F.col("sid") == F.col("node"), "left").select(F.col("sid").alias("s"), F.coalesce("first", "least").alias("first")), "classes")
    scrap(spark, smallest, roots, firsts)
    joined = rows.join(classes, (F.col("sid") == F.col("s")) & (F.col("n") > 0), "left")
    some = F.col("n") > 0
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(some, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("tk").alias("text_hash"),
        (~some | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tk") == F.col("tk")))).alias("stays"),
    )
