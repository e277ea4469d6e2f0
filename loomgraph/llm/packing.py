"""Best-fit packing of token sequences by bin completion with branch and bound."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._shared import materialise, same_text, ship
from loomgraph.llm.tokens import encoder

#: Dives for the incumbent, each to a leaf or a bound.
DIVES = 48
#: Effort of the branch and bound beyond it: patterns placed and fillings tried.
STEPS = 50_000
#: Fillings looked at together, least waste first (order of the search, not its reach).
WIDE = 6
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"


Patterns = list[tuple[list[tuple[int, int]], int]]


class Bins:
    """Patterns (lengths with counts) and how often each is used; built largest length first."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.capacity = counts.astype(np.int64).copy(), capacity
        self.patterns: list[tuple[list[tuple[int, int]], int]] = []
        self.bins = self.waste = 0

    def completions(self, room: int, wide: int) -> list[list[int]]:
        """Some fillings of ``room``, least waste first.

        A single document that fills the room dominates every other filling.  Else
        there is the most uneven pair that fills it, and each other filling starts
        with one of the ``wide`` largest fitting lengths and is completed.
        """
        left = self.counts
        if room <= 0 or not left[1 : room + 1].any():
            return [[]]
        if left[room]:
            return [[room]]
        pair = self.pair(room)
        if pair and wide == 1:
            return [pair]
        found = [pair] if pair else []
        for a in np.flatnonzero(left[1 : room + 1])[::-1][:wide] + 1:
            left[a] -= 1
            filling, rest = [int(a)], room - int(a)
            while rest > 0:
                if left[rest]:
                    filling.append(rest)
                    left[rest] -= 1
                    rest = 0
                elif (two := self.pair(rest)) is not None:
                    filling += two
                    for x in two:
                        left[x] -= 1
                    rest = 0
                else:
                    fits = np.flatnonzero(left[1 : rest + 1])
                    if not len(fits):
                        break
                    b = int(fits[-1]) + 1
                    take = min(int(left[b]), rest // b)
                    filling += [b] * take
                    left[b] -= take
                    rest -= take * b
            for x in filling:
                left[x] += 1
            if filling not in found:
                found.append(filling)
        return sorted(found, key=lambda f: (room - sum(f), len(f)))

    def pair(self, room: int) -> list[int] | None:
        """Two lengths that fill ``room`` exactly, the most uneven ones."""
        has = self.counts[: room + 1]
        ok = (has[1:room] > 0) & (has[1:room][::-1] > 0)
        if room % 2 == 0 and room >= 2 and has[room // 2] < 2:
            ok[room // 2 - 1] = False
        at = np.flatnonzero(ok)
        return [room - int(at[0]) - 1, int(at[0]) + 1] if len(at) else None

    def step(self, choice: int, wide: int) -> bool:
        """Close the bins of one pattern around the largest document; False when none is left."""
        lengths = np.flatnonzero(self.counts)
        if not len(lengths):
            return False
        top = int(lengths[-1])
        self.counts[top] -= 1
        found = self.completions(self.capacity - top, wide)
        self.counts[top] += 1
        filling = [top, *found[min(choice, len(found) - 1)]]
        need = sorted({x: filling.count(x) for x in filling}.items(), reverse=True)
        times = min(int(self.counts[x]) // n for x, n in need)
        for x, n in need:
            self.counts[x] -= n * times
        self.patterns.append((need, times))
        self.bins += times
        self.waste += times * (self.capacity - sum(filling))
        return True


def incumbent(counts: np.ndarray, capacity: int, bound: int, dives: int = DIVES) -> Bins:
    """The best of the best-fit completion and of ``dives`` dives, each with another completion at one step.

    Works on the histogram, so its cost doesn't grow with the documents: a step
    closes all bins of one pattern and uses up a length.  Ends early at ``bound``.
    """
    total = int((np.arange(len(counts)) * counts).sum())
    best = Bins(counts, capacity)
    while best.step(0, 1):
        pass
    tried = 0
    for wide, choice in ((6, 0), (6, 1), (6, 2)):
        for at in range(len(best.patterns)) if choice else (-1,):
            if best.bins <= bound or tried >= dives:
                return best
            tried += 1
            other, k = Bins(counts, capacity), 0
            # Fewer bins than the incumbent's leave less waste than this in all.
            allowed = (best.bins - 1) * capacity - total
            while other.waste <= allowed and other.step(choice if k == at else 0, wide):
                k += 1
            if other.waste <= allowed and not other.counts.any() and other.bins < best.bins:
                best = other
    return best


def pattern(counts: np.ndarray, filling: list[int]) -> tuple[list[tuple[int, int]], int]:
    """(lengths with counts, how often ``counts`` has them all)."""
    need = sorted(Counter(filling).items(), reverse=True)
    return need, min(int(counts[x]) // n for x, n in need)


def use(counts: np.ndarray, need: list[tuple[int, int]], times: int) -> None:
    for x, n in need:
        counts[x] -= n * times


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2, which is never less than ceil(total / capacity)."""
    half = capacity // 2
    n, s = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    k = np.arange(half + 1)
    alone, middle = n[capacity] - n[capacity - k], n[capacity - k] - n[half]
    over = s[half] - np.where(k > 0, s[k - 1], 0) - (middle * capacity - (s[capacity - k] - s[half]))
    return int((alone + middle + np.maximum(0, -(-over // capacity))).max())


def dominated(filling: list[int], room: int, free: int) -> bool:
    """Whether a free length (bit x of ``free``) fits in place of some of the filling's lengths, or of none.

    The lengths it replaces sum to at most its own, so they go wherever it went:
    the filling needn't be tried (Martello and Toth).  A filling that another one
    dominates is always dominated by such a single exchange.
    """
    slack = room - sum(filling)
    sums, low = 1, 0  # bit y: some of the lengths under the next limit sum to y
    for limit, n in [*sorted(Counter(filling).items()), (room, 0)]:
        reach, wide = sums, 1
        while wide <= slack:
            step = min(wide, slack + 1 - wide)
            reach |= reach << step
            wide += step
        if reach & free & (2 << limit) - (2 << low):
            return True
        for _ in range(n):
            sums |= sums << limit
        low = limit
    return False


def fillings(counts: np.ndarray, room: int, least: int, effort: list[int]):
    """The undominated fillings of ``room`` that fill ``least`` of it, largest lengths first; ends early with ``effort``."""
    if room > 0 and counts[room]:
        yield [room]
        return
    lengths = [int(x) + 1 for x in np.flatnonzero(counts[1 : room + 1])[::-1]]
    left = [int(counts[x]) for x in lengths]
    rests = [*np.cumsum([x * n for x, n in zip(lengths, left, strict=True)][::-1])[::-1].tolist(), 0]
    free = sum(1 << x for x in lengths)
    todo: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, room, ())]
    while todo and effort[0] > 0:
        effort[0] -= 1
        k, rest, chosen = todo.pop()
        while k < len(lengths) and lengths[k] > rest:
            k += 1
        if room - rest + min(rest, rests[k]) < least:
            continue
        if k < len(lengths):
            todo += [(k + 1, rest - n * lengths[k], (*chosen, (k, n)) if n else chosen) for n in range(min(left[k], rest // lengths[k]) + 1)]
            continue
        filling = [lengths[j] for j, n in chosen for _ in range(n)]
        used_up = sum(1 << lengths[j] for j, n in chosen if n == left[j])
        if not dominated(filling, room, free & ~used_up):
            yield filling


def choices(counts: np.ndarray, capacity: int, bins: int, effort: list[int]):
    """Patterns around the largest document that can lead to at most ``bins`` more bins: as often as they go, then less often."""
    own, before = counts.copy(), counts.copy()
    top = int(np.flatnonzero(own)[-1])
    own[top] -= 1
    room, waste = capacity - top, bins * capacity - int((np.arange(len(counts)) * counts).sum())
    found = fillings(own, room, room - waste, effort)
    tried = []
    while some := sorted(islice(found, WIDE), key=lambda f: (-sum(f), len(f))):
        for f in some:
            tried.append(pattern(before, [top, *f]))
            yield tried[-1]
    for need, times in tried:
        for t in range(times - 1, 0, -1):
            yield need, t


def bin_completion(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Patterns:
    """Patterns for ``counts[length]`` documents of each length 1 to ``capacity``, in as few bins as found.

    Works on the histogram, so its cost doesn't grow with the documents: a step
    closes bins of one pattern.  Beyond the incumbent of best fit and dives,
    branch and bound goes back over every undominated filling around the
    largest document and over how often it is used, first with no, then one, two
    and more departures from the first choice, and cuts where the lower bound of
    what is left can't beat the incumbent.  The result is optimal when the
    incumbent meets the lower bound or the tree ends; else the search stops after
    ``steps`` patterns and fillings and the result is the best one found.
    """
    counts = counts.astype(np.int64)
    bound, effort = lower_bound(counts, capacity), [steps]
    first = incumbent(counts, capacity, bound)
    best, fewest = first.patterns, first.bins
    for limit in count():
        left, bins, path, whole = counts.copy(), 0, [], True
        seen: dict[bytes, list[tuple[int, int]]] = {}  # states with (bins, departures left)
        frames = [[choices(left, capacity, fewest - 1, effort), limit, 0]] if fewest > bound else []
        while frames and fewest > bound and effort[0] > 0:
            frame = frames[-1]
            step = next(frame[0], None)
            if step is not None and frame[2] and not frame[1]:
                step, whole = None, False
            if step is None:
                frames.pop()
                if path:
                    need, times = path.pop()
                    use(left, need, -times)
                    bins -= times
                continue
            effort[0] -= 1
            spare, frame[2] = frame[1] - bool(frame[2]), frame[2] + 1
            use(left, *step)
            bins += step[1]
            path.append(step)
            if not left.any() and bins < fewest:
                best, fewest = list(path), bins
            state = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
            if left.any() and bins + lower_bound(left, capacity) < fewest and not any(b <= bins and s >= spare for b, s in seen.get(state, ())):
                seen.setdefault(state, []).append((bins, spare))
                frames.append([choices(left, capacity, fewest - 1 - bins, effort), spare, 0])
            else:
                path.pop()
                use(left, step[0], -step[1])
                bins -= step[1]
        if fewest <= bound or effort[0] <= 0 or whole:
            return best


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches):
        encode = encoder(path).encode
        last = int(end).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        ranks = [0] * (size + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0

            def rows(out=out):
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                a = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                a.insert(6, pa.array(np.full(len(out[0]), part, np.int32)))
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays(a, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"])

            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + last
                total = len(ids) // 4
                start, piece = 0, 0
                stop = total if total <= size else total % size or size
                while start < total:
                    own = ids[4 * start : 4 * stop]
                    n = stop - start
                    for c, x in zip(out, (doc, piece, start, n, zlib.crc32(own), own if with_ids else None, ranks[n]), strict=True):
                        c.append(x)
                    ranks[n] += 1
                    piece, start, stop = piece + 1, stop, stop + size
                held += len(ids)
                if held > 1 << 23:
                    held = 0
                    yield rows()
            if out[0]:
                yield rows()

    return run


def _place(size: int, plan: dict[int, tuple[np.ndarray, ...]]):
    """Turn (length, global rank) into (sequence_id, offset) by the plan's ranges of ranks."""

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, each, place = plan[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                q = rank[at] - first[k]
                sequence[at] = base[k] + q // each[k]
                offset[at] = place[k] + q % each[k] * n
            names = [c for c in batch.schema.names if c not in ("rank", "before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def plan_of(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, documents a sequence, place in it) of each of its ranges."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for need, times in patterns:
        place = 0
        for n, each in need:
            ranges.setdefault(n, []).append((used.get(n, 0), sequence, each, place))
            used[n] = used.get(n, 0) + each * times
            place += each * n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in ranges.items()}


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end: int = 2, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of the pieces of ``docs`` (doc_id, text).

    A document is the ids of its text and then ``end``; null and empty texts are
    ``end`` alone.  Documents over ``size`` ids are cut into pieces of ``size``,
    of which the first may be shorter.  All pieces share sequences of at most
    ``size`` ids, gapless from offset 0.

    The tasks that tokenize number their pieces per length; prefix sums over
    tasks turn that into a rank per length, and the plan, made on the histogram
    of lengths (``size`` counts), says where each rank goes.  No piece meets
    another on the way, so no group grows with the documents.  Without
    ``with_ids`` the ids column is null.  Repeated rows are packed as often as
    they come; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same_text("text").alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer_path, size, end, with_ids), PIECE), "pieces")
    counts = materialise(pieces.groupBy("part", "length").count(), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    plan = plan_of(bin_completion(histogram, size))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("part").alias("p"), F.col("length").alias("n"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    ranked = pieces.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("n"))).drop("part", "p", "n")
    return ranked.mapInArrow(_place(size, plan), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
