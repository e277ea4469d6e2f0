"""Vectorised word arithmetic over Arrow string columns.

Texts stay in Arrow's own buffers: words are found with byte masks and hashed
with prefix sums, so no Python object is made per word.  A *word* here is a run
of bytes outside space and ``\\x09-\\x0D``; since every other byte of a UTF-8
sequence is outside that set, this equals the regex ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the prefix-sum hashes (any odd 64-bit values do).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 18

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: bijective, so distinct inputs stay distinct."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (a sort is far faster here than np.unique's hash table)."""
    s = np.sort(x)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64), 0x5851F42D4C957F2D)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    kind = pa.large_binary()
    column = column.cast(kind) if not pa.types.is_null(column.type) else pa.nulls(len(column), kind)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


class Words:
    """The words of consecutive texts: byte ranges, text numbers and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE, fold: bool = False):
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])]
        self.bytes = LOWER[raw] if fold else raw
        self.bounds = offsets - base
        inside = ~separator[self.bytes]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        first = self.bounds[:-1][np.diff(self.bounds) > 0]
        before[first] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[first[1:] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        #: word_of[t] .. word_of[t + 1]: the words of text t
        self.word_of = np.searchsorted(self.start, self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        n = len(self.bytes)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[self.bytes] * powers(BYTE_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(inverse(BYTE_BASE), n + 1)[self.start])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words at each start (runs over text ends too: the caller drops them)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(WORD_BASE, len(words)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(inverse(WORD_BASE), len(words) + 1)[: len(words) - n + 1], n)
