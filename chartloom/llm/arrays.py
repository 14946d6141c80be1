"""Vectorised text primitives over the byte buffers of Arrow batches.

A *slice* is a run of rows whose UTF-8 bytes lie in one numpy buffer; slices hold about ``SLICE_BYTES`` (or one row, if
that row is longer), so temporaries stay small whatever the batch holds. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
_MUL1, _MUL2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _MUL1
    x = (x ^ (x >> U64(27))) * _MUL2
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed 64-bit values, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(salt * 1_000_003)) * U64(_GOLDEN))


_ORDER = seeds(64, 3) | U64(1)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


@dataclass
class Slice:
    """Rows ``lo`` to ``hi`` of a batch: ``buf`` has their bytes, row i is ``buf[off[i]:off[i + 1]]``."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> str:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")

    def take(self, rows: np.ndarray) -> Slice:
        size = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) + np.repeat(self.off[:-1][rows] - off[:-1], size)
        return Slice(0, len(rows), self.buf[at], off)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the index of each row's first word (rows + 1)."""
    n = len(s.buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(s.rows + 1, np.int64)
    solid = ~SPACE[s.buf]
    begin, stop = solid.copy(), solid.copy()
    fresh = np.zeros(n + 1, bool)
    fresh[s.off] = True
    begin[1:] &= ~solid[:-1] | fresh[1:n]
    stop[:-1] &= ~solid[1:] | fresh[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, s.off)


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the ``\\n``-split lines, and the index of each row's first line (rows + 1). An empty row has one
    empty line."""
    cut = np.flatnonzero(s.buf == 10)
    row = np.searchsorted(s.off, cut, "right") - 1
    count = np.bincount(row, minlength=s.rows) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = s.off[:-1], s.off[1:]
    place = np.arange(len(cut)) + row
    ends[place], starts[place + 1] = cut, cut + 1
    return starts, ends, first


def sequences(x: np.ndarray, first: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each row's stretch of values. Every value is scrambled with its place before it is added, so no linear
    relation between stretches makes them equal; another ``salt`` gives an independent hash."""
    count = np.diff(first)
    out = np.zeros(len(count), U64)
    full = np.flatnonzero(count)
    if len(full):
        place = np.arange(len(x)) - np.repeat(first[:-1], count)
        out[full] = np.add.reduceat(mix(x ^ seeds(int(count.max()), 31 + salt)[place]), first[:-1][full])
    return mix(out + count.astype(U64) * U64(_GOLDEN))


class SpanHash:
    """64-bit hashes of byte spans of one slice, from their groups of eight bytes; ``salt`` as in ``sequences``. Empty spans
    are zero."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.eights = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        size = ends - starts
        count = (size + 7) >> 3
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(starts - 8 * first[:-1], count) + 8 * np.arange(first[-1])
        x = self.eights[at] & _KEEP[np.minimum(np.repeat(ends, count) - at, 8)]
        return mix(sequences(x, first, salt) ^ size.astype(U64))


def row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * _ORDER[j]
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word-``k``-gram hashes of every row, one after the other, and the index of each row's first (rows + 1). A row of fewer
    words has one shingle of all its words, a row without words none. Repeats are kept."""
    count = np.diff(first)
    have = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(have)])
    out = np.empty(start[-1], U64)
    whole = np.repeat(count >= k, have)
    row = row_of(first)
    if len(h) >= k:
        out[whole] = windows(h, k)[row[: len(h) - k + 1] == row[k - 1 :]]
    for c in range(1, k):
        rows = np.flatnonzero(count == c)
        if len(rows):
            x = np.full(len(rows), c, U64)
            for j in range(c):
                x += h[first[rows] + j] * _ORDER[j + k]
            out[start[rows]] = mix(x)
    return out, start


def row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``x`` over each row's stretch."""
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return c[first[1:]] - c[first[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one comes before it, and whether any other is equal."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    if len(keys) > 1:
        k = keys[order]
        same[1:-1] = k[1:] == k[:-1]
    later, twice = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return later, twice


def occurrence(keys: np.ndarray) -> np.ndarray:
    """For each key: how many equal ones come before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    at = np.arange(len(k))
    out = np.empty(len(k), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(head, at, 0)) if len(k) else at
    return out
