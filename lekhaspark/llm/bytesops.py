"""Vectorised byte work shared by the text operators: zero-copy views of Arrow
strings, word spans, polynomial prefix hashes and 64-bit mixing.

Everything works on slices of a few megabytes, so a task's memory does not grow
with its partition (one document longer than a slice is a slice of its own)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

# The white space that ends a word in every contract of this package.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    off = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (first, last) of rows of about `limit` bytes, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def power(n: int, which: str = "up") -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if which == "up" else _INVERSE, U)
        step[0] = 1
        _powers[which] = have = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] covers data[:i], modulo 2**64."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start, end) -> np.ndarray:
    """Hash of data[start:end], the same wherever these bytes stand."""
    return (prefix[end] - prefix[start]) * power(len(prefix), "down")[start]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def runs(member: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `member`, never across rows, nor across i - 1 and i where cut[i]."""
    n = len(member)
    first = np.zeros(n + 1, bool)
    first[off] = True
    if cut is not None:
        first[:n] |= cut
    before = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, member[:-1]
    starts = np.flatnonzero(member & (~before | first[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1], after[:-1] = False, member[1:]
    ends = np.flatnonzero(member & (~after | first[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each A-Z-folded word, words of each row)."""
    data = LOWER[data]
    starts, ends = runs(~IS_SPACE[data], off)
    row = np.searchsorted(off, starts, "right") - 1
    hashes = mix(span_hash(prefix_hash(data), starts, ends) + (ends - starts).astype(U))
    return hashes, np.bincount(row, minlength=len(off) - 1)


class LongMap:
    """Bounded map from 64-bit keys to int64 values >= 0, for whole arrays at once; it forgets everything when full."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int64), 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        rest, slot = np.arange(len(keys)), (mix(keys, 3) >> U(64 - self.bits)).astype(np.int64)
        while len(rest):
            value = self.values[slot]
            same = (self.keys[slot] == keys[rest]) & (value >= 0)
            out[rest[same]] = value[same]
            on = ~same & (value >= 0)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet; more than half the room at once are not kept."""
        room = 1 << (self.bits - 1)
        if self.n + len(keys) > room:
            self.clear()
            keys, values = keys[:room], values[:room]
        self.n += len(keys)
        rest, slot = np.arange(len(keys)), (mix(keys, 3) >> U(64 - self.bits)).astype(np.int64)
        while len(rest):
            free = self.values[slot] < 0
            self.keys[slot[free]] = keys[rest[free]]
            mine = free & (self.keys[slot] == keys[rest])
            self.values[slot[mine]] = values[rest[mine]]
            rest, slot = rest[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
