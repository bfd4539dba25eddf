"""Vectorised byte work on Arrow text columns: words, word hashes, 5-word shingle sets. No loop runs over words."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Rows are taken together up to so many text bytes; a longer text comes alone.
CHUNK_BYTES = 1 << 20


def return_memory() -> None:
    """Have the C library hand back freed arrays of 4 MB or more at once, instead of keeping them for later ones; without such
    a library nothing changes."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


def _mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def tables():
    """Byte tables: ASCII lower case, white space, and a 64-bit value for each byte."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return low, space, _mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) for runs of rows with about `limit` bytes together; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64 bits for each word data[start:end]: a polynomial over its bytes' values, finished with its length."""
    n = len(data)
    if not len(start):
        return np.zeros(0, U64)
    values = tables()[2] if values is None else values
    base, inv = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    powers = np.full(n, base, U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values[data] * powers, dtype=U64, out=sums[1:])
    del powers
    back = np.full(n, inv, U64)
    back[0] = 1
    back = np.cumprod(back, dtype=U64)
    h = (sums[end] - sums[start]) * back[start]
    return _mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, as numpy's own hashing is slower on many numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Words:
    """Words of a chunk: start and end bytes, row of each, first word of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        low, space, self.values = tables()
        self.data, self.off = (low[data] if lower else data), off
        blank = space[data]
        solid = ~blank
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        before = np.ones(len(data), dtype=bool)
        before[1:] = blank[:-1]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.ones(len(data), dtype=bool)
        after[:-1] = blank[1:]
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, off, side="left")  # n rows + 1

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, self.values)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5):
    """(shingle hashes, sorted and distinct within each row; bounds, n rows + 1) of a chunk.

    A row with fewer words than `width` has its whole sequence as one; a row without words has none.
    """
    w = Words(data, off)
    h, rows, first = w.hashes(), len(off) - 1, w.first
    mult = _mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    n_words = np.diff(first)
    if len(h) >= width:
        s = h[: len(h) - width + 1] * mult[0]
        for k in range(1, width):
            s = s + h[k : len(h) - width + 1 + k] * mult[k]
        inside = w.row[: len(h) - width + 1] == w.row[width - 1 :]
        s, owner = _mix(s)[inside], w.row[: len(h) - width + 1][inside]
    else:
        s, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        extra = np.array([(h[first[r] : first[r + 1]] * mult[: n_words[r]]).sum(dtype=U64) + U64(int(n_words[r])) for r in short], dtype=U64)
        s, owner = np.concatenate([s, _mix(_mix(extra))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for r in range(rows):
        s[bounds[r] : bounds[r + 1]].sort()
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.searchsorted(owner[new], np.arange(rows + 1))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values, in the same way wherever the row stands; 0 for empty rows."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64, copy=False), bounds[full])
    return out


class Lookup:
    """Values of distinct non-negative 64-bit keys, by open addressing; faster than a binary search where keys are many."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, values.dtype)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of two keys for one slot the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether the key is there); a missing key has value 0."""
        at = self._slot(keys)
        got = self.keys[at]
        found, out = got == keys, self.values[at]
        open_ = np.flatnonzero(~found & (got != -1))
        out[~found] = 0
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            found[open_[hit]], out[open_[hit]] = True, self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out, found
