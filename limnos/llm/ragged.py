"""Ragged numpy views of Arrow text columns.

A batch of texts is one byte buffer plus row offsets; words, lines and n-grams
are (start, end) arrays over that buffer, so a slice of rows is handled by a
few array operations.  Slices are bounded by bytes: memory follows the slice
(or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_M = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, _M, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text, one row at least."""
    n = len(column)
    if not n:
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    start = 0
    while start < n:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + max_bytes, "right")))
        yield start, end
        start = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; a null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets * 0
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes within each row: start, end, and for
    each row the index of its first run (length rows + 1)."""
    n = len(inside)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        before[cut] = False
        after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def owner(first: np.ndarray) -> np.ndarray:
    """Row number of each run, from the row's first-run index."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; two of them give the hash of any span."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _pow(_P, len(data))[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans have equal hashes wherever
    they stand."""
    inv = _pow(_P_INV, len(h))
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive runs that stay in one row, and the index
    of the run each starts at."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.zeros(n, np.uint64)
    for k in range(size):
        w = w * np.uint64(0xA24BAED4963EE407) + hashes[k: k + n]
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.arange(n)
    ok = at + size <= row_end
    return mix(w[ok]), at[ok]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-run) array over each row."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (length bytes + 1)."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c


def keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes made distinct between rows, so that one sort groups by both."""
    return mix(hashes + (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The spans' bytes, one after the other."""
    size = ends - starts
    total = int(size.sum())
    if not total:
        return np.zeros(0, data.dtype)
    begin = np.cumsum(size) - size
    return data[np.arange(total) + np.repeat(starts - begin, size)]


class Table:
    """Places of distinct 64-bit keys by open addressing: a few gathers a
    lookup instead of a binary search."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(len(keys) * 8 - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.slot = np.full(size, -1, np.int32)
        self.keys = np.append(keys, np.zeros(1, np.uint64))
        todo = np.arange(len(keys), dtype=np.int32)
        at = (keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & int(self.mask)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for unknown ones."""
        at = (h & self.mask).astype(np.int64)
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            got = self.slot[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != h[todo])]
        return out
