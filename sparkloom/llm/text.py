"""Vectorised text kernels over the byte buffers of Arrow string arrays.

Everything works on UTF-8 bytes.  ASCII bytes never occur inside a multi-byte
character, so splitting and lower-casing ASCII bytes is exact for any text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_SPAN = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCT = SPACE.copy()
for _c in range(33, 128):
    if not chr(_c).isalnum():
        PUNCT[_c] = True
PUNCT[:9] = PUNCT[14:32] = True

_tables: dict[str, np.ndarray] = {}
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below _SPAN."""
    if not _tables:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            t = np.full(_SPAN, b, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives memory that is free back to the system: idle Python workers otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def blocks(column: pa.Array, most_bytes: int = 1 << 19):
    """Slices (first row, rows) of a column so that each has about most_bytes at most."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end - at
        at = end
    release()


class Words:
    """The words of a block of texts.

    data: lower-cased bytes; start, end: byte range of each word; row: the
    text of each word; first: n + 1 bounds of each text's words; key: a 64-bit
    hash of each word's bytes.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = True, cut_points: bool = False, fold: bool = False):
        if fold:  # lower-case all of Unicode
            column = pc.utf8_lower(column)
        raw, offsets = buffers(column)
        self.offsets = offsets
        self.data = LOWER[raw] if lower else raw
        n = len(raw)
        inside = ~separators[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        before_start = before[:n] & ~edge[:n]
        starts = inside & ~before_start
        if cut_points and n:
            # a full stop or comma that ends a word after an ASCII letter is a word of its own
            last = np.empty(n, dtype=bool)
            last[-1] = True
            last[:-1] = ~inside[1:] | edge[1:n]
            letter = (self.data >= 97) & (self.data <= 122)
            point = last & ((raw == 44) | (raw == 46))
            point[0] = False
            point[1:] &= letter[:-1] & before_start[1:]
            starts |= point
        self.start = np.flatnonzero(starts)
        if len(self.start):
            # each word ends before the next start or at its first separator
            stop = np.flatnonzero((~inside) | edge[:n])
            nxt = np.append(self.start[1:], n)
            k = np.searchsorted(stop, self.start, side="right")
            ends = np.append(stop, n)[np.minimum(k, len(stop))]
            self.end = np.minimum(ends, nxt)
        else:
            self.end = self.start
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self._key: np.ndarray | None = None

    @property
    def key(self) -> np.ndarray:
        if self._key is None:
            self._key = hash_ranges(self.data, self.start, self.end)
        return self._key


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash, mixed, of each byte range; ranges are ordered and disjoint."""
    up, down = _powers()
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = int(np.searchsorted(end, low + _SPAN, side="right"))
        if stop <= at:  # one word longer than the tables
            h, s = 0, data[low : int(end[at])]
            for i in range(0, len(s), _SPAN):
                part = s[i : i + _SPAN]
                h = (h * 0x9E3779B1 + int((part.astype(np.uint64) + np.uint64(1)) @ up[: len(part)])) & 0xFFFFFFFFFFFFFFFF
            out[at] = h
            at += 1
            continue
        high = int(end[stop - 1])
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = (total[e] - total[s]) * down[s]
        at = stop
    return mix(out + (end - start).astype(np.uint64) * _MUL)


def shingles(key: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the n + 1 bounds of each text's runs.

    short: a text of fewer words yields its whole sequence as one run.
    """
    n = len(key)
    count = np.diff(first)
    runs = np.maximum(count - width + 1, 0)
    if n >= width:
        acc = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            acc = (acc + key[j : n - width + 1 + j]) * _MUL
            acc ^= acc >> np.uint64(29)
        rolled = mix(acc)
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    brief = short & (count > 0) & (count < width)
    total = runs + brief
    bounds = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(int(bounds[-1]), dtype=np.uint64)
    if len(rolled):
        where = np.repeat(first[:-1] - bounds[:-1], total) + np.arange(bounds[-1])
        out[:] = rolled[np.minimum(where, len(rolled) - 1)]
    for i in np.flatnonzero(brief):
        h = np.uint64(int(count[i]))
        with np.errstate(over="ignore"):
            for k in key[first[i] : first[i + 1]]:
                h = (h + k) * _MUL
                h ^= h >> np.uint64(31)
        out[bounds[i]] = mix(np.array([h]))[0]
    return out, bounds


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] for all i, end to end."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) if len(length) else np.zeros(0, np.int64)
    return values[shift + np.arange(total)]
