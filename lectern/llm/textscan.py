"""Vectorised scans over concatenated UTF-8 texts: words, range hashes in O(1), sliding minima.

A word (or line) is hashed eight bytes at a time through a 64-bit mixer. A range hash over such words, or over randomly tabulated
bytes, is a polynomial hash modulo 2**64, read off prefix sums and finished with the mixer, so any n-gram or window costs one
subtraction whatever its length. It is used for ranges of up to some hundred symbols only: sequences that repeat a pattern and its
complement a thousand times can share a polynomial hash modulo a power of two, whatever the base.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(maxsize=1)
def _low_powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(_LOW, _BASE, U), np.full(_LOW, _INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=64)
def _high_powers(n: int) -> np.ndarray:
    step = pow(_INVERSE, _LOW, 1 << 64)
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x = x * step % (1 << 64)
    return np.array(out, U)


@lru_cache(maxsize=4)
def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: By number of bytes: which bits of a lane belong to a range.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Longer ranges are hashed one by one.
_LONG = 256


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), without algebraic structure; different seeds give independent hashes."""
    n = end - start
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(n.astype(U) + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    at, left = start[live], n[live]
    while len(live):
        lane = lanes[at] & _LANE[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ lane)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


class Ranges:
    """Hashes of symbol ranges [start, end) of one sequence."""

    def __init__(self, symbols: np.ndarray, table: np.ndarray | None = None):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U)
        up = _low_powers()[0]
        high, step = 1, pow(_BASE, _LOW, 1 << 64)
        for a in range(0, n, _LOW):
            part = symbols[a : a + _LOW]
            value = table[part] if table is not None else part.astype(U, copy=True)
            value *= up[: len(part)]
            value *= U(high)
            np.cumsum(value, out=self.sums[a + 1 : a + 1 + len(part)])
            self.sums[a + 1 : a + 1 + len(part)] += self.sums[a]
            high = high * step % (1 << 64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.sums[end] - self.sums[start]
        x *= _low_powers()[1][start & (_LOW - 1)]
        x *= _high_powers((len(self.sums) >> 18) + 1)[start >> 18]
        return mix(x)

    def windows(self, width: int) -> np.ndarray:
        """The hash of every range of `width` symbols, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        out = self.sums[width:] - self.sums[:-width]
        down, high = _low_powers()[1], _high_powers((len(self.sums) >> 18) + 1)
        for k, a in enumerate(range(0, n, _LOW)):
            part = out[a : a + _LOW]
            part *= down[: len(part)]
            part *= high[k]
        return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every run of bytes that are not white space; texts do not touch."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:n].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    solid = ~space
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values, in two running-minimum passes over blocks."""
    n = len(a)
    if n < width:
        return a[:0]
    pad = -n % width
    block = np.concatenate([a, np.full(pad, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (start, end) that the ranges cover together."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1] if len(at) else at


def flat(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of each range, one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)]


def unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pairs of ranges data[a : a + size], data[b : b + size] that differ."""
    out = [np.zeros(0, np.int64)]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 19), side="right")))
        s = slice(lo, hi)
        differ = flat(data, a[s], size[s]) != flat(data, b[s], size[s])
        if differ.any():
            out.append(np.unique(np.searchsorted(np.cumsum(size[s]), np.flatnonzero(differ), side="right")) + lo)
        lo = hi
    return np.concatenate(out)
