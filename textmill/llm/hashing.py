"""Hashes of words, word runs and byte runs over whole blocks of text, in numpy.

A run's hash is a polynomial in an odd base modulo 2^64 over random byte values, from differences of running sums.
It doesn't depend on where in a block the run lies, so equal runs have equal hashes in any task.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of more bytes get a hash that isn't a polynomial: modulo 2^64 there are long words that agree in every odd base.
LONG = 64
_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
#: The same with A-Z as a-z.
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def running(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE^i before each place, for runs()."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def runs(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of values[first:last], unmixed."""
    return (sums[last] - sums[first]) * powers(INVERSE, len(sums))[first]


def words(buf: np.ndarray, at: np.ndarray, lower: bool = False, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that lie end to end in buf: each word's first byte, its end and hash, and for each row the number of words before it.

    at: the rows' offsets, from 0. Words are runs of bytes that aren't separators.
    """
    n = len(buf)
    gap = np.ones(n + 1, bool)
    gap[:n] = separators[buf]
    starts = np.empty(n + 1, bool)
    starts[0] = True
    starts[1:] = gap[:n]
    starts[at] = True
    ends = gap.copy()
    ends[at] = True
    starts &= ~gap
    first = np.flatnonzero(starts)
    stop = np.empty(n + 1, bool)
    stop[0] = False
    stop[1:] = ends[1:] & ~gap[:n]
    last = np.flatnonzero(stop)
    sums = running((BYTE_LOWER if lower else BYTE)[buf])
    hashes = mix(runs(sums, first, last) + (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first > LONG).tolist():
        word = buf[first[i] : last[i]].tobytes()
        hashes[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)  # bytes.lower() is that of A-Z
    return first, last, hashes, np.searchsorted(first, at)
