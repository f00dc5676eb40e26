"""Vectorised hashes over bytes: of all windows of a length, and of all words."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the polynomial and of the finishing mix.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(table: np.ndarray, base: int, n: int) -> np.ndarray:
    if len(table) >= n:
        return table
    size = max(n, 2 * len(table))
    with np.errstate(over="ignore"):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    _powers, _inverses = _grown(_powers, BASE, n), _grown(_inverses, INVERSE, n)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> S33)
    h *= MIX1
    h ^= h >> S33
    h *= MIX2
    h ^= h >> S33
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of a byte array; entry i covers the first i bytes."""
    powers, _ = tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the slices from start to end of the array behind ``sums``; equal slices have equal hashes."""
    _, inverses = tables(len(sums))
    return mix((sums[end] - sums[start]) * inverses[start])


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of each window of ``size`` bytes, by start."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = prefix(data)
    _, inverses = tables(len(sums))
    return mix((sums[size:] - sums[:n]) * inverses[:n])


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, in order."""
    start, end = word_bounds(data)
    return between(prefix(data), start, end)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def as_bytes(text: str | None) -> np.ndarray:
    """The UTF-8 bytes of a text; null is empty. Lone surrogates can't come out of Spark."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` successive values; with fewer values, one for them all; none for none."""
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + h[k : k + n]
    return mix(out + np.uint64(size))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each window of ``size`` values, by start; running minima from both ends of blocks of that size."""
    n = len(values) - size + 1
    pad = -len(values) % size
    padded = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])
