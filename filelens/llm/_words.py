"""Vectorised hashing of words and runs of words."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Odd multipliers of the rolling hashes (random, fixed).
BYTE_BASE, RUN_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642D
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.multiply.accumulate(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: a run of bytes that aren't ASCII white space."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    np.logical_and(a != 32, a - np.uint8(9) > 4, out=inside[1:-1])  # unsigned: 9 to 13 become 0 to 4
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each word, by differences of one running sum over the text."""
    begin, end = bounds or word_bounds(data)
    if not len(begin):
        return np.zeros(0, np.uint64)
    a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * powers(BYTE_BASE, len(a)), out=total[1:])
    return mix((total[end] - total[begin]) * powers(_inverse(BYTE_BASE), len(a))[begin] + (end - begin).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, base: int = RUN_BASE) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(_inverse(base), len(words))[: len(words) - n + 1])
