"""The binary Golay code of length 23, as tables made from its generator polynomial."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
LENGTH, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for k in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECK_BITS)
    return word


@functools.lru_cache(maxsize=4)
def _tables(radius: int):
    """Syndromes of the bytes of a word; for each syndrome the error patterns of at most ``radius`` bits, flat with offsets."""
    single = [_remainder(1 << k) for k in range(LENGTH)]
    by: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for n in range(radius + 1):
        for at in combinations(range(LENGTH), n):
            s = e = 0
            for k in at:
                s ^= single[k]
                e |= 1 << k
            by[s].append(e)
    parts = np.zeros((3, 256), np.int64)
    for p in range(3):
        for v in range(256):
            if v << 8 * p < 1 << LENGTH:
                parts[p, v] = _remainder(v << 8 * p)
    sizes = np.array([len(x) for x in by], np.int64)
    return parts, np.array([e for x in by for e in x], np.int64), np.concatenate([[0], np.cumsum(sizes)]), sizes


def near_indices(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within ``radius`` bits of each 23-bit word: row numbers, and 12-bit indices.

    The code is perfect: with radius 3 each word has exactly one.  Of two words
    that differ in at most one bit, the codeword within 3 of one lies within 4
    of the other.
    """
    parts, patterns, starts, sizes = _tables(radius)
    s = parts[0, words & 255] ^ parts[1, words >> 8 & 255] ^ parts[2, words >> 16]
    n = sizes[s]
    rows = np.repeat(np.arange(len(words)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] ^ patterns[starts[s][rows] + within]) >> CHECK_BITS
