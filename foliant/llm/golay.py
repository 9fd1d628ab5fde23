"""The binary Golay code [23, 12, 7] and the keys it gives a 23-bit fingerprint segment.

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. With ``reach`` 4, a word at
distance 3 from its codeword has five more codewords at distance 4, so it has six keys; two words that differ in at
most two bits then always share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, GENERATOR = 23, 0xAE3


@cache
def remainders() -> np.ndarray:
    """Remainder by the generator polynomial of each word whose 12 upper bits count from 0 and whose others are 0."""
    x = np.arange(4096, dtype=np.int64) << 11
    for bit in range(BITS - 1, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def syndrome(x: np.ndarray) -> np.ndarray:
    return (x & 2047) ^ remainders()[x >> 11]


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of up to 3 bits, and the five errors of 4 bits (-1 where there are none)."""
    near, far = np.full(2048, -1, np.int64), np.full((2048, 5), -1, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(BITS), weight)], np.int64)
        for s, e in zip(syndrome(errors).tolist(), errors.tolist(), strict=True):
            if weight < 4:
                near[s] = e
            elif (free := np.flatnonzero(far[s] < 0)).size:
                far[s, free[0]] = e
    return near, far


def keys(x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in x, codeword index) of every codeword within ``reach`` (3 or 4) bits of each word."""
    at = np.arange(len(x))
    near, far = tables()
    s = syndrome(x)
    index = (x ^ near[s]) >> 11
    if reach == 3:
        return at, index
    more = far[s]
    row, col = np.nonzero(more >= 0)
    return np.concatenate([at, row]), np.concatenate([index, (x[row] ^ more[row, col]) >> 11])
