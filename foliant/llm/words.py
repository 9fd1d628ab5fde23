"""Vectorised words, runs and sketches of text columns.

A *word* is a longest stretch of a-z and 0-9 in the lower-cased text; a *k-run* is k words in a row. All functions
work on slices of an Arrow string array with numpy, without a Python loop over words or documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes handled at once; bounds a worker's memory, whatever the batch or the record size.
SLICE_BYTES = 1 << 20
#: Rows handled at once; a row number must fit in 12 bits.
SLICE_ROWS = 1 << 12
_BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, U)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=U))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


@dataclass
class Words:
    """Words of a slice: ``h`` their hashes, ``doc`` the row of each, ``first`` the index of each row's first word, ``sizes`` their letters."""

    h: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    rows: int
    sizes: np.ndarray

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and word positions of all k-runs, repeated ones included."""
        n = len(self.h)
        if n < k:
            return np.empty(0, U), np.empty(0, np.int64)
        acc = np.zeros(n - k + 1, U)
        for i in range(k):
            acc = acc * U(0xD6E8FEB86659FD93) + self.h[i : n - k + 1 + i]
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return mix(acc[at]), at

    def run_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-runs of each row, in hash order: (row, hash)."""
        h, at = self.runs(k)
        return distinct(self.doc[at], h)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash, in one sort of row and hash packed in a word.

    The hash keeps its upper 52 bits; rows are below ``SLICE_ROWS``.
    """
    packed = np.sort((doc.astype(U) << U(52)) | (h >> U(12)))
    if len(packed):
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    return (packed >> U(52)).astype(np.int64), packed & U((1 << 52) - 1)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of at most ``most`` bytes each, or of one row."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    i = 0
    while i < len(texts):
        j = min(i + SLICE_ROWS, max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1))
        yield i, texts.slice(i, j - i)
        i = j


def words(texts: pa.Array) -> Words:
    """Words of a large_string array without nulls."""
    low = pc.utf8_lower(texts)
    rows = len(low)
    ends = np.frombuffer(low.buffers()[1], np.int64, rows + 1, 8 * low.offset)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = power_tables(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(data * power[: len(data)], out=total[1:])
    h = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(U))
    doc = np.searchsorted(ends, start, "right") - 1
    first = np.searchsorted(start, ends[:-1], "left")
    count = np.diff(np.append(first, len(start)))
    return Words(h, doc, first, count, rows, stop - start)


def hash_word(word: str) -> int:
    """The hash that ``words`` gives a single word."""
    return int(words(pa.array([word], pa.large_string())).h[0])


def lane_minima(doc: np.ndarray, h: np.ndarray, lanes: int, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each lane: (rows, their least lane value, each run's lane value). ``doc`` ascends; rows without runs are left out."""
    if not len(h):
        return
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rng = np.random.default_rng(seed)
    for _ in range(lanes):
        mul, add = U(int(rng.integers(1, 1 << 62)) * 2 + 1), U(int(rng.integers(1, 1 << 62)))
        v = (h ^ add) * mul
        v ^= v >> U(32)
        yield doc[starts], np.minimum.reduceat(v, starts), v


def jaccard(a: pa.Array, b: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row pair: runs in both texts, in a and in b (exact set sizes on 64-bit run hashes)."""
    n = len(a)
    both, na, nb = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = pa.array([x for ab in zip(a.to_pylist(), b.to_pylist(), strict=True) for x in ab], pa.large_string())
    i = 0
    for _, part in pair_slices(pairs):
        doc, h = words(part).run_sets(k)
        sizes = np.bincount(doc, minlength=len(part))
        rows = len(part) // 2
        na[i : i + rows], nb[i : i + rows] = sizes[0::2], sizes[1::2]
        pair = doc // 2
        packed = np.sort((pair.astype(U) << U(52)) | h)
        again = packed[1:][packed[1:] == packed[:-1]]
        both[i : i + rows] = np.bincount((again >> U(52)).astype(np.int64), minlength=rows)
        i += rows
    return both, na, nb


def pair_slices(pairs: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """``slices`` that keep rows 2 n and 2 n + 1 together."""
    pairs = pc.fill_null(pairs, "")
    ends = np.frombuffer(pairs.buffers()[1], np.int64, len(pairs) + 1, 8 * pairs.offset)
    i = 0
    while i < len(pairs):
        j = min(i + SLICE_ROWS, max(i + 2, int(np.searchsorted(ends, ends[i] + SLICE_BYTES, "right")) - 1))
        j -= (j - i) % 2
        yield i, pairs.slice(i, j - i)
        i = j
