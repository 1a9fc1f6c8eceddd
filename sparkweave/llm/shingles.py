"""Words and word shingles of an Arrow string column as 64-bit hashes, by NumPy, a slice of rows at a time.

A word's hash is a polynomial in the bytes of the word over the integers modulo 2^64, with a
random 64-bit value per byte, finished by a mixing function. Prefix sums give all words of a
slice at once, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)
_SLOT = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) | U64(1)
#: Bytes of text handled at once; one longer document makes a slice of its own.
SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: For matching across punctuation: ASCII other than letters and digits separates words too.
_PUNCTUATED = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, U64(_BASE))
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps = np.full(size, U64(_INVERSE))
        steps[0] = 1
        _inverses = np.multiply.accumulate(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of some rows: hashes and byte ranges, with row i's words at first[i]:first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    row: int  # of the first row in the batch

    def __len__(self) -> int:
        return len(self.first) - 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows that together hold about SLICE bytes."""
    if not len(column):
        return
    offsets, data = _flat(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def words(column: pa.Array, punctuation: bool = False) -> Iterator[Words]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; with punctuation, ASCII punctuation separates too."""
    gaps = _PUNCTUATED if punctuation else _SPACE
    for row, offsets, data in slices(column):
        n = len(data)
        inside = ~gaps[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edge = offsets[:-1]
            before[edge[edge < n]] = False
            edge = offsets[1:]
            after[edge[edge > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        powers, inverses = _power_tables(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[_LOWER[data]] * powers[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverses[starts])
        yield Words(hashes, starts, ends, np.searchsorted(starts, offsets), row)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = hashes[:n] * _SLOT[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _SLOT[j]
    return mix(total)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-word shingles in order and the position at which each row's begin.

    A row of 1 to k - 1 words has one shingle, the whole sequence; a row without words has none.
    """
    counts = np.diff(w.first)
    every = windows(w.hashes, k)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(w.first[:-1] - first[:-1], sizes) + np.arange(first[-1])
    out = np.empty(first[-1], U64)
    full = np.repeat(counts >= k, sizes)
    out[full] = every[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        out[first[i]] = windows(own, len(own))[0] ^ U64(len(own))
    return out, first
