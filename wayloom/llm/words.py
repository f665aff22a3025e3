"""Words and n-grams of Arrow text columns as numpy arrays, hashed without a Python object per word.

A text is its UTF-8 bytes; words are runs of bytes other than 0x20 and 0x09-0x0D. Range hashes come from one
prefix sum of a polynomial over randomised byte values (modulo 2^64), so a whole slice of documents is
hashed in a few array passes. Slices are bounded in bytes (a longer text is a slice of its own), which
bounds the memory of a task whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once, about.
SLICE_BYTES = 1 << 18
SLICE_ROWS = 512

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.ones(1 << max(12, (n - 1).bit_length()), np.uint64)
        p[1:] = _U(base)
        p = np.cumprod(p)
        if len(p) <= 1 << 22:
            _powers[base] = p
    return p[:n]


class Slice(NamedTuple):
    """Rows ``first`` to ``first + rows`` of a batch: their bytes and where each document begins (rows + 1 offsets)."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES, most: int = SLICE_ROWS) -> Iterator[Slice]:
    """Slices of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield Slice(i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def word_bounds(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in order; no word crosses documents."""
    inside = np.zeros(len(s.data) + 2, bool)
    np.logical_not(SPACE[s.data], out=inside[1:-1])
    edges = s.offsets[(s.offsets < len(s.data))]
    before = inside[:-1].copy()
    before[edges] = False
    starts = np.flatnonzero(inside[1:-1] & ~before[:-1])
    after = inside[1:].copy()
    after[s.offsets] = False
    ends = np.flatnonzero(inside[:-1][1:] & ~after[1:]) + 1 if len(s.data) else starts
    return starts, ends


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(n + 1)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(n + 1, _INV)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ngrams(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams, and their bounds by document; with fewer words the whole sequence is one."""
    counts = np.diff(bounds)
    size = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    n = len(words)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h[: n - j] = h[: n - j] * _U(0x2545F4914F6CDD1D) + words[j:] if j else words
        if n - j <= 0:
            break
    at = np.repeat(bounds[:-1] - out_bounds[:-1], size) + np.arange(out_bounds[-1])
    out = h[at]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        x = 0
        for w in words[bounds[d] : bounds[d + 1]].tolist():
            x = (x * 0x2545F4914F6CDD1D + w + 0x51) & (2**64 - 1)
        out[out_bounds[d]] = x ^ int(counts[d])
    return mix(out), out_bounds


def hashed_words(s: Slice, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, starts, ends, bounds by document) with A-Z lower-cased."""
    starts, ends = word_bounds(s)
    data = LOWER[s.data] if lower else s.data
    return range_hash(data, starts, ends), starts, ends, np.searchsorted(starts, s.offsets)
