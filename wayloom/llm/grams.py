"""Hashed byte-n-gram counts of whole texts, as one float row per document."""

from __future__ import annotations

import numpy as np

from . import words as W

#: Letters stay (lower-cased), bytes of other alphabets stay, all else becomes a blank.
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[128:] = np.arange(128, 256)
PLAIN[97:123] = np.arange(97, 123)
PLAIN[65:91] = np.arange(97, 123)


def gram_counts(s: W.Slice, sizes: tuple[int, ...], bits: int, fold: np.ndarray | None = PLAIN) -> np.ndarray:
    """(rows, 2^bits) counts of the byte n-grams of each document; every document stands between blanks.

    ``fold`` maps bytes first; runs of blanks count once.
    """
    width = 1 << bits
    lengths = np.diff(s.offsets)
    # each document as blank + text + blank
    data = np.full(len(s.data) + 2 * s.rows, 0x20, np.uint8)
    doc = np.repeat(np.arange(s.rows, dtype=np.int64), lengths + 2)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    at = np.ones(len(data), bool)
    at[starts] = False
    at[starts + lengths + 1] = False
    data[at] = s.data if fold is None else fold[s.data]
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (doc[1:] != doc[:-1])
    data, doc = data[keep].astype(np.uint64), doc[keep]
    out = np.zeros((s.rows, width), np.float32)
    for k in sizes:
        n = len(data) - k + 1
        if n <= 0:
            continue
        code = np.full(n, k, np.uint64)
        for j in range(k):
            code = (code << np.uint64(8)) | data[j : j + n]
        bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        whole = doc[:n] == doc[k - 1 :]
        index = (doc[:n] * width + bucket)[whole]
        out += np.bincount(index, minlength=s.rows * width).reshape(s.rows, width)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + 1


def log_tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts, dtype=np.float32)
