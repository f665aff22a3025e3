"""Operator 4: near-duplicate passages by compact windows.

A document is its sequence of five-word shingles. For each of ``HASHES`` hash functions, the Cartesian tree over the
shingles' hashes groups all passages that share their minimum: a node at c that is the minimum of (l, r) stands for
every passage from l..c to c..r, and only nodes whose span reaches the least length matter; there are
about two for each ``least`` shingles. Two passages with a similarity J share a hash function's minimum with
probability J, so passages of two documents meet under equal (function, minimum) values.

Hashes are uniform: no shingle is preferred, so an edited copy of a common passage meets it like any other. What keeps a
line that is everywhere from pairing all documents is the key: the minimum together with the ``AROUND`` equal
shingles on each of its sides. A passage of the least length keeps runs of 20 shingles at a similarity of 0.8, in which
14 places are such minima. So one key of the four functions finds such a passage with a probability of about 0.96, and a
longer or a less edited one, with more places, with a larger one.

Documents of equal texts are one (the smallest id); the others take its class, and their whole text is a passage. Windows
that share their key with another document are kept, and compared in two rounds that grow with the windows, not with
their square: each with the first document of its key; then windows that no verified span holds well inside (they may
belong to another near copy, or their passage may go on beyond what the first document has) with their ``NEXT`` next
ones in an order by a hash of id and key, which differs from key to key. Keys of many windows are cut into chunks of
``CHUNK`` in that order, so no task holds one. What the two rounds leave open is decided exactly (``_rest``): a window
whose centre is in no verified span meets all windows of its key, and so do windows whose documents are of another class
than most of their key; only two windows that both have a span and whose documents are linked already are not compared. These
comparisons are made in blocks of ``BLOCK`` by ``BLOCK`` windows, on the shingles near their centres, and a block returns
verified pairs only. The windows of a pair are joined as intervals and verified on the shingles themselves: the aligned windows' Jaccard similarity, or the best run that reaches it, along a diagonal or along
a chain of equal shingles over several diagonals (where words are inserted or deleted).

Results for odd input: null, empty and short texts (fewer words than a passage) have no passage; rows with a
null id are left out; rows that repeat an id are one document whose first text (by text) is taken; passages
repeated within one document only don't count; of spans that overlap the longest stands for the passage, beside the extent
of all of them (the class has the links to all their partners, components are computed before); very long texts are read whole, places are 32-bit; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .common import drop, joined_components, keep, restrict, scratch, small_batches, stored
from .mixing import token_count

WORDS = 5
#: Least passage: 50 words, so 46 shingles.
LEAST = 46
HASHES = 4
PERCENT = 80
#: Equal shingles on each side of a minimum.
AROUND = 3
#: Comparisons of a window in the second round, and windows of a key that are ordered together.
NEXT = 3
CHUNK = 512
#: Shingles of pairs that are prepared together for verification.
TOGETHER = 1 << 18
#: Windows on either side of a block of the last round, and how far from its centre it looks: the longest partner of a least passage.
BLOCK = 256
NEAR = LEAST * 100 // PERCENT

WINDOWS = "key long, id long, c int, back int, ahead int"


def centres(key: np.ndarray, doc: np.ndarray, least: int, bits: int) -> np.ndarray:
    """Positions, in order, that are the minimum of some ``least`` consecutive keys within a document: block-wise prefix
    and suffix minima give all sliding minima in a few passes, and these never go back. Keys are distinct and end in their
    position, ``bits`` long."""
    n = len(key)
    if n < least:
        return np.zeros(0, np.int64)
    blocks = -(-n // least)
    full = np.full(blocks * least, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(blocks, least)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suffix[: n - least + 1], prefix[least - 1 : n])
    low = low[doc[: n - least + 1] == doc[least - 1 :]]
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    return (low[change] & np.uint64((1 << bits) - 1)).astype(np.int64)


def spans(c: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centre the widest [l, r] of which it is the minimum. The nearest smaller keys of a centre are centres
    themselves or lie outside the document. All look for theirs at once: where the one looked at is larger, so is all that it
    has passed over, and the next to look at is the one where it stands itself."""
    n = len(c)
    if not n:
        return c, c
    new = np.ones(n, bool)
    new[1:] = begin[1:] != begin[:-1]
    at = np.arange(n) + np.cumsum(new)  # a place with the least key stands before each document, and at the end
    keys, places = np.zeros(int(at[-1]) + 2, np.uint64), np.full(int(at[-1]) + 2, -1)
    keys[at], places[at] = key[c], c

    def nearest(step: int, beyond: np.ndarray) -> np.ndarray:
        look = np.arange(len(keys)) + step
        larger = at[keys[look[at]] > keys[at]]
        while len(larger):
            look[larger] = look[look[larger]]
            larger = larger[keys[look[larger]] > keys[larger]]
        found = places[look[at]]
        return np.where(found < 0, beyond, found)

    return nearest(-1, begin - 1) + 1, nearest(1, end) - 1


def compact_windows(s: W.Slice, hashes: int = HASHES, least: int = LEAST, k: int = WORDS, around: int = AROUND):
    """(function, key, document, l, c, r) arrays of a slice's compact windows; without a key where the document ends within
    ``around`` places of the minimum (the key is 0 then)."""
    words, _, _, bounds = W.hashed_words(s)
    grams, gram_bounds = W.ngrams(words, bounds, k)
    n = len(grams)
    doc = np.repeat(np.arange(s.rows), np.diff(gram_bounds))
    place = np.arange(n, dtype=np.uint64)
    bits = np.uint64(max(24, n.bit_length()))
    block = np.zeros(n, np.uint64)
    for j in range(2 * around + 1):
        block[: max(0, n - j)] = block[: max(0, n - j)] * np.uint64(0x9FB21C651E98DF25) + grams[j:]
    out = []
    for f in range(hashes):
        h = W.mix(grams ^ np.uint64((f + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        key = (h >> bits << bits) | place
        c = centres(key, doc, least, int(bits))
        l, r = spans(c, key, gram_bounds[doc[c]], gram_bounds[doc[c] + 1])
        # of a shingle that comes back at short intervals (a repeated word or line) the first window reaches over all
        again = (l > gram_bounds[doc[c]]) & (grams[np.maximum(l - 1, 0)] == grams[c]) & (c - l + 1 < least)
        c, l, r = c[~again], l[~again], r[~again]
        base, end = gram_bounds[doc[c]], gram_bounds[doc[c] + 1]
        whole = (c - around >= base) & (c + around < end)
        name = np.where(whole, W.mix(block[np.maximum(c - around, 0)] + np.uint64(f + 1)) | np.uint64(1), np.uint64(0))
        out.append((np.full(len(c), f), name.view(np.int64), doc[c], l - base, c - base, r - base))
    return [np.concatenate(x) for x in zip(*out)]


def _windows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for s in W.slices(b.column("text")):
                _, name, doc, l, c, r = compact_windows(s)
                l, c, r, name, doc = (x[name != 0] for x in (l, c, r, name, doc))
                places = (pa.array(x.astype(np.int32)) for x in (c, c - l, r - c))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(ids[s.first + doc]), *places], ["key", "id", "c", "back", "ahead"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, WINDOWS)


def _sequences(docs: DataFrame) -> DataFrame:
    """(id, s): the shingle hashes of each document in order, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in W.slices(b.column("text")):
                words, _, _, bounds = W.hashed_words(s)
                grams, gram_bounds = W.ngrams(words, bounds, WORDS)
                values = (grams >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.rows), pa.ListArray.from_arrays(pa.array(gram_bounds.astype(np.int32)), pa.array(values))], ["id", "s"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id long, s array<int>")


def coded(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of pairs (the k-th at[k]..at[k + 1] of ``a`` and to[k]..to[k + 1] of ``b``) with the distinct shingles of 32 bits
    as numbers, rising from pair to pair, and the first number of each pair: one sort of pair, value and place."""
    n, pairs = len(a) + len(b), np.arange(len(at) - 1, dtype=np.uint64)
    bits = np.uint64(max(24, n.bit_length()))  # as many pairs as 8 bits hold, or a single one
    keys = np.concatenate([a, b]).astype(np.uint32).astype(np.uint64) << bits | np.arange(n, dtype=np.uint64)
    keys |= np.concatenate([pairs.repeat(np.diff(at)), pairs.repeat(np.diff(to))]) << (bits + np.uint64(32))
    keys.sort()
    place = (keys & np.uint64((1 << int(bits)) - 1)).view(np.int64)
    keys >>= bits
    rank = np.zeros(n, np.int64)
    np.cumsum(keys[1:] != keys[:-1], out=rank[1:])
    codes = np.empty(n, np.int64)
    codes[place] = rank
    return codes[: len(a)], codes[len(a) :], np.append(rank[(at + to - at[0] - to[0])[:-1]], rank[-1] + 1)


def coded_pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    x, y, first = coded(x, np.array([0, len(x)]), y, np.array([0, len(y)]))
    return x, y, int(first[1])


def marks(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n codes are in ``x``."""
    out = np.zeros(n, bool)
    out[x] = True
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT, codes: int | None = None) -> bool:
    """Whether the sets reach the similarity; ``codes``: how many there are, if both are coded."""
    if codes is None:
        x, y, codes = coded_pair(x, y)
    in_x, in_y = marks(x, codes), marks(y, codes)
    return np.count_nonzero(in_x & in_y) * 100 >= np.count_nonzero(in_x | in_y) * percent


def chained(x: np.ndarray, y: np.ndarray, off: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a longest chain of equal shingles (coded) that rises in both; a shingle with several places in ``y``
    takes the one nearest to the diagonal i - j = off."""
    place = np.full(codes, -1)
    place[y] = every = np.arange(len(y))
    if (place[y] == every).all():  # each has one place
        j = place[x]
        i = np.flatnonzero(j >= 0)
        return _rising(i, j[i])
    order = np.argsort(y, kind="stable")
    values, first = np.unique(y[order], return_index=True)
    rank = np.minimum(np.searchsorted(values, x), len(values) - 1)
    i = np.flatnonzero(values[rank] == x)
    if not len(i):
        return i, i
    stops = np.append(first, len(y))
    width = len(y) + 1
    keys = np.repeat(np.arange(len(values)), np.diff(stops)) * width + order
    want = rank[i] * width + np.clip(i - off, 0, len(y) - 1)
    after = np.clip(np.searchsorted(keys, want), first[rank[i]], stops[rank[i] + 1] - 1)
    before = np.maximum(after - 1, first[rank[i]])
    return _rising(i, order[np.where(np.abs(keys[before] - want) <= np.abs(keys[after] - want), before, after)])


def _rising(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a longest chain in which j rises as i does."""
    if (j[1:] > j[:-1]).all():
        return i, j
    tails, at, back = [], [], []  # patience sorting
    for k, v in enumerate(j.tolist()):
        t = bisect_left(tails, v)
        back.append(at[t - 1] if t else -1)
        tails[t : t + 1], at[t : t + 1] = [v], [k]
    k, path = at[-1], []
    while k >= 0:
        path.append(k)
        k = back[k]
    return i[path[::-1]], j[path[::-1]]


def _grown(p: int, q: int, n: int, least: int) -> tuple[int, int]:
    """A range within 0..n of ``least`` places or more."""
    q = max(q, min(p + least, n))
    return min(p, max(q - least, 0)), q


def longest_chain(x: np.ndarray, y: np.ndarray, off: int, least: int = LEAST, percent: int = PERCENT, codes: int | None = None) -> tuple[int, int, int, int] | None:
    """The longest (x from, x to, y from, y to) over several diagonals that keeps the similarity: a stretch of m of the chain's
    places has m / (n - m), with n the lengths of both sides. One that is a little too short grows into its context."""
    if codes is None:
        x, y, codes = coded_pair(x, y)
    i, j = chained(x, y, off, codes)
    few = 2 * least * percent / (100 + percent)
    if len(i) < few:
        return None
    gain = (100 + percent) * np.arange(len(i)) - percent * (i + j)
    ahead = np.maximum.accumulate(gain[::-1])
    last = len(i) - 1 - np.searchsorted(ahead, gain - (100 - percent))
    starts = np.flatnonzero(last - np.arange(len(i)) + 1 >= few)
    starts = starts[np.argsort(i[starts] - i[last[starts]], kind="stable")]
    n = 0
    while n < len(starts):  # only repeated shingles make the first one fail
        k, e = starts[n], last[starts[n]]
        p, q = _grown(int(i[k]), int(i[e]) + 1, len(x), least)
        u, v = _grown(int(j[k]), int(j[e]) + 1, len(y), least)
        if min(q - p, v - u) >= least and similar(x[p:q], y[u:v], percent, codes):
            return p, q, u, v
        n += max(1, n // 4)
    return None


def verified(a: np.ndarray, b: np.ndarray, windows: np.ndarray, least: int = LEAST, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """Spans (a from, a to, b from, b to; ends exclusive) of near-duplicate passages, from a pair's windows
    (rows l, c, r in a; l, c, r in b)."""
    one = (np.array([0, len(x)]) for x in (a, b, windows))
    return [found for _, *found in verified_pairs(a, next(one), b, next(one), windows, next(one), least, percent)]


def verified_pairs(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, windows: np.ndarray, bounds: np.ndarray, least: int = LEAST, percent: int = PERCENT) -> Iterator[tuple[int, int, int, int, int]]:
    """(pair, a from, a to, b from, b to; ends exclusive) of near-duplicate passages, from the windows of pairs (rows l, c, r in a;
    l, c, r in b). The k-th pair's shingles (of 32 bits) are at[k]..at[k + 1] of ``a`` and to[k]..to[k + 1] of ``b``, its windows
    bounds[k]..bounds[k + 1]; pairs of ``TOGETHER`` shingles are prepared in the same array passes."""
    ends, i = at + to, 0
    while i < len(at) - 1:
        j = max(i + 1, min(int(np.searchsorted(ends, ends[i] + TOGETHER, "right")) - 1, i + 256))
        part = slice(i, j + 1)
        for k, *found in _verified(a[at[i] : at[j]], at[part] - at[i], b[to[i] : to[j]], to[part] - to[i], windows[bounds[i] : bounds[j]], bounds[part] - bounds[i], least, percent):
            yield i + k, *found
        i = j


def _verified(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, windows: np.ndarray, bounds: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, int, int, int, int]]:
    """A window that shares too few shingles with all of the other side to hold such a passage is passed over by running counts. A
    passage may have words inserted or deleted, so each side reaches further than the other, by what the similarity allows.
    Windows of equal reach are looked at once."""
    pair = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    if not len(pair):
        return
    a, b, first = coded(a, at, b, to)
    shared = np.zeros(len(a) + 1, np.int64)
    np.cumsum(marks(b, int(first[-1]))[a], out=shared[1:])
    a, b, codes = a - first[:-1].repeat(np.diff(at)), b - first[:-1].repeat(np.diff(to)), np.diff(first).tolist()
    la, ca, ra, lb, cb, rb = windows.T
    lo, hi = np.minimum(ca - la, cb - lb), np.minimum(ra - ca, rb - cb)
    begin, end, off = ca - lo, ca + hi + 1, ca - cb
    wide_a, wide_b = ((r - l + 1) * (100 - percent) // percent for l, r in ((la, ra), (lb, rb)))
    a_from = np.maximum(np.maximum(la, ca - (cb - lb + wide_b)), 0)
    a_to = np.minimum(np.minimum(ra, ca + (rb - cb + wide_b)) + 1, np.diff(at)[pair])
    b_from = np.maximum(np.maximum(lb, cb - (ca - la + wide_a)), 0)
    b_to = np.minimum(np.minimum(rb, cb + (ra - ca + wide_a)) + 1, np.diff(to)[pair])
    base, size = at[pair], end - begin
    held, around = shared[base + end] - shared[base + begin], shared[base + a_to] - shared[base + a_from]
    cost = 2.0 * percent / (100 - percent)  # m matches of n: J = m / (2n - m)
    few = least * cost / (1 + cost)  # matches of the shortest passage
    whole = (size >= least) & ((held * 100 >= size * percent) | (held < few))
    order = np.lexsort((-size, off, pair))
    order = order[(whole | (around >= few))[order]]
    reach = np.stack([begin, end, off, a_from, a_to, b_from, b_to, held, around, whole], axis=1)[order].tolist()
    ca, cb, stops = ca[order], cb[order], np.searchsorted(pair[order], np.arange(len(at)))
    inside = np.zeros(len(order), bool)
    for n in np.flatnonzero(stops[1:] > stops[:-1]).tolist():
        start, stop = int(stops[n]), int(stops[n + 1])
        own_a, own_b, seen = a[at[n] : at[n + 1]], b[to[n] : to[n + 1]], set()
        for k in range(start, stop):
            p, q, d, f, t, g, h, held, around, whole = reach[k]
            if inside[k] or (p, q, d, f, t, g, h) in seen:
                continue
            seen.add((p, q, d, f, t, g, h))
            x, y = own_a[p:q], own_b[p - d : q - d]
            best = None
            if whole and (held >= few or held * 100 >= np.count_nonzero(marks(x, codes[n])) * percent) and similar(x, y, percent, codes[n]):
                best = (p, q, p - d, q - d)  # the whole of both windows as aligned at the centre
            elif around >= few:
                # the longest run along the diagonal through the centre in which the matches outweigh the misses
                same = x == y
                matches = np.count_nonzero(same)
                if matches >= few:
                    sums = np.zeros(q - p + 1)
                    np.where(same, 1.0, -cost).cumsum(out=sums[1:])
                    ahead = np.maximum.accumulate(sums[::-1])  # the largest sum from each place on, from the end
                    last = q - p - ahead.searchsorted(sums - 1e-9)
                    i = int((last - np.arange(len(sums))).argmax())
                    e = int(last[i])
                    if e - i >= least and similar(x[i:e], y[i:e], percent, codes[n]):
                        best = (p + i, p + e, p + i - d, p + e - d)
                if around > matches:  # matches off the diagonal: words inserted or deleted
                    chain = longest_chain(own_a[f:t], own_b[g:h], d - f + g, least, percent, codes[n])
                    if chain and (best is None or chain[1] - chain[0] > best[1] - best[0]):
                        best = (chain[0] + f, chain[1] + f, chain[2] + g, chain[3] + g)
            if best:
                yield n, *best
                if k + 1 < stop:
                    u, v = ca[k:stop], cb[k:stop]
                    inside[k:stop] |= (best[0] <= u) & (u < best[1]) & (best[2] <= v) & (v < best[3])


def _side(x: str) -> Column:
    return F.struct(*(F.col(f"{c}{x}").alias(c) for c in ("id", "c", "back", "ahead")))


def _agreements(pairs: DataFrame) -> DataFrame:
    """The window pairs (a, b: structs of id, c, back, ahead) of the sides 1 and 2 that may hold a passage, a's id the smaller."""
    reach = F.least("back1", "back2") + F.least("ahead1", "ahead2") + 1
    pairs = pairs.where((F.col("id1") != F.col("id2")) & (reach >= LEAST * 2 * PERCENT / (100 + PERCENT)))  # aligned at the centre, they hold a passage's matches
    return pairs.select(F.least(_side("1"), _side("2")).alias("a"), F.greatest(_side("1"), _side("2")).alias("b"))


def _verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, partner, start, stop, partner_start, partner_stop) spans in shingles, a row for either side, from all agreements of the pairs."""
    ranges = []
    for x, y in ("ab", "ba"):  # as far as words inserted on this side may reach
        more = F.floor((F.col(f"{y}.back") + F.col(f"{y}.ahead") + 1) * (100 - PERCENT) / PERCENT)
        ranges += [F.min(F.col(f"{x}.c") - F.least(f"{x}.back", F.col(f"{y}.back") + more)).cast("int").alias(f"from_{x}"), F.max(F.col(f"{x}.c") + F.least(f"{x}.ahead", F.col(f"{y}.ahead") + more)).cast("int").alias(f"to_{x}")]
    places = F.struct(*(F.col(f"{x}.{c}").alias(f"{c}{x}") for x in "ab" for c in ("c", "back", "ahead")))
    whole = pairs.groupBy(F.col("a.id").alias("ia"), F.col("b.id").alias("ib")).agg(F.collect_set(places).alias("w"), *ranges)
    whole = stored(whole, "pairs")
    ids = stored(whole.select(F.col("ia").alias("id")).union(whole.select("ib")).distinct(), "ids")
    sequences = stored(_sequences(restrict(rows, ids, "id")), "sequences")

    def side(df: DataFrame, x: str) -> DataFrame:
        part = F.slice("s", F.col(f"from_{x}") + 1, F.col(f"to_{x}") - F.col(f"from_{x}") + 1)
        return df.join(sequences.withColumnRenamed("id", f"i{x}"), f"i{x}").withColumn(f"s{x}", part).drop("s", f"to_{x}")

    both = side(side(whole, "b"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = []
            lists = t.column("w")
            fields = lists.flatten()
            ends = []
            for side in "ab":
                c, back, ahead = (fields.field(f"{n}{side}").to_numpy(zero_copy_only=False).astype(np.int64) for n in ("c", "back", "ahead"))
                ends += [c - back, c, c + ahead]
            windows = np.stack(ends, axis=1)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            (xs, at), (ys, to) = ((t.column(n).values.to_numpy(), t.column(n).offsets.to_numpy()) for n in ("sa", "sb"))
            begin = np.stack([t.column(n).to_numpy() for n in ("from_a", "from_b")], axis=1).repeat(3, axis=1)
            windows -= begin.repeat(np.diff(bounds), axis=0)
            i, j, fa, fb = (t.column(n).to_pylist() for n in ("ia", "ib", "from_a", "from_b"))
            for k, p, q, u, v in verified_pairs(xs, at, ys, to, windows, bounds):
                span, other = (p + fa[k], q + fa[k]), (u + fb[k], v + fb[k])
                rows += [(i[k], j[k], *span, *other), (j[k], i[k], *other, *span)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 2 + (pa.int32(),) * 4)], ["id", "partner", "start", "stop", "partner_start", "partner_stop"])

    small_batches(pairs.sparkSession, 200)
    out = stored(both.mapInArrow(run, "id long, partner long, start int, stop int, partner_start int, partner_stop int"), "spans")
    drop(whole, ids, sequences)
    return out


def chosen(found: DataFrame) -> DataFrame:
    """(id, start, stop, partner, partner_start, partner_stop, low, high): a document's passages, each with its longest verified span
    (the smallest start and partner on ties) and the extent of all spans that belong to it: those that begin within what came before
    and add no more than the similarity leaves open at the ends of a span."""
    span = Window.partitionBy("id").orderBy("start", F.desc("stop"), "partner", "partner_start", "partner_stop")
    reach = F.max("stop").over(span.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("start") > reach) | (F.col("stop") - reach > LEAST * (100 - PERCENT) // 100)
    rows = found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("passage", F.sum("new").over(span.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct((F.col("start") - F.col("stop")).alias("size"), "start", "partner", "partner_start", "stop", "partner_stop")).alias("s")
    out = rows.groupBy("id", "passage").agg(best, F.min("start").alias("low"), F.max("stop").alias("high"))
    return out.select("id", *(f"s.{c}" for c in ("start", "stop", "partner", "partner_start", "partner_stop")), "low", "high")


def merged(found: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch become one, with the smallest partner."""
    rows = found.groupBy("id", "start").agg(F.max("stop").alias("stop"), F.min("partner").alias("partner"))
    before = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(Window.partitionBy("id").orderBy("start")))
    return rows.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("partner").alias("partner")).drop("island")


def _first_round(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows that share their key with another document, with its first one and its count; pairs with the first."""
    keys = windows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    keys = stored(keys.where("first < last").select("key", "n"), "keys")
    shared = stored(windows.join(keys, "key"), "shared")
    lead = F.min(F.struct("id", "c", "back", "ahead")).alias("lead")
    leads = shared.groupBy("key").agg(lead)
    shared_ = stored(shared.join(leads, "key"), "shared")
    drop(keys, shared)
    pairs = shared_.where("id <> lead.id").select(*(F.col(c).alias(f"{c}1") for c in ("id", "c", "back", "ahead")), *(F.col(f"lead.{c}").alias(f"{c}2") for c in ("id", "c", "back", "ahead")))
    return shared_, _agreements(pairs)


def _second_round(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of the windows that aren't well inside a verified span with their next ones, the keys' first windows left out."""
    rest = shared.where((F.col("id") != F.col("lead.id")) | (F.col("c") != F.col("lead.c"))).drop("lead")
    inside = merged(found).select(F.col("id").alias("i"), "start", "stop")
    half = LEAST // 2
    within = (F.col("id") == F.col("i")) & (F.col("c") - half >= F.col("start")) & (F.col("c") + half < F.col("stop"))
    held = stored(rest.join(inside, within, "left_semi").select("key", "id", "c").distinct(), "held")
    marked = rest.join(held.withColumn("held", F.lit(True)), ["key", "id", "c"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    marked = marked.withColumn("h", F.xxhash64("id", "key")).withColumn("chunk", F.pmod("h", F.ceil(F.col("n") / CHUNK)))
    order = Window.partitionBy("key", "chunk").orderBy("h", "c", "back", "ahead")
    one = F.struct("id", "c", "back", "ahead", "held")
    near = marked.select("id", "c", "back", "ahead", "held", F.array(*(F.lag(one, k).over(order) for k in range(1, NEXT + 1))).alias("near"))
    near = near.withColumn("other", F.explode("near")).where("other is not null and not (held and other.held)")
    return _agreements(near.select(*(F.col(c).alias(f"{c}1") for c in ("id", "c", "back", "ahead")), *(F.col(f"other.{c}").alias(f"{c}2") for c in ("id", "c", "back", "ahead"))))


class Block:
    """Windows on one side of a block: arrays by window, and their shingles near the centre, the i-th from bounds[i] on."""

    FIELDS = ("id", "c", "back", "ahead", "class", "covered")

    def __init__(self, windows: pa.StructArray):
        self.at = {n: windows.field(n).to_numpy(zero_copy_only=False) for n in self.FIELDS}
        s = windows.field("s")
        self.values, self.bounds = s.values.to_numpy(), s.offsets.to_numpy()

    def near(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    def centre(self, i: int) -> int:
        return min(int(self.at["back"][i]), NEAR)


def _fits(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row of ``same`` (places by column) has a stretch with the matches of some passage, and with those of the
    shorter one of two: of n places (P / (100 + P)) * (n + LEAST) and (P / (100 + P)) * 2n."""
    n = same.shape[1]
    if n < LEAST:
        return (np.zeros(len(same), bool),) * 2
    sums = np.zeros((len(same), n + 1), np.int32)
    np.cumsum(same, axis=1, out=sums[:, 1:])

    def most(each: int) -> np.ndarray:  # of matches less what a place costs, over all stretches of LEAST places or more
        score = sums * (100 + PERCENT) - each * np.arange(n + 1, dtype=np.int32)
        return (score[:, LEAST:] - np.minimum.accumulate(score[:, : n + 1 - LEAST], axis=1)).max(axis=1)

    return most(PERCENT) >= PERCENT * LEAST, most(2 * PERCENT) >= 0


def compared(left: Block, right: Block) -> Iterator[tuple[int, int]]:
    """(i, j) of windows that hold a passage in common: of each left window the closest right one of each class. What can't hold
    one is passed over by counts of equal shingles, which never are too small."""
    few = -(-2 * LEAST * PERCENT // (100 + PERCENT))
    owner = np.repeat(np.arange(len(right.bounds) - 1), np.diff(right.bounds))
    values = right.values[right.bounds[0] : right.bounds[-1]]
    start = NEAR - np.minimum(right.at["back"], NEAR) - (right.bounds[:-1] - right.bounds[0])
    grid = np.full((len(start), 2 * NEAR + 1), 1 << 40)  # the shingles of all, their centres below each other
    grid[owner, np.arange(len(values)) + start[owner]] = values
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    l, r = left.at, right.at
    for i in range(len(left.bounds) - 1):
        may = (r["id"] != l["id"][i]) & (np.minimum(r["back"], l["back"][i]) + np.minimum(r["ahead"], l["ahead"][i]) + 1 >= few)
        if l["covered"][i]:
            may &= r["covered"] & (r["class"] != l["class"][i])
        x, at = left.near(i), left.centre(i)
        low, high = np.searchsorted(values, x), np.searchsorted(values, x, "right")
        n = high - low
        hits = owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.bincount(hits, minlength=len(may))
        may &= total >= few
        rows = np.flatnonzero(may)
        if not len(rows):
            continue
        row = np.full(len(may), -1)
        row[rows] = np.arange(len(rows))
        same = np.zeros((len(rows), len(x)), bool)
        place, kept = np.repeat(np.arange(len(x)), n), may[hits]
        same[row[hits[kept]], place[kept]] = True
        longer, shorter = _fits(same)
        rows, shorter = rows[longer], shorter[longer]
        also, brief = _fits(np.isin(grid[rows], x))
        rows = rows[also & shorter | brief]
        done = set()
        for j in rows[np.lexsort((r["c"][rows], r["id"][rows], -total[rows]))].tolist():
            y = right.near(j)
            if r["class"][j] not in done and verified(x, y, np.array([[0, at, len(x) - 1, 0, right.centre(j), len(y) - 1]])):
                done.add(r["class"][j])
                yield i, j


def _rest(shared: DataFrame, found: DataFrame, linked: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of the windows that both rounds left open, each of them verified near the centres.

    Open is a window whose centre is in no span (keys of few windows have been compared as a whole), and one with a span whose
    document isn't in the class of most such windows of its key. The former meets all windows of the key, the latter all that
    have a span and another class."""
    spans = merged(found).select(F.col("id").alias("i"), "start", "stop")
    within = (F.col("id") == F.col("i")) & (F.col("c") >= F.col("start")) & (F.col("c") < F.col("stop"))
    windows = shared.drop("lead")
    covered = stored(windows.join(spans, within, "left_semi").select("key", "id", "c").distinct(), "covered")
    marked = windows.join(covered.withColumn("covered", F.lit(True)), ["key", "id", "c"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    marked = marked.join(linked.select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id"))
    marked = stored(marked, "marked")
    drop(covered)
    few = F.col("n") <= NEXT + 2
    sizes = marked.groupBy("key", "class").agg(F.count_if("covered").alias("size"), F.count_if(~F.col("covered") & ~few).alias("loose"))
    keys = sizes.groupBy("key").agg(F.max_by("class", F.struct("size", -F.col("class"))).alias("main"), (F.sum("loose") + F.sum("size") - F.max("size")).alias("open")).where("open > 0")
    marked_ = stored(marked.join(stored(keys, "keys"), "key"), "marked")
    drop(marked)
    ids = stored(marked_.select("id").distinct(), "ids")
    one = F.struct(*Block.FIELDS, "s")
    back = F.least("back", F.lit(NEAR))
    near = marked_.join(_sequences(restrict(rows, ids, "id")), "id").withColumn("s", F.slice("s", F.col("c") - back + 1, back + F.least("ahead", F.lit(NEAR)) + 1))
    part = lambda n: F.pmod(F.xxhash64("id", "key", "c"), F.ceil(F.col(n) / BLOCK))
    near = near.withColumn("is_open", F.when(F.col("covered"), F.col("class") != F.col("main")).otherwise(~few)).withColumn("chunk", part("n"))
    near = stored(near.select("key", "n", "open", "chunk", "is_open", one.alias("one"), part("open").alias("part")), "near", "zstd")
    drop(marked_, ids)
    right = near.groupBy("key", "chunk").agg(F.collect_list("one").alias("right"))
    left = near.where("is_open").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)))
    left = left.groupBy("key", "chunk", "part").agg(F.collect_list("one").alias("left"))
    names = [f"{c}{x}" for x in "12" for c in ("id", "c", "back", "ahead")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for k in range(t.num_rows):
                a, b = (Block(t.column(x).slice(k, 1).flatten()) for x in ("left", "right"))
                out += [[side.at[c][w] for side, w in ((a, i), (b, j)) for c in ("id", "c", "back", "ahead")] for i, j in compared(a, b)]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n[:2] == "id" else pa.int32()) for n, c in zip(names, columns)], names)

    small_batches(rows.sparkSession, 50)
    blocks = left.join(right, ["key", "chunk"]).select("left", "right")
    pairs = stored(blocks.mapInArrow(run, ", ".join(f"{n} {'long' if n[:2] == 'id' else 'int'}" for n in names)), "rest")
    drop(near)
    return _agreements(pairs)


def _digests(rows: DataFrame) -> DataFrame:
    """(id, d): the SHA-256 of each text in UTF-8, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in W.slices(b.column("text")):
                data, ends = memoryview(W.LOWER[s.data]), s.offsets.tolist()
                digests = [sha256(data[i:j]).digest() for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.rows), pa.array(digests, pa.binary())], ["id", "d"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "id long, d binary")


def _copies(rows: DataFrame) -> DataFrame:
    """(id, rep) of the documents whose text another one has too, A-Z lower-cased; rep is the smallest id of them."""
    digests = stored(_digests(rows), "digests")
    equal = stored(digests.groupBy("d").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "equal")
    out = stored(digests.join(equal, "d").select("id", "rep"), "copies")
    drop(digests, equal)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, n_words, partner, partner_start, partner_words, extent_start, extent_words, class): every passage of 50 words or more
    with a near-duplicate in another document. The span is verified against the partner's span that is named; the extent holds all
    spans of the passage, whatever their partners; the class is the smallest id of the documents that such passages link."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    with scratch(docs.sparkSession):
        if _repeats(rows):
            rows = stored(rows.groupBy("id").agg(F.min("text").alias("text")), "texts")
        return keep(stored(_passages(rows), "passages"))


def _passages(rows: DataFrame) -> DataFrame:
    copies = _copies(rows)
    gone = stored(copies.where("id <> rep").select("id"), "gone")
    single = restrict(rows, gone, "id", "left_anti")
    windows = stored(_windows(single), "windows", "zstd")
    shared, pairs = _first_round(windows)
    drop(windows)
    found = _verify(pairs, single)
    linked = joined_components(None, found, "id", "partner")
    more = _verify(_second_round(shared, found), single)
    linked, found = joined_components(linked, more, "id", "partner"), found.unionByName(more)
    more = _verify(_rest(shared, found, linked, single), single)
    linked, found = joined_components(linked, more, "id", "partner"), found.unionByName(more)
    linked = linked.select(F.col("node").alias("rep"), F.col("component").alias("class"))
    size = lambda a, b: (F.col(b) - F.col(a) + WORDS - 1)
    spans = chosen(found).select("id", F.col("start").alias("start_word"), size("start", "stop").alias("n_words"), "partner", "partner_start", size("partner_start", "partner_stop").alias("partner_words"), F.col("low").alias("extent_start"), size("low", "high").alias("extent_words"))
    # copies of a text: all of it is a passage. The count of its words is stored before it is compared, else all documents' words are counted
    words = restrict(rows, stored(copies.select(F.col("rep").alias("id")).distinct(), "members"), "id").select(F.col("id").alias("rep"), token_count(F.col("text")).cast("int").alias("n_words"))
    whole = copies.join(stored(words, "words").where(F.col("n_words") >= LEAST + WORDS - 1), "rep")
    second = copies.where("id <> rep").groupBy("rep").agg(F.min("id").alias("second"))
    whole = whole.join(second, "rep").select("id", "rep", F.lit(0).alias("start_word"), "n_words", F.when(F.col("id") == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("partner"))
    whole = whole.select("*", F.lit(0).alias("partner_start"), F.col("n_words").alias("partner_words"), F.lit(0).alias("extent_start"), F.col("n_words").alias("extent_words"))
    whole = stored(whole, "whole")
    spans = spans.join(whole.select("id"), "id", "left_anti").withColumn("rep", F.col("id"))
    out = spans.unionByName(whole).join(linked, "rep", "left")
    return out.select("id", "start_word", "n_words", "partner", "partner_start", "partner_words", "extent_start", "extent_words", F.coalesce("class", "rep").alias("class"))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


def op4_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """All documents: passages of 50 words or more that another document has too, at a similarity of 0.8."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id").withColumnRenamed("partner", "partner_id").withColumnRenamed("class", "class_id")
