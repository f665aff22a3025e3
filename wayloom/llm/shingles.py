"""Shingle sets of documents, ordered from rare to frequent by a count sketch over the whole corpus.

The sketch counts all shingles of all documents in 2^20 hash buckets; its size doesn't grow with the input, and
neither does the table of frequency classes that is broadcast. A shingle's class is how many times its
bucket exceeds nine tenths of all buckets, in powers of the square root of two (0: not at all). The order (class, hash) is
total and the same for all documents, so what relies on it stays exact; the sketch only decides how well rare ones come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import small_batches, stored, tidy

BITS = 20
BLOCKS = 64
#: A prefix has one shingle more for each so many of the set, so that linked sets share that many more.
EXTRA = 25


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, text_col: str, k: int) -> Broadcast:
    """uint8 class of each sketch bucket, from the k-word shingles of all documents."""
    spark = docs.sparkSession
    size = (1 << BITS) // BLOCKS

    def rows(task: int, counts: np.ndarray) -> pa.RecordBatch:
        parts = counts.reshape(BLOCKS, size)
        full = np.flatnonzero(parts.any(axis=1))
        raw = [parts[b].astype("<i8").tobytes() for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([task] * len(full), pa.int32()), pa.array(raw, pa.binary())], ["block", "task", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for s in W.slices(b.column("text")):
                words, _, _, bounds = W.hashed_words(s)
                grams, _ = W.ngrams(words, bounds, k)
                total += np.bincount(bucket(grams), minlength=1 << BITS)
        yield rows(TaskContext.get().partitionId(), total)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table["counts"])
        return pa.table({"block": table["block"].slice(0, 1), "task": table["task"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, task int, counts binary"
    small_batches(spark)
    sums = docs.select(F.col(text_col).alias("text"))
    tasks = sums.rdd.getNumPartitions()
    sums = sums.mapInArrow(tidy(count), schema)
    while True:  # 32 tasks' blocks are added at a time, so no group grows with the corpus
        sums = sums.withColumn("task", F.floor(F.col("task") / 32).cast("int")).groupBy("block", "task").applyInArrow(add, schema)
        tasks = -(-tasks // 32)
        if tasks <= 1:
            break
    total = np.zeros((BLOCKS, size), np.int64)
    for r in sums.collect():  # BLOCKS rows
        total[r["block"]] += np.frombuffer(r["counts"], "<i8")
    total = total.ravel()
    ratio = total / max(1.0, np.quantile(total, 0.9))
    classes = np.where(ratio > 1, 1 + np.floor(2 * np.log2(np.maximum(ratio, 1))), 0).astype(np.uint8)
    return spark.sparkContext.broadcast(classes)


def slice_sets(s: W.Slice, k: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in the common order, and their bounds by document."""
    words, _, _, bounds = W.hashed_words(s)
    grams, gram_bounds = W.ngrams(words, bounds, k)
    doc = np.repeat(np.arange(s.rows), np.diff(gram_bounds))
    order = np.lexsort((grams, classes[bucket(grams)], doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(s.rows + 1))


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def whole_sets(docs: DataFrame, id_col: str, text_col: str, k: int, classes: Broadcast) -> DataFrame:
    """(id, grams): the whole set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in W.slices(b.column("text")):
                grams, bounds = slice_sets(s, k, classes.value)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.rows), long_lists(grams, bounds)], ["id", "grams"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, grams array<long>")


def incidence(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, classes: Broadcast) -> DataFrame:
    """(id, n, a, b, grams): set size, a 128-bit fingerprint of the set, and its prefix: so many of the first shingles
    in the order that two sets of a Jaccard similarity of ``percent`` share one at least, and one more for each EXTRA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column("text")):
                grams, bounds = slice_sets(s, k, classes.value)
                n = np.diff(bounds)
                sums = []
                for salt in (0x51ED270B9F652295, 0xA24BAED4963EE407):
                    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(grams ^ np.uint64(salt)))])
                    sums.append(pa.array((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64)))
                p = np.where(n > 0, np.minimum(n, n + (-percent * n // 100) + 1 + n // EXTRA), 0)  # n - ceil(percent n / 100) + 1 + n // EXTRA
                ends = np.cumsum(p)
                at = np.repeat(bounds[:-1] - (ends - p), p) + np.arange(ends[-1] if len(ends) else 0)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s.first, s.rows), pa.array(n.astype(np.int64)), *sums, long_lists(grams[at], np.concatenate([[0], ends]))], ["id", "n", "a", "b", "grams"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, n long, a long, b long, grams array<long>")
