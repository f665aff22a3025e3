"""Operator 9: quality by nearest-neighbour voting in a latent-semantic space.

A bounded number of labelled texts (``labelled`` at most, the first by a hash of the id) is turned into TF-IDF
vectors of hashed byte 3-grams (case and marks kept) and word repetitions, reduced by a truncated SVD to a
few dozen latent dimensions, and broadcast with the labels: rows x dimensions floats, whatever the corpus holds.
Every document of the corpus is then projected and compared with all of them: exact cosines as blocked matrix
products (``BLOCK`` documents at a time); the labels of the ``neighbours`` nearest vote with weights that grow
with the similarity.

Results for odd input: an empty or null text, or one unlike any labelled text, scores the share of label 1; a
document with several labels counts as their majority (ties: 1); rows with a null id, label or text aren't
learned from; neighbours of equal similarity vote by their place in the sample; rows that repeat an id are scored each by
its own text; a very long text is read as a whole, in a slice of its own; without labels every score is 0.5; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import scratch, small_batches, stored
from .grams import gram_counts, idf, log_tf, unit
from .langid import held_out

LABELLED = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
BITS = 12
BLOCK = 256
THRESHOLD = 0.7
#: Extra terms: the share of words that equal the one before it, and the one two before, in tenths.
REPEATS = 24


def features(s: W.Slice) -> np.ndarray:
    """Log counts of byte 3-grams and of repeated words, a row per document."""
    grams = log_tf(gram_counts(s, (3,), BITS, fold=None))
    words, _, _, bounds = W.hashed_words(s, lower=False)
    extra = np.zeros((s.rows, REPEATS), np.float32)
    doc = np.repeat(np.arange(s.rows), np.diff(bounds))
    total = np.maximum(np.diff(bounds), 1)
    for lag in (1, 2):
        if len(words) > lag:
            same = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag])
            share = np.bincount(doc[lag:][same], minlength=s.rows) / total
            level = np.clip(np.ceil(share * 10), 0, 11).astype(int)
            full = level > 0
            extra[np.flatnonzero(full), (lag - 1) * 12 + level[full]] = 6
    return np.concatenate([grams, extra], axis=1)


def latent(x: np.ndarray, dimensions: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (columns, by size) by a randomised range finder with power iterations."""
    rng = np.random.default_rng(seed)
    k = min(dimensions + 8, *x.shape)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], k)).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dimensions].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, dimensions: int = DIMENSIONS) -> dict:
    """The model: term weights, projection, latent vectors of the labelled texts and their labels."""
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, label_col, id_col, text_col, labelled, dimensions)


def _fitted(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, labelled: int, dimensions: int) -> dict:
    spark = docs.sparkSession
    small_batches(spark)
    one = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    one = one.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # half more than needed, since a labelled id may have no text
    one = one.orderBy(F.xxhash64("id"), "id").limit(labelled + labelled // 2)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = stored(texts.join(F.broadcast(one), "id"), "labelled")  # at most 1.5 x ``labelled`` ids are broadcast

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in W.slices(b.column("text")):
                x = features(s).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.rows), b.column("label").slice(s.first, s.rows), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "label", "x"])

    first = sample.select(F.col("id").cast("long").alias("id"), "label", "text").orderBy(F.xxhash64("id"), "id").limit(labelled)
    rows = first.mapInArrow(vectors, "id long, label int, x binary").collect()  # bounded by ``labelled``
    rows.sort(key=lambda r: (r["id"], r["label"]))
    if not rows:
        return {"labels": np.zeros(0, np.float32), "prior": 0.5}
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    labels_ = np.array([r["label"] for r in rows], np.float32)
    weights = idf((x > 0).sum(axis=0), len(x))
    x = unit(x * weights)
    basis = latent(x, dimensions)
    return {"weights": weights, "basis": basis, "vectors": unit(x @ basis).T.copy(), "labels": labels_, "prior": float(labels_.mean())}


def vote(z: np.ndarray, model: dict, neighbours: int) -> np.ndarray:
    """Scores of unit rows ``z``: the neighbours' labels weighted by the sixth power of the cosine."""
    labels, m = model["labels"], min(neighbours, len(model["labels"]))
    cos = z @ model["vectors"]
    top = np.argpartition(-cos, m - 1, axis=1)[:, :m]
    w = np.clip(np.take_along_axis(cos, top, axis=1), 0, 1).astype(np.float64) ** 6 + 1e-9
    return (w * labels[top]).sum(axis=1) / w.sum(axis=1)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, score) of every document: one pass without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for s in W.slices(b.column("text"), most=BLOCK):
                out = np.full(s.rows, m["prior"])
                if len(m["labels"]):
                    z = (features(s) * m["weights"]) @ m["basis"]
                    size = np.linalg.norm(z, axis=1)
                    some = (size > 0) & (np.diff(s.offsets) > 0)
                    if some.any():
                        out[some] = vote(z[some] / size[some, None], m, neighbours)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.rows), pa.array(np.round(np.clip(out, 0, 1), 6))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """All documents scored; labels of rows whose crc32(doc_id) mod 4 is 2 are never read into the model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    test = held_out("doc_id", 4, 2)
    model = fit(docs.select("doc_id", "text"), labels.where(~test), "quality")
    out = score(docs, model)
    return out.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
