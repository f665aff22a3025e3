"""Operator 10: language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte 1-, 2- and 3-grams. Each language's training vectors are
clustered (spherical k-means) into a few centroids; a text gets the language of the centroid of the largest
cosine. It is rejected if that cosine is much smaller than those of the language's own training texts.

The model is fitted on a bounded sample (``per_language`` distinct texts of each language, the first by a hash of
the text); its size is languages x clusters x 2^bits floats. Prediction reads every whole text once, without a shuffle.

Results for odd input: a null text and one without a letter is ``und`` with score 0 (and rejected); rows with
a null language aren't learned from; ties go to the language first by name; repeated rows are predicted alike;
a very long text is read as a whole, in a slice of its own; without any training text every prediction is ``und``; an empty
table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .common import MAX_BROADCAST_KEYS, drop, scratch, small_batches, stored, tidy
from .grams import gram_counts, idf, log_tf, unit

PER_LANGUAGE = 800
CLUSTERS = 3
BITS = 12
SIZES = (1, 2, 3)
#: Rejected below this part of the 1 % quantile of the language's own training cosines.
REJECT = 0.4
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    weights: np.ndarray
    least: np.ndarray  # cosine below which a language's text is rejected


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``rest``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0)) == rest


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means from a farthest-first start."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> Model:
    """Centroids from at most ``per_language`` texts of each language."""
    with scratch(train.sparkSession):
        return _fitted(train, text_col, lang_col, per_language, clusters, bits, sizes)


def _fitted(train: DataFrame, text_col: str, lang_col: str, per_language: int, clusters: int, bits: int, sizes: tuple[int, ...]) -> Model:
    spark = train.sparkSession
    small_batches(spark)
    texts = train.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    texts = texts.withColumn("h", F.xxhash64("text"))
    # hashes are ranked first (each distinct text once), so that only the sample's texts travel
    # hashes are counted by their first byte, and only those up to the byte that completes a sample are ranked
    hashes = stored(texts.select("lang", "h", F.shiftright("h", 56).alias("byte")).distinct(), "hashes")
    upto = Window.partitionBy("lang").orderBy("byte")
    counts = hashes.groupBy("lang", "byte").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    cuts = stored(counts.where(F.col("before") < per_language).groupBy("lang").agg(F.max("byte").alias("last")), "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= MAX_BROADCAST_KEYS else cuts
    order = Window.partitionBy("lang").orderBy("h")
    first = hashes.join(cuts, "lang").where("byte <= last").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    first = stored(first.select("lang", "h"), "sampled")
    drop(hashes)
    few = first.count() <= MAX_BROADCAST_KEYS
    sample = texts.join(F.broadcast(first) if few else first, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = stored(sample.drop("h"), "languages")

    def vectors(column) -> np.ndarray:
        return np.concatenate([log_tf(gram_counts(s, sizes, bits)) for s in W.slices(column)] or [np.zeros((0, 1 << bits), np.float32)])

    def frequency(table: pa.Table) -> pa.Table:
        df = sum(((gram_counts(s, sizes, bits) > 0).sum(axis=0) for s in W.slices(table["text"])), np.zeros(1 << bits, np.int64))
        return pa.table({"n": [table.num_rows], "df": [df.astype(np.float64).tolist()]})

    counted = sample.groupBy("lang").applyInArrow(frequency, "n long, df array<double>").collect()  # a row per language
    n = sum(r["n"] for r in counted)
    weights = idf(np.sum([r["df"] for r in counted], axis=0) if counted else np.zeros(1 << bits), n)

    def cluster(table: pa.Table) -> pa.Table:
        x = unit(vectors(table["text"]) * weights)
        c = k_means(x, clusters)
        best = (x @ c.T).max(axis=1)
        rows = [v.tolist() for v in c.astype(np.float64)]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(rows)), "centroid": pa.array(rows, pa.list_(pa.float64())), "low": pa.array([float(np.quantile(best, 0.01))] * len(rows))})

    found = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, centroid array<double>, low double").collect(), key=lambda r: (r["lang"], r["centroid"]))
    languages = sorted({r["lang"] for r in found})
    low = {r["lang"]: r["low"] for r in found}
    return Model(languages, np.array([languages.index(r["lang"]) for r in found], np.int64), np.array([r["centroid"] for r in found], np.float32).reshape(len(found), 1 << bits), weights, np.array([low[x] for x in languages]) * REJECT)


def _has_letter(s: W.Slice) -> np.ndarray:
    out = np.zeros(s.rows, bool)
    letters = np.concatenate([[0], np.cumsum(W.ASCII_LETTER[s.data])])
    out[:] = letters[s.offsets[1:]] > letters[s.offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(s.offsets) > 0)):
        out[d] = any(map(str.isalpha, s.data[s.offsets[d] : s.offsets[d + 1]].tobytes().decode("utf-8")))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The columns ``keep`` with lang_pred, score (the cosine, 0 to 1) and rejected."""
    marked = _marked(docs, model, text_col, keep, bits, sizes)
    return marked.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(keep)), "lang_pred", "score", "rejected")


def _marked(docs: DataFrame, model: Model, text_col: str, keep: tuple[str, ...], bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """As ``predict``, the columns under the names __0, __1, ..., so that none clashes."""
    spark = docs.sparkSession
    small_batches(spark)
    # the model goes once to each executor; its size doesn't grow with the corpus
    shared = spark.sparkContext.broadcast(model._replace(centroids=model.centroids.T.copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for s in W.slices(b.column("__text")):
                known = _has_letter(s)
                lang = np.array([UNKNOWN] * s.rows, object)
                score, rejected = np.zeros(s.rows), np.ones(s.rows, bool)
                if len(m.languages) and known.any():
                    cos = unit(log_tf(gram_counts(s, sizes, bits)) * m.weights) @ m.centroids
                    best = np.argmax(cos, axis=1)  # centroids are in the order of the names, so ties go to the first
                    top = m.of[best]
                    value = np.clip(cos[np.arange(s.rows), best], 0, 1)
                    lang[known] = np.array(m.languages, object)[top[known]]
                    score[known] = np.round(value[known].astype(np.float64), 6)
                    rejected[known] = value[known] < m.least[top[known]]
                rest = [c.slice(s.first, s.rows) for name, c in zip(b.schema.names, b.columns) if name != "__text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*[n for n in b.schema.names if n != "__text"], "lang_pred", "score", "rejected"])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)), F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double, rejected boolean")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents; learned from the documents whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    test = held_out("doc_id", 5, 0)
    model = fit(docs.where(~test).select("text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", test.alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The documents whose language is recognised, all columns as they are; those rejected go."""
    model = fit(docs if train is None else train)
    marked = _marked(docs, model, "text", tuple(docs.columns))
    return marked.where("not rejected").select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)))
