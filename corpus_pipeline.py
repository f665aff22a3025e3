"""A corpus pipeline of five stages over ``documents``, each of one training-data operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents; the last returns the pieces of packed sequences.

Results for odd input, at every stage: a null text counts as empty (language identification rejects it, as any text without
a letter); a null language or source is a value of its own; rows with a null id stay through both dedup stages; rows
that repeat an id are decided on together where an id is dropped; very long texts are read whole; ties go to the larger
id (exact copies) or the smaller one (near copies); an empty table gives no rows; columns besides those of documents pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import exact, langid, mixing, ngram_join, pack
from wayloom.llm.common import drop, keep, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid classifier rejects go."""
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id stays."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the document with the smallest id stays."""
    return ngram_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked source, language and topic weights."""
    return mixing.sample_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, each with the sources' tempered shares while they last."""
    return pack.pack(docs, temper=pack.TEMPER)


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing)]

#: Language identification and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # a stage's tables and its input go once its output is written
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            before = docs
            with scratch(spark):
                docs = keep(stored(stage(spark, docs, sf_dir), name))
            drop(before)
        return keep(docs)
