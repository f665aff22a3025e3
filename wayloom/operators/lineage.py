"""Where lineage is cut: loops whose plan would grow with each round; sides of joins that are shuffled."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, as the session names one in ``spark.checkpoint.dir``; where that is unset, a
    temporary one serves if they are one process, else it is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(where or 'file://' + tempfile.mkdtemp(prefix='wayloom-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the session names in ``spark.checkpoint.dir``, so that a lost executor costs one
    round only. Where it is unset, a temporary folder serves if driver and executors are one process, else it is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="wayloom-"))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and merged. Spark takes an exploded or grouped table for as small as the columns it was
    made from, and would send it whole through the driver."""
    return df.hint("merge")
