"""The query without SQL: the stateful filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import filter as P
from .base import events, query


@query("filter_replay")
def filter_replay(spark, sf):
    """Estimates of each session: clicks are fixes, views speeds, signups turns; an hour of the log counts as 50 ms."""
    e = events(spark, sf)
    k, kind = F.col("k"), F.col("kind")
    at = F.floor((F.col("t") - 1704067200000000000) / 72000).cast("long")
    rows = e.where(kind.isin("click", "view", "signup")).select(
        "session", "line_no", at.alias("arrival"), F.when(kind == "click", "fix").when(kind == "view", "speed").otherwise("motion").alias("kind"),
        F.when(kind == "click", 50 + k * 0.0001).when(kind == "view", F.least("value", F.lit(60.0))).otherwise((k - 50) * 0.0005).alias("a"),
        (30 + k * 0.0001).alias("b"), (k + 1.0).alias("c"), F.lit(-1.0).alias("d"),
    )
    return P.replay(rows).select("session", "t", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("ess", 3).alias("ess"))
