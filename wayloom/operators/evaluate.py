"""Scores of estimates against withheld truth, weighted moments, offset scans and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def scored(estimates: DataFrame, east: Column, north: Column, inside: Column, distance: Column) -> DataFrame:
    """Adds the planar error, its share of the distance driven in percent, and whether truth lies inside the ellipse."""
    e = F.sqrt(east * east + north * north)
    return estimates.withColumns({"error_m": e, "error_pct": F.when(distance > 0, 100 * e / distance), "inside": inside})


def consistency(scores: DataFrame, kind: str) -> DataFrame:
    """Inside and scored counts by kind and overall (kind null)."""
    return scores.rollup(kind).agg(F.count_if("inside").alias("inside"), F.count("*").alias("scored"))


def largest_errors(scores: DataFrame, kind: str, t: str) -> DataFrame:
    """The largest error and percentage of each kind, each with its own time (the first on ties)."""
    first = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col(t)).alias("t"))))
    m = scores.groupBy(kind).agg(first("error_m").alias("m"), first("error_pct").alias("p"))
    return m.select(kind, F.col("m.v").alias("max_m"), (-F.col("m.t")).alias("max_m_t"), F.col("p.v").alias("max_pct"), (-F.col("p.t")).alias("max_pct_t"))


def verdict_shares(rows: DataFrame, keys: list[str], t: str, distance: str, verdict: str) -> DataFrame:
    """Counts and distance-weighted shares of each verdict; a row weighs the distance since the row before."""
    w = Window.partitionBy(*keys).orderBy(t)
    x = rows.withColumn("w", F.greatest(F.lit(0.0), F.coalesce(F.col(distance) - F.lag(distance).over(w), F.lit(0.0))))
    x = x.withColumn("whole", F.sum("w").over(Window.partitionBy(*keys)))
    return x.groupBy(*keys, verdict).agg(F.count("*").alias("n"), F.when(F.max("whole") > 0, F.sum("w") / F.max("whole")).alias("share"))


def moments(df: DataFrame, keys: list[str], x: str, y: str, heading: str, w: str) -> DataFrame:
    """Weighted mean, covariance, circular mean and deviation, and the effective sample size of weights that sum to 1."""
    sw = F.sum(w)
    mx, my = F.sum(F.col(w) * F.col(x)) / sw, F.sum(F.col(w) * F.col(y)) / sw
    m = df.withColumns({"__mx": F.sum(F.col(w) * F.col(x)).over(Window.partitionBy(*keys)) / F.sum(w).over(Window.partitionBy(*keys)), "__my": F.sum(F.col(w) * F.col(y)).over(Window.partitionBy(*keys)) / F.sum(w).over(Window.partitionBy(*keys))})
    dx, dy = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    s, c = F.sum(F.col(w) * F.sin(heading)) / sw, F.sum(F.col(w) * F.cos(heading)) / sw
    r = F.least(F.greatest(F.sqrt(s * s + c * c), F.lit(1e-12)), F.lit(1.0))
    return m.groupBy(*keys).agg(mx.alias("mean_x"), my.alias("mean_y"), (F.sum(F.col(w) * dx * dx) / sw).alias("xx"), (F.sum(F.col(w) * dx * dy) / sw).alias("xy"), (F.sum(F.col(w) * dy * dy) / sw).alias("yy"),
        F.atan2(s, c).alias("heading"), F.sqrt(-2 * F.log(r)).alias("heading_std"), (sw * sw / F.sum(F.col(w) * F.col(w))).alias("ess"))


def normalised(df: DataFrame, keys: list[str], log_w: str) -> DataFrame:
    """Weights from log weights, by the largest; equal ones where none is finite."""
    p = Window.partitionBy(*keys)
    top = F.max(log_w).over(p)
    e = F.exp(F.col(log_w) - top)
    ok = top > F.lit(float("-inf"))
    return df.withColumn("weight", F.when(ok, e / F.sum(e).over(p)).otherwise(1.0 / F.count("*").over(p)))


def heaviest(df: DataFrame, keys: list[str], group: str, mass: str) -> DataFrame:
    """The group of the largest total mass per key; the smallest group on ties."""
    g = df.groupBy(*keys, group).agg(F.sum(mass).alias("mass"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("mass", 9)), group)
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def offset_scan(points: DataFrame, shifts: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Mean, median and 90 % score of every shift of a bounded grid (broadcast: its size is a parameter), and its rank:
    the share of shifts that score no more."""
    x = points.join(F.broadcast(shifts)).withColumn("score", score)
    p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY score)")
    s = x.groupBy(*keys, "dx", "dy").agg(F.avg("score").alias("mean"), F.expr("percentile(score, 0.5)").alias("median"), p90.alias("p90"))
    return s.withColumn("rank", F.cume_dist().over(Window.partitionBy(*keys).orderBy(F.round("mean", 9))))


def key_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two configurations, a missing key being a difference."""
    j = a.withColumnRenamed(value, "a").join(b.withColumnRenamed(value, "b"), key, "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows replaced by new ones of the same key, and the others of both."""
    both = old.withColumn("__o", F.lit(1)).unionByName(new.withColumn("__o", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__o"))).where("__r = 1").drop("__o", "__r")
