"""Two runs' estimates and pins, matched by time and compared bit for bit and within tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G

# fixed values: differences that may pass, in metres and degrees
METRES, DEGREES = 1.0, 0.1
#: Fields that must be equal bit for bit.
DOUBLES = ("latitude", "longitude", "headingDeg", "headingStdDeg", "semiMajorM", "semiMinorM", "orientationDeg", "speedScale", "onRoadShare")


def same_bits(a: Column, b: Column) -> Column:
    """Equality of doubles by bit pattern: -0.0 isn't 0.0, NaN is NaN (of one kind), null is null. The shortest text of a
    double stands for its bits."""
    return a.cast("string").eqNullSafe(b.cast("string"))


def matched(live: DataFrame, replay: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Full outer join by keys and time: columns ``a`` and ``b`` (structs; null where a side has none). Of several rows of the second
    side at one time the last (by ``n``) counts; each of the first side's is compared with it."""
    own = lambda df, name: df.select(*keys, t, F.struct(*(c for c in df.columns if c not in (*keys, t))).alias(name))
    last = Window.partitionBy(*keys, t).orderBy(F.desc("n"))
    one = replay.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    return own(live, "a").join(own(one, "b"), [*keys, t], "full_outer")


def matched_pins(live: DataFrame, replay: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """As ``matched``, with the k-th pin of a time on one side meeting the k-th on the other."""
    w = Window.partitionBy(*keys, t).orderBy("n")
    own = lambda df, name: df.select(*keys, t, F.row_number().over(w).alias("place"), F.col("prior").alias(name), F.lit(True).alias(f"has_{name}"))
    return own(live, "a").join(own(replay, "b"), [*keys, t, "place"], "full_outer")


def differences(a: str = "a", b: str = "b") -> dict[str, Column]:
    """Measures of two estimates (structs): distance, angles, axes, and whether they are equal bit for bit."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    east, north = G.enu(y("latitude"), y("longitude"), x("latitude"), x("longitude"))
    gap = lambda c: F.abs(x(c) - y(c))
    share = F.when(x("onRoadShare").isNotNull() & y("onRoadShare").isNotNull(), gap("onRoadShare")).when(x("onRoadShare").isNull() & y("onRoadShare").isNull(), 0.0).otherwise(1.0)
    equal = x("converged").eqNullSafe(y("converged"))
    for c in DOUBLES:
        equal &= same_bits(x(c), y(c))
    return {
        "position_m": F.sqrt(east * east + north * north), "heading_deg": G.angle_difference(x("headingDeg"), y("headingDeg"), 360.0), "heading_std_deg": gap("headingStdDeg"),
        "axes_m": F.greatest(gap("semiMajorM"), gap("semiMinorM")), "orientation_deg": G.angle_difference(x("orientationDeg"), y("orientationDeg"), 180.0), "speed_scale": gap("speedScale"),
        "share": share, "flag": x("converged") != y("converged"), "equal": equal,
    }


def compared(pairs: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """A row per key from ``matched``: largest differences (a NaN is larger than all), unequal ones and the first time of one, rows of one side
    only, those after the first side's end, and the verdict: exact, within (the tolerances) or different."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    d = differences()
    measures = ("position_m", "heading_deg", "heading_std_deg", "axes_m", "orientation_deg", "speed_scale", "share")
    rows = pairs.withColumns({k: F.when(both, v) for k, v in d.items()})
    end = F.max(F.when(F.col("a").isNotNull(), F.col(t))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("end", end)
    right = F.col("a").isNull()
    out = rows.groupBy(*keys).agg(
        F.count_if(both).alias("matched"), *(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in measures), F.count_if("flag").alias("flags"), F.count_if(~F.col("equal")).alias("unequal"),
        F.min(F.when(~F.col("equal"), F.col(t))).alias("first_difference"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(right).alias("right_only"),
        F.count_if(right & (F.col("end").isNull() | (F.col(t) > F.col("end")))).alias("right_only_after_end"),
    )
    whole = (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("matched") > 0)
    close = (F.col("position_m") <= METRES) & (F.col("axes_m") <= METRES) & (F.col("heading_deg") <= DEGREES) & (F.col("heading_std_deg") <= DEGREES) & (F.col("flags") == 0)
    return out.withColumn("verdict", F.when(whole & (F.col("unequal") == 0), "exact").when(whole & close, "within").otherwise("different"))
