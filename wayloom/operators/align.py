"""Alignment of event streams: arrival order, as-of joins, interval joins, masks.

As-of joins are a union of both streams and one window function per direction (one shuffle by the keys, no
range join): each probe row sees the last (or next) value row. Ties are explicit: a value at the very time counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def arrival(received: Column, t: Column) -> Column:
    return F.greatest(F.coalesce(received, t), t)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str = "t", value: str = "v", backward: bool = True, forward: bool = False) -> DataFrame:
    """``left`` with prev_t, prev_v (last right row at or before its time) and, if asked for, next_t, next_v (first after it).

    Right rows of one key and time must be unique or equal in value."""
    r = right.select(*keys, F.col(t).alias("__t"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__r"), F.lit(0).alias("__side"))
    both = left.withColumns({"__t": F.col(t), "__side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side")
    back = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    if backward:
        both = both.withColumn("__b", back)
    if forward:
        both = both.withColumn("__f", ahead)
    out = both.where("__side = 1")
    if backward:
        out = out.withColumns({"prev_t": F.col("__b.t"), "prev_v": F.col("__b.v")}).drop("__b")
    if forward:
        out = out.withColumns({"next_t": F.col("__f.t"), "next_v": F.col("__f.v")}).drop("__f")
    return out.drop("__t", "__side", "__r")


def held(joined: DataFrame, t: str, most: int) -> Column:
    """The last value, unless it is older than ``most``."""
    return F.when(F.col(t) - F.col("prev_t") <= most, F.col("prev_v"))


def nearest(joined: DataFrame, t: str, most: int) -> tuple[Column, Column]:
    """(time, value) of the nearer neighbour within ``most``; of two at the same distance the earlier."""
    before, after = F.col(t) - F.col("prev_t"), F.col("next_t") - F.col(t)
    later = F.coalesce(after < before, before.isNull()) & after.isNotNull()
    gap = F.when(later, after).otherwise(before)
    near = lambda c: F.when(gap <= most, F.when(later, F.col(f"next_{c}")).otherwise(F.col(f"prev_{c}")))
    return near("t"), near("v")


def interpolated(t: str, most: int) -> Column:
    """The value at a time: exact where there is one, else linear between neighbours that are close enough."""
    span = F.col("next_t") - F.col("prev_t")
    part = (F.col(t) - F.col("prev_t")) / span
    return F.when(F.col("prev_t") == F.col(t), F.col("prev_v")).when((span > 0) & (span <= most), F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * part)


def sliding_windows(df: DataFrame, t: str, start: str, length: int, step: int) -> DataFrame:
    """A row for each window [w step, w step + length) from ``start`` that holds the row: an equi key instead of a range join."""
    rel = F.col(t) - F.col(start)
    low = F.greatest(F.floor((rel - length) / step) + 1, F.lit(0))
    return df.withColumn("w", F.explode(F.sequence(low.cast("long"), F.floor(rel / step).cast("long"))))


def excluded(df: DataFrame, ranges: DataFrame, keys: list[str], t: str, bucket: int) -> DataFrame:
    """Rows outside all closed [from, to] ranges of their key: an anti join on key and time bucket, then the exact test."""
    r = ranges.select(*keys, "from", "to", F.explode(F.sequence(F.floor(F.col("from") / bucket), F.floor(F.col("to") / bucket))).alias("__b"))
    on = [df[k] == r[k] for k in keys] + [F.floor(df[t] / bucket) == r["__b"], df[t].between(r["from"], r["to"])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(r, cond, "left_anti")


def withheld(t: Column, after: Column | None, accuracy: Column, hold_out: float | None, moving_from: Column | None) -> Column:
    """Why a fix is kept from an estimator: by time, by motion, by accuracy; null if it isn't."""
    out = F.lit(None).cast("string")
    if hold_out is not None:
        out = F.when(accuracy <= hold_out, "accuracy").otherwise(out)
    if moving_from is not None:
        out = F.when(t >= moving_from, "motion").otherwise(out)
    if after is not None:
        out = F.when(t >= after, "time").otherwise(out)
    return out


def matched_by_time(left: DataFrame, right: DataFrame, keys: list[str], t: str, order_l: str, order_r: str) -> DataFrame:
    """Full outer match on time, the n-th row of a time with the n-th of the other side."""
    w = lambda o: Window.partitionBy(*keys, t).orderBy(o)
    a = left.withColumn("__n", F.row_number().over(w(order_l)))
    b = right.withColumn("__n", F.row_number().over(w(order_r)))
    return a.join(b, [*keys, t, "__n"], "full_outer").drop("__n")


def off_intervals(switches: DataFrame, keys: list[str], t: str, on: str) -> DataFrame:
    """(from, to) of each time a switch is off, from its first off row to the next on row; the last may be open."""
    w = Window.partitionBy(*keys).orderBy(t)
    s = switches.withColumn("__p", F.lag(on).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(on)))
    s = s.withColumn("to", F.lead(t).over(w))
    return s.where(~F.col(on)).select(*keys, F.col(t).alias("from"), "to")
