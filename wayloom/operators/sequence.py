"""Sequence operators: runs, chains, integrals, means, latches, thinning. Islands are running sums of break flags. What depends on its
own last result is split into blocks of time, each made by itself, whose results are carried from block to block: a
session's blocks follow its duration, not its rows, so a session with a large part of all rows isn't one task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Callable[[Callable[[str], Column]], Column], name: str = "island") -> DataFrame:
    """Adds the number of each row's run; ``breaks`` gets lag() and tells where a new one begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.coalesce(breaks(lambda c: F.lag(c).over(w)), F.lit(True)).cast("int")
    return df.withColumn("__b", flag).withColumn(name, F.sum("__b").over(w)).drop("__b")


def first_lasting_run(df: DataFrame, keys: list[str], t: str, holds: Column, hold: int, gap: int | None, order: list[str]) -> DataFrame:
    """Per key the start of the first run of rows where ``holds``, gaps within it at most ``gap``, that lasts ``hold``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("__h", holds)
    new = ~F.col("__h") | ~F.coalesce(F.lag("__h").over(w), F.lit(False))
    if gap is not None:
        new = new | (F.col(t) - F.lag(t).over(w) > gap)
    x = x.withColumn("__n", F.coalesce(new, F.lit(True)).cast("int")).withColumn("__r", F.sum("__n").over(w)).where("__h")
    runs = x.groupBy(*keys, "__r").agg(F.min(t).alias("start"), F.max(t).alias("stop")).where(F.col("stop") - F.col("start") >= hold)
    return runs.groupBy(*keys).agg(F.min("start").alias("start"))


def chains(df: DataFrame, keys: list[str], t: str, order: list[str], within: int) -> DataFrame:
    """Rows within a time of the one before join its chain; adds the chain's first time and whether the row is that first."""
    x = islands(df, keys, [t, *order], lambda lag: F.col(t) - lag(t) > within, "chain")
    w = Window.partitionBy(*keys, "chain").orderBy(t, *order)
    return x.withColumn("chain_start", F.first(t).over(w)).withColumn("scored", F.row_number().over(w) == 1)


def held_integral(df: DataFrame, keys: list[str], t: str, rate: Column, most: int, order: list[str], unit: float = 1e9) -> DataFrame:
    """Running integral of a held rate: each row's rate counts until the next row, for ``most`` at the longest."""
    w = Window.partitionBy(*keys).orderBy(t, *order)
    step = F.least(F.col(t) - F.lag(t).over(w), F.lit(most))
    piece = F.coalesce(F.lag(rate).over(w) * step / unit, F.lit(0.0))
    return df.withColumn("__p", piece).withColumn("total", F.sum("__p").over(w)).drop("__p")


def trapezoid(df: DataFrame, keys: list[str], t: str, value: str, order: list[str], unit: float = 1e9) -> DataFrame:
    """Running integral between neighbouring rows by their mean."""
    w = Window.partitionBy(*keys).orderBy(t, *order)
    piece = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(t) - F.lag(t).over(w)) / unit
    return df.withColumn("__p", F.coalesce(piece, F.lit(0.0))).withColumn("total", F.sum("__p").over(w)).drop("__p")


def wrapped_change(value: Column, last: Column) -> Column:
    """A change of course in degrees, brought to within half a turn."""
    d = value - last
    return d - 360 * F.round(d / 360)


def _before(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` (with a block ``__b``) and ``__p``: the columns of the row before, also across blocks."""
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    rows = rows.withColumn("__p", F.lag(F.struct(*columns)).over(inside))
    last = rows.groupBy(*keys, "__b").agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("z"))
    ends = last.select(*keys, "__b", F.lag(F.struct(*(F.col(f"z.{c}").alias(c) for c in columns))).over(Window.partitionBy(*keys).orderBy("__b")).alias("__q"))
    return rows.join(ends, [*keys, "__b"]).withColumn("__p", F.coalesce("__p", "__q")).drop("__q")


def smoothed(df: DataFrame, keys: list[str], t: str, order: str, value: str, tau: float) -> DataFrame:
    """(keys, t, order, mean): the exponential mean with irregular steps, m + (1 - exp(-dt / tau)) (v - m) from the first value on.

    A value adds (1 - exp(-dt / tau)) v, which decays with time; so a block's rows are a running sum of values scaled by their time in the
    block (20 tau at most, so nothing overflows), and only the mean at its end goes on to the next block."""
    block = max(1, int(20 * tau))
    rows = df.select(*keys, t, order, F.col(value).cast("double").alias("v"), F.floor(F.col(t) / block).alias("__b"))
    rows = _before(rows, keys, [t, order], [t])
    start = F.col("__b") * block
    share = F.when(F.col("__p").isNull(), 1.0).otherwise(-F.expm1(-(F.col(t) - F.col(f"__p.{t}")) / float(tau)))
    rows = rows.withColumn("__x", share * F.col("v") * F.exp((F.col(t) - start) / float(tau)))
    inside = Window.partitionBy(*keys, "__b").orderBy(t, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum("__x").over(inside))
    # the mean at a block's end, decayed to its start: what it adds, and how what came before has decayed by then
    ends = rows.groupBy(*keys, "__b").agg(F.sum("__x").alias("s"))
    decay = exp(-block / tau)
    carry = F.aggregate("__before", F.struct(F.lit(0.0).alias("m"), F.lit(None).cast("long").alias("b")), lambda a, x: F.struct((F.coalesce(a.m * F.pow(F.lit(decay), (x.b - a.b).cast("double")), F.lit(0.0)) + x.s).alias("m"), x.b.alias("b")))
    w = Window.partitionBy(*keys).orderBy("__b").rangeBetween(-3, -1)  # older blocks have decayed by e^-60 and more
    ends = ends.withColumn("__before", F.collect_list(F.struct(F.col("__b").alias("b"), "s")).over(w)).withColumn("__c", carry)
    held = F.coalesce(F.col("__c.m") * F.pow(F.lit(decay), (F.col("__b") - F.col("__c.b")).cast("double")), F.lit(0.0))
    rows = rows.join(ends.select(*keys, "__b", held.alias("__m")), [*keys, "__b"])
    return rows.select(*keys, t, order, ((F.col("__m") + F.col("__s")) * F.exp(-(F.col(t) - start) / float(tau))).alias("mean"))


def latched(df: DataFrame, keys: list[str], t: str, order: str, value: str, low: float, high: float, block: int, dwell: int = 0) -> DataFrame:
    """(keys, t, order, on, rises): a latch that goes on above ``high`` at once and off below ``low``, once values have been below for ``dwell``;
    between the two it keeps its state, off at first. ``rises``: the row turned it on.

    The state is that of the last row that decides, so blocks hand on their last such row, and where a run of low values began."""
    rows = df.select(*keys, t, order, F.col(value).alias("v"), F.floor(F.col(t) / block).alias("__b"))
    inside = Window.partitionBy(*keys, "__b").orderBy(t, order)

    def carried(rows: DataFrame, what: str, out: str) -> DataFrame:
        """``out``: the last value of ``what`` that isn't null, up to a row."""
        per = rows.groupBy(*keys, "__b").agg(F.max(F.when(F.col(what).isNotNull(), F.struct(t, order, F.col(what).alias("x")))).alias("z"))
        w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(*keys, "__b", F.last("z.x", ignorenulls=True).over(w).alias("__q"))
        rows = rows.join(per, [*keys, "__b"])
        return rows.withColumn(out, F.coalesce(F.last(what, ignorenulls=True).over(inside), "__q")).drop("__q")

    below = F.coalesce(F.col("v") < low, F.lit(False))
    if dwell:
        # the first low row after one that isn't: its time is carried through the run
        rows = _before(rows, keys, [t, order], [t, "v"])
        starts = below & (F.col("__p").isNull() | ~F.coalesce(F.col("__p.v") < low, F.lit(False)))
        rows = carried(rows.withColumn("__w", F.when(starts, F.col(t))), "__w", "__since")
        below = below & (F.col(t) - F.col("__since") >= dwell)
    rows = carried(rows.withColumn("__d", F.when(F.col("v") > high, True).when(below, False)), "__d", "on")
    rows = rows.withColumn("on", F.coalesce("on", F.lit(False)))
    rows = _before(rows.select(*keys, "__b", t, order, "on"), keys, [t, order], [t, "on"])
    return rows.select(*keys, t, order, "on", (F.col("on") & ~F.coalesce(F.col("__p.on"), F.lit(False))).alias("rises"))


def thinned(df: DataFrame, keys: list[str], t: str, order: str, least: int) -> DataFrame:
    """The rows of a track that are kept: the first, and each that is at least ``least`` after the last kept one.

    Each time points to the first one far enough after it; the kept ones are those reached from the first. Pointers double with each round, so a chain of n takes
    about log n rounds of joins, whatever the session's size. Of rows at one time only the first (by ``order``) can be kept."""
    times = df.groupBy(*keys, t).agg(F.min(order).alias(order))
    after = Window.partitionBy(*keys).orderBy(t).rangeBetween(least, Window.unboundedFollowing)
    jump = cut(times.select(*keys, t, F.min(t).over(after).alias("__to")).where("__to is not null"))
    kept = cut(times.groupBy(*keys).agg(F.min(t).alias(t)))
    while True:
        reached = kept.join(jump, [*keys, t]).select(*keys, F.col("__to").alias(t))
        more = cut(reached.join(kept, [*keys, t], "left_anti"))
        if more.isEmpty():
            break
        kept = cut(kept.unionByName(more))
        far = jump.select(*keys, F.col(t).alias("__to"), F.col("__to").alias("__far"))
        jump = cut(jump.join(far, [*keys, "__to"]).select(*keys, t, F.col("__far").alias("__to")))
    return df.join(kept.join(times, [*keys, t]), [*keys, t, order], "left_semi")


def write_windows(df: DataFrame, keys: list[str], t: str, order: str, width: int) -> DataFrame:
    """Adds ``w``: the window in which a row was written. A window begins with the first row and ends by the times seen so far, so a row that comes
    late counts where it was written, not by its own time."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = F.max(t).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("w", F.floor((seen - F.first(t).over(w)) / width))


def grid_times(df: DataFrame, start: Column, stop: Column, step: int, most: int) -> DataFrame:
    """A row for each whole step in (start, stop], at most ``most`` of them, the first ones."""
    first = F.floor(start / step) + 1
    last = F.least(F.floor(stop / step), first + (most - 1))
    steps = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("at", F.explode(F.transform(steps, lambda k: k * step)))


def floor_to_grid(t: Column, step: int) -> Column:
    """The grid time at or before ``t``, exact, also for negative times."""
    return t - F.pmod(t, F.lit(step))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], signature: str, t: str) -> DataFrame:
    """The first row of each run of equal signatures, and one for its repeats: how many, their first and last time."""
    x = islands(df, keys, order, lambda lag: ~F.col(signature).eqNullSafe(lag(signature)), "run")
    g = x.groupBy(*keys, "run", signature).agg(F.count("*").alias("n"), F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.sort_array(F.collect_list(t)).alias("__t"))
    return g.withColumn("repeat_t", F.try_element_at("__t", F.lit(2))).drop("__t")


def seen_before(df: DataFrame, keys: list[str], order: list[str], what: Column) -> DataFrame:
    """Whether an earlier row of the key had ``what``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("seen", F.coalesce(F.max(what).over(w), F.lit(False)))


def prior_source(recorded: Column, explicit: Column, none: Column, valid: Column, started_before: Column) -> Column:
    """Which prior a replay uses: absent, overridden, ignored, invalid, cut (handed over at a later start) or used."""
    return F.when(~recorded, "absent").when(explicit, "overridden").when(none, "ignored").when(~valid, "invalid").when(started_before, "cut").otherwise("used")
