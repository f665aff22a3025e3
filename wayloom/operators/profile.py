"""Profiles of event streams: rates, gaps, percentiles, windowed statistics and warnings.

Every operator takes column names, keeps one shuffle per grouping (session, kind), and never collects a stream.
Times are whole nanoseconds. Percentiles are nearest-rank unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def kind_profile(ev: DataFrame, keys=("session", "kind"), t="t", order="line_no", gap_ns=50_000_000) -> DataFrame:
    """Count, span, rate, longest interval, gaps over a threshold (by time) and steps back (by write order) of each stream."""
    by_time = Window.partitionBy(*keys).orderBy(t, order)
    by_line = Window.partitionBy(*keys).orderBy(order)
    e = ev.withColumn("gap", F.col(t) - F.lag(t).over(by_time)).withColumn("back", (F.col(t) < F.lag(t).over(by_line)).cast("long"))
    span = F.max(t) - F.min(t)
    return e.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(t).alias("first_t"),
        F.max(t).alias("last_t"),
        F.when(span > 0, (F.count("*") - 1) / (span / 1e9)).alias("rate_hz"),
        F.max("gap").alias("max_gap"),
        F.count_if(F.col("gap") > gap_ns).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("gap") > gap_ns, F.col("gap"))), F.lit(0)).alias("gap_total"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("out_of_order"),
    )


def latency_percentiles(ev: DataFrame, latency: Column, keys=("session",), seq="seq", order="line_no") -> DataFrame:
    """The first latency of each exchange (rows without a number count each), as nearest-rank percentiles."""
    rows = ev.withColumn("latency", latency)
    numbered = rows.where(F.col(seq).isNotNull()).groupBy(*keys, seq).agg(F.min_by("latency", order).alias("latency")).drop(seq)
    every = numbered.unionByName(rows.where(F.col(seq).isNull()).select(*keys, "latency"))
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency)")
    return every.groupBy(*keys).agg(F.count("*").alias("n"), *(p(q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)), F.min("latency").alias("low"), F.max("latency").alias("high"), F.count_if(F.col("latency") < 0).alias("negative"))


def ordered_counts(ev: DataFrame, column: str, preferred: list[str]) -> DataFrame:
    """Counts of a category with a place: preferred names first in their order, the others by name."""
    c = ev.groupBy(column).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(column)).cast("long")
    rank = F.row_number().over(Window.orderBy(F.when(at == 0, len(preferred) + 1).otherwise(at), column))
    return c.withColumn("place", rank.cast("long"))


def window_stats(ev: DataFrame, width_ns: int, gap_ns: int, gap_kinds: list[str], keys=("session",), t="t", kind="kind") -> DataFrame:
    """Tumbling windows from each session's first event: counts per kind as a map, gaps of the checked kinds (a gap that
    reaches over a boundary counts in the later window) and their longest, in milliseconds."""
    start = F.min(t).over(Window.partitionBy(*keys))
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys, kind).orderBy(t))
    e = ev.withColumn("w", F.floor((F.col(t) - start) / width_ns)).withColumn("gap", F.when(F.col(kind).isin(gap_kinds), gap))
    per = e.groupBy(*keys, "w", kind).agg(F.count("*").alias("n"), F.count_if(F.col("gap") > gap_ns).alias("gaps"), F.max("gap").alias("longest"))
    return per.groupBy(*keys, "w").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"),
        F.sum("n").alias("events"),
        F.sum("gaps").alias("gaps"),
        (F.max("longest") / 1e6).alias("max_gap_ms"),
    )


def weighted_rates(windows: DataFrame, keys, seconds: str, rate: str, least_s: float) -> DataFrame:
    """Mean rate weighted by window length (plain if none has one) and the least rate of windows that are long enough
    (of all if none is)."""
    w = F.greatest(F.col(seconds), F.lit(0.0))
    long_low = F.min(F.when(F.col(seconds) >= least_s, F.col(rate)))
    return windows.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.when(F.sum(w) > 0, F.sum(F.col(rate) * w) / F.sum(w)).otherwise(F.avg(rate)).alias("mean_rate"),
        F.coalesce(long_low, F.min(rate)).alias("min_rate"),
    )


def map_sum(df: DataFrame, keys, column: str) -> DataFrame:
    """Sums a map column's values by its keys."""
    return df.select(*keys, F.explode(column).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("total"))


def queue_alarm(windows: DataFrame, events: str, seconds: str, depth: str, least: int = 200) -> DataFrame:
    """Windows whose queue held more than two seconds of data (and more than a floor)."""
    limit = F.when(F.col(seconds) > 0, F.ceil(2 * F.col(events) / F.col(seconds)))
    return windows.withColumn("two_seconds", limit).withColumn("alarm", F.coalesce(F.col(depth) > F.greatest(limit, F.lit(least)), F.lit(False)))


def warnings(profile: DataFrame, rules: list[tuple[Column, Column]]) -> Column:
    """An array of the messages whose conditions hold, in order."""
    return F.filter(F.array(*(F.when(c, m) for c, m in rules)), lambda x: x.isNotNull())


def rounded_index_quantile(column: str, p: float) -> Column:
    """The element at round((n - 1) p) of the sorted values; half goes up."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, (F.round((F.size(values) - 1) * p) + 1).cast("int"))


# fixed values: the gap that is told, rows out of order that are, kinds in which they are expected, seconds from which statistics must be there
GAP_MS, OUT_OF_ORDER_SHARE, OUT_OF_ORDER_KINDS, STATS_AFTER_S = 50, 0.01, ("link", "elm"), 30


def health_warnings(recordings: DataFrame, kinds: DataFrame, priors: DataFrame, key: str = "file") -> DataFrame:
    """(key, warnings): what is worth a look before a recording is trusted, in a fixed order; an empty array for a clean one.

    ``recordings``: truncated_tail, damaged_members, skipped_lines (arrays), failure, read_error, dropped (null: no statistics rows), seconds,
    version, negative_latency, errors. ``kinds``: kind, place, count, gaps (null where none are looked for), longest_ms, out_of_order. ``priors``: place,
    after_first_input, invalid_field. Missing rows of the last two are none; nulls warn of nothing."""
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    # fixed values: the texts of the warnings and their order
    odd = (F.col("out_of_order") > F.col("count") * OUT_OF_ORDER_SHARE) & (F.col("out_of_order") > 0) & ~F.col("kind").isin(*OUT_OF_ORDER_KINDS)
    own = warnings(kinds, [
        (F.col("gaps") > 0, s(F.col("kind"), ": ", F.col("gaps"), f" gap(s) over {GAP_MS} ms, longest ", F.format_string("%.1f", F.bround(F.coalesce("longest_ms", F.lit(0.0)), 1)), " ms")),
        (odd, s(F.col("kind"), ": ", F.col("out_of_order"), " out-of-order row(s)")),
    ])
    by_kind = kinds.select(key, "place", own.alias("w")).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x.w)).alias("kind_warnings"))
    bad = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("place", "invalid_field"))), lambda x: x.invalid_field.isNotNull()), lambda x: s("navPrior row invalid (", x.invalid_field, "): a replay starts fresh"))
    by_prior = priors.groupBy(key).agg(F.count("*").alias("priors"), F.max("after_first_input").alias("late"), bad.alias("bad_priors"))
    r = recordings.join(by_kind, key, "left").join(by_prior, key, "left")
    first = warnings(r, [
        (F.col("truncated_tail"), F.lit("file has a truncated or damaged tail (crash or power loss); the last few seconds are missing")),
        (F.size("damaged_members") > 0, s(F.size("damaged_members"), " damaged gzip member(s) skipped: [", F.array_join(F.col("damaged_members").cast("array<string>"), ", "), "]")),
        (F.size("skipped_lines") > 0, s(F.size("skipped_lines"), " malformed line(s) skipped")),
        (F.col("failure").isNotNull(), s("reading stopped early: ", F.col("failure"))),
        (F.col("read_error").isNotNull(), s("reading stopped at a read error; the rest of the file was not read: ", F.col("read_error"))),
        (F.col("dropped") > 0, s(F.col("dropped"), " event(s) dropped by the recorder")),
        (F.col("dropped").isNull() & (F.col("seconds") > STATS_AFTER_S) & (F.col("version") >= 2), F.lit(f"no stats rows in a v2 recording longer than {STATS_AFTER_S} s")),
    ])
    last = warnings(r, [
        (F.col("negative_latency") > 0, s(F.col("negative_latency"), " OBD reply(ies) stamped before their request")),
        (F.col("errors") > 0, s(F.col("errors"), " lifecycle error row(s)")),
        (F.col("priors") > 1, s(F.col("priors"), " navPrior rows (the recorder writes at most one)")),
        (F.col("late"), F.lit("navPrior row after the first motion, location or obd row")),
    ])
    none = F.array().cast("array<string>")
    return r.select(key, F.concat(first, F.coalesce("kind_warnings", none), last, F.coalesce("bad_priors", none)).alias("warnings"))
