"""Queries of the stream profiles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import profile as P
from .base import HOUR, events, query

SCRAMBLED = "event_id * 7919 % 10007"


@query("kind_profile", f"""
WITH e AS (SELECT *, line_no * 7919 % 10007 * 1000000 + line_no AS o FROM @ev ),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY session, kind ORDER BY t, o) AS gap, t < lag(t) OVER (PARTITION BY session, kind ORDER BY o) AS back FROM e)
SELECT session, kind, count(*) AS n, min(t) AS first_t, max(t) AS last_t,
  round(CASE WHEN max(t) > min(t) THEN (count(*) - 1) / ((max(t) - min(t)) / 1e9) END, 12) AS rate_hz,
  max(gap) AS max_gap, count(*) FILTER (gap > {12 * HOUR}) AS gaps,
  CAST(coalesce(sum(gap) FILTER (gap > {12 * HOUR}), 0) AS BIGINT) AS gap_total, count(*) FILTER (back) AS out_of_order
FROM g GROUP BY session, kind""")
def kind_profile(spark, sf):
    e = events(spark, sf).withColumn("line_no", F.col("line_no") * 7919 % 10007 * 1000000 + F.col("line_no"))
    return P.kind_profile(e, gap_ns=12 * HOUR).withColumn("rate_hz", F.round("rate_hz", 12))


@query("latency_percentiles", """
WITH x AS (SELECT session, line_no, CASE WHEN k % 10 = 0 THEN NULL ELSE line_no // 2 END AS seq, value - 20 AS latency FROM @ev ),
f AS (SELECT session, arg_min(latency, line_no) AS latency FROM x WHERE seq IS NOT NULL GROUP BY session, seq
      UNION ALL SELECT session, latency FROM x WHERE seq IS NULL)
SELECT session, count(*) AS n, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.9) AS p90, quantile_disc(latency, 0.95) AS p95,
  quantile_disc(latency, 0.99) AS p99, min(latency) AS low, max(latency) AS high, count(*) FILTER (latency < 0) AS negative
FROM f GROUP BY session""")
def latency_percentiles(spark, sf):
    e = events(spark, sf).withColumn("seq", F.when(F.col("k") % 10 != 0, F.floor(F.col("line_no") / 2)))
    return P.latency_percentiles(e, F.col("value") - 20)


@query("kind_counts_ordered", """
SELECT kind, count(*) AS n, row_number() OVER (ORDER BY CASE kind WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, kind) AS place FROM @ev GROUP BY kind""")
def kind_counts_ordered(spark, sf):
    return P.ordered_counts(events(spark, sf), "kind", ["purchase", "click"])


@query("poll_rate", """
SELECT session, round(CASE WHEN max(t) > min(t) THEN (count(*) - 1) / ((max(t) - min(t)) / 1e9) END, 12) AS poll_hz
FROM @ev WHERE kind = 'view' AND k % 4 <> 0 GROUP BY session""")
def poll_rate(spark, sf):
    e = events(spark, sf).where("kind = 'view' and k % 4 <> 0")
    return P.kind_profile(e, keys=("session",)).select("session", F.round("rate_hz", 12).alias("poll_hz"))


_WINDOWS = f"""
s AS (SELECT *, min(t) OVER (PARTITION BY session) AS t0, t - lag(t) OVER (PARTITION BY session, kind ORDER BY t) AS g FROM @ev ),
w AS (SELECT session, CAST(floor((t - t0) / {24 * HOUR}.0) AS BIGINT) AS w, kind, t, value, CASE WHEN kind IN ('click', 'view') THEN g END AS gap FROM s)"""


def _windows(spark, sf):
    return P.window_stats(events(spark, sf), 24 * HOUR, 12 * HOUR, ["click", "view"])


@query("window_stats", f"""
WITH {_WINDOWS}
SELECT session, w, count(*) AS events, count(*) FILTER (gap > {12 * HOUR}) AS gaps, round(max(gap) / 1e6, 6) AS max_gap_ms,
  count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'error') AS errors
FROM w GROUP BY session, w""")
def window_stats(spark, sf):
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    return _windows(spark, sf).select("session", "w", "events", "gaps", F.round("max_gap_ms", 6).alias("max_gap_ms"), n("click").alias("clicks"), n("error").alias("errors"))


@query("counts_map_sum", """
SELECT session, kind AS name, count(*) AS total FROM @ev GROUP BY session, kind""")
def counts_map_sum(spark, sf):
    return P.map_sum(_windows(spark, sf), ["session"], "counts")


@query("weighted_rates", f"""
WITH {_WINDOWS},
x AS (SELECT session, w, (max(t) - min(t)) / 1e9 AS seconds, count(*) * 1e0 AS n FROM w GROUP BY session, w)
SELECT session, count(*) AS windows,
  round(CASE WHEN sum(greatest(seconds, 0)) > 0 THEN sum(n * greatest(seconds, 0)) / sum(greatest(seconds, 0)) ELSE avg(n) END, 9) AS mean_rate,
  coalesce(min(n) FILTER (seconds >= 3600), min(n)) AS min_rate
FROM x GROUP BY session""")
def weighted_rates(spark, sf):
    e = events(spark, sf)
    start = F.min("t").over(Window.partitionBy("session"))
    e = e.withColumn("w", F.floor((F.col("t") - start) / (24 * HOUR)))
    x = e.groupBy("session", "w").agg(((F.max("t") - F.min("t")) / 1e9).alias("seconds"), (F.count("*") * 1.0).cast("double").alias("n"))
    return P.weighted_rates(x, ["session"], "seconds", "n", 3600.0).withColumn("mean_rate", F.round("mean_rate", 9))


@query("queue_alarm", f"""
WITH {_WINDOWS},
x AS (SELECT session, w, count(*) AS events, max(value) AS depth FROM w GROUP BY session, w)
SELECT session, w, CAST(ceil(2 * events / 3.5) AS BIGINT) AS two_seconds, depth > greatest(ceil(2 * events / 3.5), 150) AS alarm FROM x""")
def queue_alarm(spark, sf):
    e = events(spark, sf)
    start = F.min("t").over(Window.partitionBy("session"))
    x = e.withColumn("w", F.floor((F.col("t") - start) / (24 * HOUR))).groupBy("session", "w").agg(F.count("*").alias("events"), F.max("value").alias("depth"), F.lit(3.5).alias("seconds"))
    return P.queue_alarm(x, "events", "seconds", "depth", 150).select("session", "w", "two_seconds", "alarm")


@query("last_value_by_line", """
SELECT session, arg_max(value, line_no) AS last_value, arg_min(props, line_no) AS first_props FROM @ev GROUP BY session""")
def last_value_by_line(spark, sf):
    return events(spark, sf).groupBy("session").agg(F.max_by("value", "line_no").alias("last_value"), F.min_by("props", "line_no").alias("first_props"))


@query("health_warnings", f"""
WITH g AS (SELECT *, t - lag(t) OVER (PARTITION BY session, kind ORDER BY t) AS gap FROM @ev ),
p AS (SELECT session, kind, count(*) AS n, count(*) FILTER (gap > {36 * HOUR}) AS gaps, max(gap) AS longest, count(*) FILTER (value < 5) AS low FROM g GROUP BY session, kind)
SELECT session, kind, concat_ws('; ', CASE WHEN gaps > 0 THEN kind || ': ' || gaps || ' gap(s), longest ' || longest // 1000000 || ' ms' END,
  CASE WHEN low > n * 0.1 THEN kind || ': ' || low || ' low value(s)' END, CASE WHEN kind = 'error' THEN n || ' error row(s)' END) AS warnings,
  CAST((gaps > 0) AS INT) + CAST((low > n * 0.1) AS INT) + CAST((kind = 'error') AS INT) AS n_warnings
FROM p""")
def health_warnings(spark, sf):
    by = Window.partitionBy("session", "kind").orderBy("t")
    e = events(spark, sf).withColumn("gap", F.col("t") - F.lag("t").over(by))
    p = e.groupBy("session", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 36 * HOUR).alias("gaps"), F.max("gap").alias("longest"), F.count_if(F.col("value") < 5).alias("low"))
    found = P.warnings(p, [
        (F.col("gaps") > 0, F.concat("kind", F.lit(": "), F.col("gaps").cast("string"), F.lit(" gap(s), longest "), F.floor(F.col("longest") / 1000000).cast("string"), F.lit(" ms"))),
        (F.col("low") > F.col("n") * 0.1, F.concat("kind", F.lit(": "), F.col("low").cast("string"), F.lit(" low value(s)"))),
        (F.col("kind") == "error", F.concat(F.col("n").cast("string"), F.lit(" error row(s)"))),
    ])
    return p.select("session", "kind", F.concat_ws("; ", found).alias("warnings"), F.size(found).alias("n_warnings"))


@query("median_and_quantiles", """
WITH x AS (SELECT session, kind, value, row_number() OVER (PARTITION BY session, kind ORDER BY value) AS r, count(*) OVER (PARTITION BY session, kind) AS n FROM @ev )
SELECT session, kind, round(median(value), 9) AS mid, min(value) FILTER (r = round((n - 1) * 0.9) + 1) AS p90_index, quantile_disc(value, 0.9) AS p90_rank FROM x GROUP BY session, kind""")
def median_and_quantiles(spark, sf):
    p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)")
    return events(spark, sf).groupBy("session", "kind").agg(F.round(F.median("value"), 9).alias("mid"), P.rounded_index_quantile("value", 0.9).alias("p90_index"), p90.alias("p90_rank"))


@query("distance_stats_by_class", """
SELECT kind, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS high, CAST(grouping(kind) AS INT) AS overall
FROM @ev GROUP BY GROUPING SETS ((kind), ())""")
def distance_stats_by_class(spark, sf):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    e = events(spark, sf)
    return e.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("high"), F.grouping("kind").cast("int").alias("overall"))


@query("first_report_dedup", """
SELECT session, kind, k, line_no, value FROM @ev QUALIFY row_number() OVER (PARTITION BY session, kind, k ORDER BY line_no) = 1""")
def first_report_dedup(spark, sf):
    w = Window.partitionBy("session", "kind", "k").orderBy("line_no")
    return events(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("session", "kind", "k", "line_no", "value")


@query("csv_projection", """
SELECT line_no, regexp_replace(kind || '/' || CAST(k % 3 AS VARCHAR), '[^A-Za-z0-9_-]', '_', 'g') || '.csv' AS file,
  CAST(t AS VARCHAR) || ',' || kind || ',' || CASE WHEN regexp_matches(props, '[",\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END || ',' || CASE WHEN k % 7 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS line
FROM @ev """)
def csv_projection(spark, sf):
    from ..functions.text import csv_field, file_name

    k = F.when(F.col("k") % 7 != 0, F.col("k").cast("string"))
    line = F.concat_ws(",", *(csv_field(c) for c in (F.col("t").cast("string"), F.col("kind"), F.col("props"), k)))
    return events(spark, sf).select("line_no", F.concat(file_name(F.concat_ws("/", "kind", (F.col("k") % 3).cast("string"))), F.lit(".csv")).alias("file"), line.alias("line"))


@query("json_lines", """
SELECT line_no, '{"data":{"k":' || k || ',"session":' || session || '},"kind":"' || kind || '","t":' || t || '}' AS line FROM @ev """)
def json_lines(spark, sf):
    data = F.struct("k", "session")
    return events(spark, sf).select("line_no", F.to_json(F.struct(data.alias("data"), "kind", "t")).alias("line"))


@query("kind_views_from_json", """
SELECT line_no, kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, kind IN ('click', 'view', 'error') AS known, CASE WHEN kind = 'click' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS click_k FROM @ev """)
def kind_views_from_json(spark, sf):
    data = F.from_json("props", "k bigint")
    return events(spark, sf).select("line_no", "kind", data["k"].alias("k"), F.col("kind").isin("click", "view", "error").alias("known"), F.when(F.col("kind") == "click", data["k"].cast("double")).alias("click_k"))


# every session is a recording; what is wrong with it follows from its number and its events
_HEALTH = f"""
k AS (SELECT session, kind, count(*) AS n, count(*) FILTER (gap > {36 * HOUR}) AS gaps, (max(gap) // 1000000)::DOUBLE AS longest, count(*) FILTER (value < 3) AS odd FROM (SELECT *, t - lag(t) OVER (PARTITION BY session, kind ORDER BY t) AS gap FROM @ev ) GROUP BY session, kind),
r AS (SELECT session, (max(t) - min(t)) / 1e9 AS seconds, count(*) FILTER (kind = 'signup' AND k < 10) AS negative, count(*) FILTER (kind = 'error') AS errors FROM @ev GROUP BY session),
p AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY line_no) AS place, k % 2 = 0 AS late, CASE WHEN k % 3 = 0 THEN 'latitude' END AS bad FROM @ev WHERE kind = 'purchase' AND k % 7 = 0),
kw AS (SELECT session, string_agg(w, '|' ORDER BY kind) FILTER (w <> '') AS w FROM (SELECT session, kind, concat_ws('|', CASE WHEN kind <> 'click' AND gaps > 0 THEN kind || ': ' || gaps || ' gap(s) over 50 ms, longest ' || format('{{:.1f}}', longest) || ' ms' END,
  CASE WHEN odd > n * 0.01 AND odd > 0 THEN kind || ': ' || odd || ' out-of-order row(s)' END) AS w FROM k) GROUP BY session),
pw AS (SELECT session, count(*) AS n, bool_or(late) AS late, string_agg('navPrior row invalid (' || bad || '): a replay starts fresh', '|' ORDER BY place) FILTER (bad IS NOT NULL) AS bad FROM p GROUP BY session)"""


@query("recording_health", f"""
WITH {_HEALTH}
SELECT session, concat_ws('|', CASE WHEN session % 5 = 1 THEN 'file has a truncated or damaged tail (crash or power loss); the last few seconds are missing' END, CASE WHEN session % 4 = 2 THEN '2 damaged gzip member(s) skipped: [3, 7]' END, CASE WHEN session % 6 = 3 THEN '1 malformed line(s) skipped' END,
  CASE WHEN session % 7 = 4 THEN 'reading stopped early: crc' END, CASE WHEN session % 9 = 5 THEN 'reading stopped at a read error; the rest of the file was not read: EIO' END, CASE WHEN session % 3 = 1 THEN session || ' event(s) dropped by the recorder' END,
  CASE WHEN session % 3 = 2 AND seconds > 30 AND session % 2 = 0 THEN 'no stats rows in a v2 recording longer than 30 s' END, kw.w, CASE WHEN negative > 0 THEN negative || ' OBD reply(ies) stamped before their request' END,
  CASE WHEN errors > 0 THEN errors || ' lifecycle error row(s)' END, CASE WHEN pw.n > 1 THEN pw.n || ' navPrior rows (the recorder writes at most one)' END, CASE WHEN late THEN 'navPrior row after the first motion, location or obd row' END, bad) AS warnings
FROM r LEFT JOIN kw USING (session) LEFT JOIN pw USING (session)""")
def recording_health(spark, sf):
    e, s, k = events(spark, sf), F.col("session"), F.col("k")
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("session", "kind").orderBy("t"))
    kinds = e.withColumn("gap", gap).groupBy("session", "kind").agg(F.count("*").alias("count"), F.when(F.col("kind") != "click", F.count_if(F.col("gap") > 36 * HOUR)).alias("gaps"), F.floor(F.max("gap") / 1000000).cast("double").alias("longest_ms"), F.count_if(F.col("value") < 3).alias("out_of_order")).withColumn("place", F.col("kind"))
    r = e.groupBy("session").agg(((F.max("t") - F.min("t")) / 1e9).alias("seconds"), F.count_if((F.col("kind") == "signup") & (k < 10)).alias("negative_latency"), F.count_if(F.col("kind") == "error").alias("errors"))
    none = F.array().cast("array<int>")
    r = r.withColumns({
        "truncated_tail": s % 5 == 1, "damaged_members": F.when(s % 4 == 2, F.array(F.lit(3), F.lit(7))).otherwise(none), "skipped_lines": F.when(s % 6 == 3, F.array(F.lit(9))).otherwise(none), "failure": F.when(s % 7 == 4, "crc"), "read_error": F.when(s % 9 == 5, "EIO"),
        "dropped": F.when(s % 3 == 1, s).when(s % 3 == 0, 0), "version": F.when(s % 2 == 0, 2).otherwise(1)})
    place = F.row_number().over(Window.partitionBy("session").orderBy("line_no"))
    priors = e.where((F.col("kind") == "purchase") & (k % 7 == 0)).select("session", place.alias("place"), (k % 2 == 0).alias("after_first_input"), F.when(k % 3 == 0, "latitude").alias("invalid_field"))
    return P.health_warnings(r, kinds, priors, "session").select("session", F.array_join("warnings", "|").alias("warnings"))
