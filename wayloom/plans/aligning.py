"""Queries of stream alignment and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from .base import HOUR, events, fixes, query, speeds


@query("arrival_order", """
SELECT session, line_no, kind, greatest(coalesce(CASE WHEN k % 3 = 0 THEN t + (k - 50) * 1000000 END, t), t) AS arrival,
  row_number() OVER (PARTITION BY session ORDER BY greatest(coalesce(CASE WHEN k % 3 = 0 THEN t + (k - 50) * 1000000 END, t), t), line_no) AS place
FROM @ev WHERE kind IN ('click', 'view', 'signup')""")
def arrival_order(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf).where(F.col("kind").isin("click", "view", "signup"))
    a = A.arrival(F.when(F.col("k") % 3 == 0, F.col("t") + (F.col("k") - 50) * 1000000), F.col("t"))
    e = e.withColumn("arrival", a)
    w = Window.partitionBy("session").orderBy("arrival", "line_no")
    return e.select("session", "line_no", "kind", "arrival", F.row_number().over(w).cast("long").alias("place"))


@query("fix_predicates", """
SELECT session, line_no, lat BETWEEN -90 AND 90 AND accuracy >= 0 AS valid_position, speed >= 0 AS valid_speed, course >= 0 AS valid_course,
  NOT speed >= 0 AS network, accuracy <= 15 AND course >= 0 AS clean, speed * 3.6 > 10 AND accuracy BETWEEN 0 AND 20 AND course >= 0 AS good_course,
  CASE WHEN accuracy <= 15 THEN 'good' WHEN accuracy <= 100 THEN 'fair' WHEN accuracy <= 1000 THEN 'poor' ELSE 'bad' END AS band,
  CASE WHEN lat = 0 AND lon = 0 THEN 'noFix' WHEN accuracy < 0 THEN 'invalidPosition' WHEN accuracy > 60 THEN 'inaccurate' WHEN speed < 0 THEN 'late' ELSE 'usable' END AS verdict,
  coalesce(CASE WHEN CAST(accuracy AS BIGINT) % 4 = 0 THEN NULL ELSE accuracy > 50 END, false) AS accessory
FROM @fix """)
def fix_predicates(spark, sf):
    acc, speed, course = F.col("accuracy"), F.col("speed"), F.col("course")
    return fixes(spark, sf).select(
        "session", "line_no", (F.col("lat").between(-90, 90) & (acc >= 0)).alias("valid_position"), (speed >= 0).alias("valid_speed"), (course >= 0).alias("valid_course"),
        (~(speed >= 0)).alias("network"), ((acc <= 15) & (course >= 0)).alias("clean"), ((speed * 3.6 > 10) & acc.between(0, 20) & (course >= 0)).alias("good_course"),
        F.when(acc <= 15, "good").when(acc <= 100, "fair").when(acc <= 1000, "poor").otherwise("bad").alias("band"),
        F.when((F.col("lat") == 0) & (F.col("lon") == 0), "noFix").when(acc < 0, "invalidPosition").when(acc > 60, "inaccurate").when(speed < 0, "late").otherwise("usable").alias("verdict"),
        F.coalesce(F.when(acc.cast("long") % 4 != 0, acc > 50), F.lit(False)).alias("accessory"),
    )


def _joined(spark, sf, forward=False):
    return A.as_of(fixes(spark, sf), speeds(spark, sf), ["session"], "t", "kmh", forward=forward)


@query("asof_held_speed", f"""
SELECT f.session, f.line_no, CASE WHEN f.t - s.t <= {6 * HOUR} THEN s.kmh END AS held_kmh, s.t AS speed_t
FROM @fix f ASOF LEFT JOIN @speed s ON f.session = s.session AND f.t >= s.t""")
def asof_held_speed(spark, sf):
    j = _joined(spark, sf)
    return j.select("session", "line_no", A.held(j, "t", 6 * HOUR).alias("held_kmh"), F.col("prev_t").alias("speed_t"))


_BOTH = """
b AS (SELECT f.session, f.line_no, f.t, s.t AS pt, s.kmh AS pv FROM @fix f ASOF LEFT JOIN @speed s ON f.session = s.session AND f.t >= s.t),
n AS (SELECT f.session, f.line_no, s.t AS nt, s.kmh AS nv FROM @fix f ASOF LEFT JOIN @speed s ON f.session = s.session AND f.t < s.t),
j AS (SELECT b.*, nt, nv, t - pt AS back, nt - t AS ahead FROM b JOIN n USING (session, line_no))"""


@query("asof_nearest_speed", f"""
WITH {_BOTH}
SELECT session, line_no, CASE WHEN CASE WHEN ahead < back OR back IS NULL THEN ahead ELSE back END <= {5 * HOUR} THEN CASE WHEN ahead < back OR (back IS NULL) THEN nt ELSE pt END END AS near_t,
  CASE WHEN CASE WHEN ahead < back OR back IS NULL THEN ahead ELSE back END <= {5 * HOUR} THEN CASE WHEN ahead < back OR (back IS NULL) THEN nv ELSE pv END END AS near_kmh FROM j""")
def asof_nearest_speed(spark, sf):
    j = _joined(spark, sf, forward=True)
    t, v = A.nearest(j, "t", 5 * HOUR)
    return j.select("session", "line_no", t.alias("near_t"), v.alias("near_kmh"))


@query("asof_interpolated_speed", f"""
WITH {_BOTH}
SELECT session, line_no, round(CASE WHEN pt = t THEN pv WHEN nt - pt > 0 AND nt - pt <= {48 * HOUR} THEN pv + (nv - pv) * ((t - pt) / CAST(nt - pt AS DOUBLE)) END, 6) AS kmh FROM j""")
def asof_interpolated_speed(spark, sf):
    j = _joined(spark, sf, forward=True)
    return j.select("session", "line_no", F.round(A.interpolated("t", 48 * HOUR), 6).alias("kmh"))


@query("speed_readout", f"""
WITH {_BOTH}
SELECT b.session, b.line_no, CASE WHEN t - pt <= {6 * HOUR} THEN pv WHEN f.speed >= 0 THEN round(f.speed * 3.6, 6) END AS kmh,
  CASE WHEN t - pt <= {6 * HOUR} THEN 'obd' WHEN f.speed >= 0 AND f.accuracy <= 40 THEN 'gps' WHEN f.speed >= 0 THEN 'gps, poor' ELSE 'none' END AS origin
FROM b JOIN @fix f USING (session, line_no)""".replace("b.session, b.line_no", "session, line_no").replace("CASE WHEN t - pt", "CASE WHEN b.t - pt"))
def speed_readout(spark, sf):
    j = _joined(spark, sf)
    fresh, ok = F.col("t") - F.col("prev_t") <= 6 * HOUR, F.col("speed") >= 0
    return j.select("session", "line_no", F.when(fresh, F.col("prev_v")).when(ok, F.round(F.col("speed") * 3.6, 6)).alias("kmh"),
        F.when(fresh, "obd").when(ok & (F.col("accuracy") <= 40), "gps").when(ok, "gps, poor").otherwise("none").alias("origin"))


@query("sliding_window_fixes", f"""
WITH f AS (SELECT *, min(t) OVER (PARTITION BY session) AS t0 FROM @fix ),
w AS (SELECT session, accuracy, unnest(generate_series(greatest(CAST(floor((t - t0 - {72 * HOUR}) / {24 * HOUR}.0) AS BIGINT) + 1, 0), CAST(floor((t - t0) / {24 * HOUR}.0) AS BIGINT))) AS w FROM f)
SELECT session, w, count(*) AS n, round(avg(accuracy), 6) AS mean_accuracy FROM w GROUP BY session, w""")
def sliding_window_fixes(spark, sf):
    from pyspark.sql import Window

    f = fixes(spark, sf).withColumn("t0", F.min("t").over(Window.partitionBy("session")))
    return A.sliding_windows(f, "t", "t0", 72 * HOUR, 24 * HOUR).groupBy("session", "w").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"))


@query("interval_exclusion", f"""
WITH x AS (SELECT session, t AS f, t + {8 * HOUR} AS u FROM @ev WHERE kind = 'error' AND k % 4 = 0)
SELECT session, line_no, t FROM @fix f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.session = f.session AND f.t BETWEEN x.f AND x.u)""")
def interval_exclusion(spark, sf):
    r = events(spark, sf).where("kind = 'error' and k % 4 = 0").select("session", F.col("t").alias("from"), (F.col("t") + 8 * HOUR).alias("to"))
    return A.excluded(fixes(spark, sf), r, ["session"], "t", 24 * HOUR).select("session", "line_no", "t")


@query("gps_mask", f"""
WITH f AS (SELECT *, min(t) OVER (PARTITION BY session) AS t0 FROM @fix )
SELECT session, line_no, CASE WHEN t >= t0 + {400 * HOUR} THEN 'time' WHEN t >= t0 + {200 * HOUR} THEN 'motion' WHEN accuracy <= 15 THEN 'accuracy' END AS withheld FROM f""")
def gps_mask(spark, sf):
    from pyspark.sql import Window

    f = fixes(spark, sf).withColumn("t0", F.min("t").over(Window.partitionBy("session")))
    why = A.withheld(F.col("t"), F.col("t0") + 400 * HOUR, F.col("accuracy"), 15.0, F.col("t0") + 200 * HOUR)
    return f.select("session", "line_no", why.alias("withheld"))


@query("full_outer_by_time", """
WITH a AS (SELECT session, k // 4 AS slot, line_no, value, row_number() OVER (PARTITION BY session, k // 4 ORDER BY line_no) AS n FROM @ev WHERE kind = 'click'),
b AS (SELECT session, k // 4 AS slot, line_no AS line_b, value AS value_b, row_number() OVER (PARTITION BY session, k // 4 ORDER BY line_no) AS n FROM @ev WHERE kind = 'view')
SELECT session, count(*) FILTER (line_no IS NOT NULL AND line_b IS NOT NULL) AS matched, count(*) FILTER (line_b IS NULL) AS only_a, count(*) FILTER (line_no IS NULL) AS only_b,
  round(max(abs(value - value_b)), 6) AS largest FROM a FULL JOIN b USING (session, slot, n) GROUP BY session""")
def full_outer_by_time(spark, sf):
    e = events(spark, sf).withColumn("slot", F.floor(F.col("k") / 4))
    a = e.where("kind = 'click'").select("session", "slot", "line_no", "value")
    b = e.where("kind = 'view'").select("session", "slot", F.col("line_no").alias("line_b"), F.col("value").alias("value_b"))
    m = A.matched_by_time(a, b, ["session"], "slot", "line_no", "line_b")
    return m.groupBy("session").agg(F.count_if(F.col("line_no").isNotNull() & F.col("line_b").isNotNull()).alias("matched"), F.count_if(F.col("line_b").isNull()).alias("only_a"),
        F.count_if(F.col("line_no").isNull()).alias("only_b"), F.round(F.max(F.abs(F.col("value") - F.col("value_b"))), 6).alias("largest"))


@query("gps_off_intervals", """
WITH s AS (SELECT session, t, k % 2 = 0 AS on_, lag(k % 2 = 0) OVER (PARTITION BY session ORDER BY t) AS p FROM @ev WHERE kind = 'signup'),
c AS (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t) AS u FROM s WHERE p IS NULL OR p <> on_)
SELECT session, t AS start_t, u AS stop_t FROM c WHERE NOT on_""")
def gps_off_intervals(spark, sf):
    s = events(spark, sf).where("kind = 'signup'").select("session", "t", (F.col("k") % 2 == 0).alias("on"))
    return A.off_intervals(s, ["session"], "t", "on").select("session", F.col("from").alias("start_t"), F.col("to").alias("stop_t"))


@query("gps_switch_filter", """
SELECT f.session, f.line_no, s.k AS switch_k FROM @fix f ASOF LEFT JOIN (SELECT session, t, k FROM @ev WHERE kind = 'signup') s ON f.session = s.session AND f.t >= s.t
WHERE coalesce(s.k % 2 = 0, true) OR NOT f.speed >= 0""")
def gps_switch_filter(spark, sf):
    s = events(spark, sf).where("kind = 'signup'").select("session", "t", "k")
    j = A.as_of(fixes(spark, sf), s, ["session"], "t", "k")
    return j.where(F.coalesce(F.col("prev_v") % 2 == 0, F.lit(True)) | ~(F.col("speed") >= 0)).select("session", "line_no", F.col("prev_v").alias("switch_k"))


@query("late_time_reject", f"""
WITH x AS (SELECT session, line_no, t, lag(t) OVER (PARTITION BY session ORDER BY line_no) AS p, lead(t) OVER (PARTITION BY session ORDER BY line_no) AS n FROM @ev )
SELECT session, line_no, coalesce(t - p > {24 * HOUR}, false) AS jump, coalesce(t - p > {24 * HOUR}, false) AND NOT coalesce(n - t <= {12 * HOUR}, false) AS rejected FROM x""")
def late_time_reject(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("line_no")
    e = events(spark, sf)
    jump = F.coalesce(F.col("t") - F.lag("t").over(w) > 24 * HOUR, F.lit(False))
    confirmed = F.coalesce(F.lead("t").over(w) - F.col("t") <= 12 * HOUR, F.lit(False))
    return e.select("session", "line_no", jump.alias("jump"), (jump & ~confirmed).alias("rejected"))
