"""Queries of runs, chains, integrals and folds."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geo as G
from ..operators import align as A
from ..operators import sequence as S
from .base import HOUR, events, fixes, query, speeds


@query("motion_start", f"""
WITH x AS (SELECT *, kmh >= 20 AS h, lag(kmh >= 20) OVER w AS ph, t - lag(t) OVER w AS g FROM @speed WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
r AS (SELECT *, CAST(sum(CASE WHEN h AND ph AND g <= {60 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t, line_no) AS BIGINT) AS r FROM x),
s AS (SELECT session, r, min(t) AS start FROM r WHERE h GROUP BY session, r HAVING max(t) - min(t) >= {24 * HOUR})
SELECT session, min(start) AS start FROM s GROUP BY session""")
def motion_start(spark, sf):
    return S.first_lasting_run(speeds(spark, sf), ["session"], "t", F.col("kmh") >= 20, 24 * HOUR, 60 * HOUR, ["t", "line_no"])


@query("convergence", f"""
WITH x AS (SELECT *, accuracy <= 70 AS h, lag(accuracy <= 70) OVER w AS ph FROM @fix WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
r AS (SELECT *, CAST(sum(CASE WHEN h AND ph THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t, line_no) AS BIGINT) AS r FROM x),
s AS (SELECT session, r, min(t) AS start FROM r WHERE h GROUP BY session, r HAVING max(t) - min(t) >= {48 * HOUR})
SELECT session, min(start) AS start FROM s GROUP BY session""")
def convergence(spark, sf):
    return S.first_lasting_run(fixes(spark, sf), ["session"], "t", F.col("accuracy") <= 70, 48 * HOUR, None, ["t", "line_no"])


@query("refinement_chains", f"""
WITH p AS (SELECT session, line_no, t, t - lag(t) OVER (PARTITION BY session ORDER BY t, line_no) AS g FROM @ev WHERE kind = 'purchase'),
c AS (SELECT *, CAST(sum(CASE WHEN g <= {10 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t, line_no) AS BIGINT) AS chain FROM p)
SELECT session, line_no, chain, min(t) OVER (PARTITION BY session, chain) AS chain_start, row_number() OVER (PARTITION BY session, chain ORDER BY t, line_no) = 1 AS scored FROM c""")
def refinement_chains(spark, sf):
    p = events(spark, sf).where("kind = 'purchase'")
    return S.chains(p, ["session"], "t", ["line_no"], 10 * HOUR).select("session", "line_no", "chain", "chain_start", "scored")


@query("distance_integral", f"""
WITH d AS (SELECT session, line_no, t, coalesce(lag(CASE WHEN kmh > 0 THEN (kmh + 0.5) / 3.6 ELSE 0 END) OVER w * least(t - lag(t) OVER w, {6 * HOUR}) / 1e9, 0) AS p FROM @speed WINDOW w AS (PARTITION BY session ORDER BY t, line_no))
SELECT session, line_no, round(sum(p) OVER (PARTITION BY session ORDER BY t, line_no), 4) AS metres FROM d""")
def distance_integral(spark, sf):
    rate = F.when(F.col("kmh") > 0, (F.col("kmh") + 0.5) / 3.6).otherwise(0.0)
    return S.held_integral(speeds(spark, sf), ["session"], "t", rate, 6 * HOUR, ["line_no"]).select("session", "line_no", F.round("total", 4).alias("metres"))


@query("yaw_integral", """
WITH d AS (SELECT session, line_no, t, coalesce((v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) / 1e9, 0) AS p FROM (SELECT session, line_no, t, (k - 50) * 0.000001 AS v FROM @ev WHERE kind = 'signup') WINDOW w AS (PARTITION BY session ORDER BY t, line_no))
SELECT session, line_no, round(-sum(p) OVER (PARTITION BY session ORDER BY t, line_no), 6) + 0.0 AS turn FROM d""")
def yaw_integral(spark, sf):
    e = events(spark, sf).where("kind = 'signup'").withColumn("v", (F.col("k") - 50) * 0.000001)
    return S.trapezoid(e, ["session"], "t", "v", ["line_no"]).select("session", "line_no", (F.round(-F.col("total"), 6) + 0.0).alias("turn"))


@query("course_change", """
WITH c AS (SELECT *, course - lag(course) OVER (PARTITION BY session ORDER BY t, line_no) AS d FROM @fix WHERE course >= 0)
SELECT session, line_no, round(d - 360 * round(d / 360), 6) AS change, round(sum(coalesce(d - 360 * round(d / 360), 0)) OVER (PARTITION BY session ORDER BY t, line_no), 6) AS total FROM c""")
def course_change(spark, sf):
    w = Window.partitionBy("session").orderBy("t", "line_no")
    f = fixes(spark, sf).where("course >= 0")
    f = f.withColumn("change", S.wrapped_change(F.col("course"), F.lag("course").over(w)))
    return f.select("session", "line_no", F.round("change", 6).alias("change"), F.round(F.sum(F.coalesce("change", F.lit(0.0))).over(w), 6).alias("total"))


_ENU = """radians(lat - plat) * 6378137.0 * (1 - 6.69437999014e-3) / pow(1 - 6.69437999014e-3 * pow(sin(radians(plat)), 2), 1.5) AS north,
  radians(lon - plon) * 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat)) AS east"""


@query("path_length", f"""
WITH p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM @fix WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
e AS (SELECT session, {_ENU} FROM p)
SELECT session, count(*) AS fixes, round(coalesce(sum(sqrt(east * east + north * north)), 0), 3) AS metres FROM e GROUP BY session""")
def path_length(spark, sf):
    w = Window.partitionBy("session").orderBy("t", "line_no")
    f = fixes(spark, sf).withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)})
    east, north = G.enu("lat", "lon", "plat", "plon")
    return f.groupBy("session").agg(F.count("*").alias("fixes"), F.round(F.coalesce(F.sum(F.sqrt(east * east + north * north)), F.lit(0.0)), 3).alias("metres"))


@query("acceleration_ema", """
WITH s AS (SELECT session, list({'v': value, 't': t} ORDER BY t, line_no) AS rows FROM @ev WHERE kind = 'view' GROUP BY session)
SELECT session, round(list_reduce(list_transform(rows, lambda r: {'m': r.v, 't': r.t}), lambda a, r: {'m': a.m + (1 - exp(-((r.t - a.t) / 1e9) / 36000.0)) * (r.m - a.m), 't': r.t}).m, 6) AS mean, len(rows) AS n FROM s""")
def acceleration_ema(spark, sf):
    e = events(spark, sf).where("kind = 'view'")
    m = S.smoothed(e, ["session"], "t", "line_no", "value", 36_000_000_000_000)
    return m.groupBy("session").agg(F.round(F.max_by("mean", F.struct("t", "line_no")), 6).alias("mean"), F.count("*").alias("n"))


@query("hysteresis_latch", """
WITH s AS (SELECT session, list(value ORDER BY t, line_no) AS v FROM @ev WHERE kind = 'error' GROUP BY session)
SELECT session, list_reduce(list_prepend({'on_': false, 'n': CAST(0 AS BIGINT), 'v': CAST(0 AS DOUBLE)}, list_transform(v, lambda x: {'on_': false, 'n': CAST(0 AS BIGINT), 'v': x})),
  lambda a, r: {'on_': CASE WHEN r.v > 100 THEN true WHEN r.v < 30 THEN false ELSE a.on_ END, 'n': CASE WHEN r.v > 100 AND NOT a.on_ THEN a.n + 1 ELSE a.n END, 'v': r.v}).n AS alarms FROM s""")
def hysteresis_latch(spark, sf):
    e = events(spark, sf).where("kind = 'error'")
    on = S.latched(e, ["session"], "t", "line_no", "value", 30, 100, 100 * HOUR)
    return on.groupBy("session").agg(F.count_if("rises").alias("alarms"))


@query("dwelling_latch", f"""
WITH e AS (SELECT *, value < 30 AS low, coalesce(lag(value) OVER (PARTITION BY session ORDER BY t, line_no) < 30, false) AS low0 FROM @ev ),
s AS (SELECT *, max(CASE WHEN low AND NOT low0 THEN t END) OVER (PARTITION BY session ORDER BY t, line_no) AS since FROM e),
d AS (SELECT *, CASE WHEN value > 60 THEN 1 WHEN low AND t - since >= {24 * HOUR} THEN 0 END AS d FROM s),
o AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, line_no), 0) = 1 AS on_ FROM d)
SELECT line_no, on_ AS latched, on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY session ORDER BY t, line_no), false) AS rises FROM o""")
def dwelling_latch(spark, sf):
    """Grows at once, shrinks after a day below."""
    on = S.latched(events(spark, sf), ["session"], "t", "line_no", "value", 30, 60, 100 * HOUR, dwell=24 * HOUR)
    return on.select("line_no", F.col("on").alias("latched"), "rises")


@query("track_thinning", f"""
WITH RECURSIVE f AS (SELECT session, t, min(line_no) AS line_no FROM @fix GROUP BY session, t),
k AS (SELECT session, min(t) AS t FROM f GROUP BY session UNION ALL SELECT k.session, (SELECT min(f.t) FROM f WHERE f.session = k.session AND f.t >= k.t + {12 * HOUR}) FROM k WHERE k.t IS NOT NULL)
SELECT session, line_no, t FROM f SEMI JOIN k USING (session, t)""")
def track_thinning(spark, sf):
    """Points kept at least 12 hours after the last kept one, per session: each depends on the one kept before."""
    return S.thinned(fixes(spark, sf).select("session", "line_no", "t"), ["session"], "t", "line_no", 12 * HOUR).select("session", "line_no", "t")


@query("written_windows", f"""
WITH x AS (SELECT *, max(t) OVER (PARTITION BY session ORDER BY line_no) AS seen, first_value(t) OVER (PARTITION BY session ORDER BY line_no) AS t0 FROM @ev ),
w AS (SELECT *, CAST(floor((seen - t0) / {24 * HOUR}.0) AS BIGINT) AS w FROM x)
SELECT session, w, count(*) AS events, count(*) FILTER (t < seen) AS late, count(*) FILTER (kind = 'click') AS clicks FROM w GROUP BY session, w""")
def written_windows(spark, sf):
    """Windows in the order of writing: rows that come late count where they were written."""
    e = S.write_windows(events(spark, sf), ["session"], "t", "line_no", 24 * HOUR)
    seen = F.max("t").over(Window.partitionBy("session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("seen", seen).groupBy("session", "w").agg(F.count("*").alias("events"), F.count_if(F.col("t") < F.col("seen")).alias("late"), F.count_if(F.col("kind") == "click").alias("clicks"))


@query("grid_sampling", f"""
WITH g AS (SELECT session, line_no, t, lag(t) OVER (PARTITION BY session ORDER BY t, line_no) AS p FROM @fix ),
s AS (SELECT session, unnest(generate_series(p // {HOUR} + 1, least(t // {HOUR}, p // {HOUR} + 12))) * {HOUR} AS at_ FROM g WHERE p IS NOT NULL)
SELECT session, count(*) AS n, min(at_) AS first_at, max(at_) AS last_at FROM s GROUP BY session""")
def grid_sampling(spark, sf):
    w = Window.partitionBy("session").orderBy("t", "line_no")
    g = fixes(spark, sf).withColumn("p", F.lag("t").over(w)).where("p is not null")
    return S.grid_times(g, F.col("p"), F.col("t"), HOUR, 12).groupBy("session").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("floor_to_grid", """
SELECT line_no, CAST(floor((k - 50) * 37 / 100.0) AS BIGINT) * 100 AS grid, floor((k - 50) * 7.0 / 64) AS cell FROM @ev """)
def floor_to_grid(spark, sf):
    return events(spark, sf).select("line_no", S.floor_to_grid((F.col("k") - 50) * 37, 100).alias("grid"), G.cell((F.col("k") - 50) * 7.0, 64).cast("double").alias("cell"))


@query("run_length_collapse", """
WITH x AS (SELECT session, t, line_no, kind, lag(kind) OVER w AS p FROM @ev WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
r AS (SELECT *, CAST(sum(CASE WHEN p = kind THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t, line_no) AS BIGINT) AS run FROM x)
SELECT session, run, kind, count(*) AS n, min(t) AS first_t, max(t) AS last_t, list(t ORDER BY t)[2] AS repeat_t FROM r GROUP BY session, run, kind""")
def run_length_collapse(spark, sf):
    return S.run_lengths(events(spark, sf), ["session"], ["t", "line_no"], "kind", "t")


@query("after_first_input", """
SELECT session, line_no, coalesce(max(kind IN ('click', 'view')) OVER (PARTITION BY session ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM @ev QUALIFY kind = 'purchase'""")
def after_first_input(spark, sf):
    x = S.seen_before(events(spark, sf), ["session"], ["line_no"], F.col("kind").isin("click", "view"))
    return x.where("kind = 'purchase'").select("session", "line_no", "seen")


@query("track_runs_by_band", f"""
WITH b AS (SELECT session, t, line_no, CASE WHEN accuracy <= 15 THEN 'good' WHEN accuracy <= 60 THEN 'fair' ELSE 'poor' END AS band FROM @fix ),
x AS (SELECT *, lag(band) OVER w AS p, t - lag(t) OVER w AS g FROM b WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
r AS (SELECT *, CAST(sum(CASE WHEN p = band AND g <= {96 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t, line_no) AS BIGINT) AS run FROM x)
SELECT session, run, band, count(*) AS n, min(t) AS first_t FROM r GROUP BY session, run, band""")
def track_runs_by_band(spark, sf):
    band = F.when(F.col("accuracy") <= 15, "good").when(F.col("accuracy") <= 60, "fair").otherwise("poor")
    x = fixes(spark, sf).withColumn("band", band)
    x = S.islands(x, ["session"], ["t", "line_no"], lambda lag: (F.col("band") != lag("band")) | (F.col("t") - lag("t") > 96 * HOUR), "run")
    return x.groupBy("session", "run", "band").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("position_at_time", f"""
WITH q AS (SELECT session, line_no, t FROM @ev WHERE kind = 'error'), f AS (SELECT * FROM @fix WHERE accuracy <= 80),
b AS (SELECT q.*, f.t AS pt, f.lat AS pv FROM q ASOF LEFT JOIN f ON q.session = f.session AND q.t >= f.t),
n AS (SELECT q.session, q.line_no, f.t AS nt, f.lat AS nv FROM q ASOF LEFT JOIN f ON q.session = f.session AND q.t < f.t)
SELECT session, line_no, round(CASE WHEN pt = t THEN pv WHEN nt - pt <= {72 * HOUR} THEN pv + (nv - pv) * ((t - pt) / CAST(nt - pt AS DOUBLE)) END, 8) AS lat FROM b JOIN n USING (session, line_no)""")
def position_at_time(spark, sf):
    q = events(spark, sf).where("kind = 'error'").select("session", "line_no", "t")
    j = A.as_of(q, fixes(spark, sf).where("accuracy <= 80"), ["session"], "t", "lat", forward=True)
    return j.select("session", "line_no", F.round(A.interpolated("t", 72 * HOUR), 8).alias("lat"))


@query("ring_buffer_window", f"""
SELECT session, line_no, count(*) OVER w AS n90, round(avg(accuracy) OVER w, 6) AS mean90, row_number() OVER (PARTITION BY session ORDER BY t DESC, line_no DESC) <= 5 AS kept
FROM @fix WINDOW w AS (PARTITION BY session ORDER BY t RANGE BETWEEN {90 * HOUR} PRECEDING AND CURRENT ROW)""")
def ring_buffer_window(spark, sf):
    w = Window.partitionBy("session").orderBy("t").rangeBetween(-90 * HOUR, 0)
    last = Window.partitionBy("session").orderBy(F.desc("t"), F.desc("line_no"))
    return fixes(spark, sf).select("session", "line_no", F.count("*").over(w).alias("n90"), F.round(F.avg("accuracy").over(w), 6).alias("mean90"), (F.row_number().over(last) <= 5).alias("kept"))


@query("entering_set", """
WITH d AS (SELECT session, t // 86400000000000 AS day, list_sort(list(DISTINCT kind)) AS now FROM @ev GROUP BY ALL),
p AS (SELECT *, lag(now) OVER (PARTITION BY session ORDER BY day) AS inside FROM d)
SELECT session, day, list_sort(list_filter(now, lambda x: NOT coalesce(list_contains(inside, x), false))) AS entering FROM p""")
def entering_set(spark, sf):
    d = events(spark, sf).withColumn("day", F.floor(F.col("t") / (24 * HOUR))).groupBy("session", "day").agg(F.sort_array(F.collect_set("kind")).alias("now"))
    w = Window.partitionBy("session").orderBy("day")
    inside = F.coalesce(F.lag("now").over(w), F.array().cast("array<string>"))
    return d.withColumn("i", inside).select("session", "day", F.sort_array(F.array_except("now", "i")).alias("entering"))
