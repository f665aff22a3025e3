"""Queries of cumulative series and the pin survey. An hour of the log counts as a second; clicks are fixes of two sources, views speeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roads as R, survey as S
from .base import HOUR, events, fixes, query
from .offsets import _SIZE, _STREETS, _streets, _tracks

_CUM = f"""
s0 AS (SELECT *, (t - lag(t) OVER w) / {HOUR}e0 AS gap, lag(kmh) OVER w AS rate FROM @speed WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
cum AS (SELECT session, t, line_no, sum(coalesce(rate * least(gap, 24e0), 0)) OVER (PARTITION BY session ORDER BY t, line_no) AS held, sum(coalesce(CASE WHEN gap <= 12 THEN rate * gap ELSE 0 END, 0)) OVER (PARTITION BY session ORDER BY t, line_no) AS gated FROM s0)"""


def _speed_sums(spark, sf, **rule):
    from .base import speeds

    return S.cumulative(speeds(spark, sf), ["session"], "t", "kmh", "line_no", 96 * HOUR, HOUR, **rule)


@query("cumulative_series", f"WITH {_CUM} SELECT line_no, round(held, 6) AS held, round(gated, 6) AS gated FROM cum")
def cumulative_series(spark, sf):
    held = _speed_sums(spark, sf, hold=24.0).select("line_no", F.round("total", 6).alias("held"))
    return held.join(_speed_sums(spark, sf, gate=12.0).select("line_no", F.round("total", 6).alias("gated")), "line_no")


@query("cumulative_lookup", f"""
WITH {_CUM} SELECT f.line_no, round(c.held, 6) AS total FROM @fix f ASOF LEFT JOIN (SELECT session, t, max(held) AS held FROM cum GROUP BY session, t) c ON f.session = c.session AND f.t >= c.t""")
def cumulative_lookup(spark, sf):
    at = S.value_at(fixes(spark, sf).select("session", "t", "line_no"), _speed_sums(spark, sf, hold=24.0), ["session"], "t", "line_no")
    return at.select("line_no", F.round("total", 6).alias("total"))


@query("road_contexts", f"""
WITH {_STREETS},
p AS (SELECT pt.*, CASE WHEN f.course >= 0 THEN f.course END AS course, f.speed FROM pt JOIN @fix f ON f.line_no = i),
d AS (SELECT p.*, way_id, (bx - ax) / l AS ux, (by_ - ay) / l AS uy, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / l AS along, l, ax, ay, bx, by_ FROM p JOIN (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS l FROM st) s ON px BETWEEN ax - 100 AND bx + 100 AND py BETWEEN ay - 100 AND by_ + 100),
e AS (SELECT *, sqrt(pow(px - ax - least(l, greatest(0, along)) * ux, 2) + pow(py - ay - least(l, greatest(0, along)) * uy, 2)) AS dist FROM d),
n AS (SELECT *, first_value((ux, uy, dist)) OVER (PARTITION BY i ORDER BY dist, way_id) AS near FROM e WHERE dist <= 100),
c AS (SELECT i, dist, along > 0 AND along < l AS interior, near[3] AS d0, abs(ux * CASE WHEN course IS NOT NULL AND speed >= 2 THEN sin(radians(course)) ELSE near[1] END + uy * CASE WHEN course IS NOT NULL AND speed >= 2 THEN cos(radians(course)) ELSE near[2] END) AS c FROM n),
g AS (SELECT i, bool_or(dist <= 25 AND c < cos(radians(45))) AS junction, bool_or(interior AND dist >= greatest(15, d0 + 15) AND dist <= 80 AND c >= cos(radians(20))) AS parallel FROM c GROUP BY i)
SELECT i, junction, parallel, CASE WHEN junction THEN 'junction' WHEN parallel THEN 'parallel' ELSE 'straight' END AS context FROM g""")
def road_contexts(spark, sf):
    f = fixes(spark, sf).select(F.col("line_no").alias("i"), F.when(F.col("course") >= 0, F.col("course")).alias("course"), "speed")
    index = R.grid_index(R.shapes(_streets(spark, sf)), _SIZE, S.PARALLEL_MAX_M + S.REACH_M)
    return S.road_context(_tracks(spark, sf).join(f, "i"), index, "i", _SIZE)


OPTIONS = S.Options(unit=HOUR, before=100.0, window=130.0, step=5.0, least_fixes=3, least_path=500.0, least_covered=2, longest_gap=90.0, accuracy=90.0, clearance=2.0, picks=4, apart=40.0)

_SURVEY = f"""
f AS (SELECT session, t, k, lat, lon, accuracy, CASE WHEN accuracy % 2 = 0 THEN 'a' ELSE 'b' END AS source, accuracy % 5 < 4 AS covered FROM (SELECT *, CAST(accuracy AS BIGINT) AS k FROM @fix )),
pins AS (SELECT session, t FROM @ev WHERE kind = 'signup' AND k % 9 = 0),
exc AS (SELECT session, t AS a, t + 3 * {HOUR} AS b FROM @ev WHERE kind = 'view' AND k % 16 = 5),
ends AS (SELECT session, min(t) AS first, max(t) AS last FROM f GROUP BY session),
grid AS (SELECT session, first, unnest(range(CAST(ceil((first + 100 * {HOUR}) / {HOUR}) AS BIGINT) * {HOUR}, last - 30 * {HOUR} + 1, 5 * {HOUR})) AS t FROM ends),
free AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM exc WHERE exc.session = g.session AND a <= g.t + 30 * {HOUR} AND b >= g.t - 100 * {HOUR})
  AND NOT EXISTS (SELECT 1 FROM pins WHERE pins.session = g.session AND pins.t BETWEEN g.t - 102 * {HOUR} AND g.t + 32 * {HOUR})),
ring AS (SELECT g.session, g.t, g.first, f.source, f.t AS ft, lat, lon, covered, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM free g JOIN f ON f.session = g.session AND f.t BETWEEN g.t - 100 * {HOUR} AND g.t WINDOW w AS (PARTITION BY g.session, g.t, f.source ORDER BY f.t)),
xy AS (SELECT *, radians(lon - lon0) * 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat)) AS e, radians(lat - lat0) * 6378137.0 * (1 - 6.69437999014e-3) / pow(1 - 6.69437999014e-3 * pow(sin(radians(lat0)), 2), 1.5) AS n FROM ring),
leg AS (SELECT *, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)) AS leg FROM xy WINDOW w AS (PARTITION BY session, t, source ORDER BY ft)),
r AS (SELECT session, t, first, source, count(*) AS fixes, coalesce(sum(leg), 0) AS path, count(*) FILTER (covered) AS cov FROM leg GROUP BY session, t, first, source HAVING count(*) >= 3 AND round(coalesce(sum(leg), 0), 6) >= 500),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, t ORDER BY fixes DESC, source) AS place FROM r) WHERE place = 1 AND cov >= 2),
p AS (SELECT b.*, x.t AS t1, x.lat AS lat1, x.lon AS lon1, x.accuracy AS acc1, y.t AS t2, y.lat AS lat2, y.lon AS lon2, y.accuracy AS acc2 FROM b ASOF LEFT JOIN f x ON b.session = x.session AND b.source = x.source AND b.t >= x.t ASOF LEFT JOIN f y ON b.session = y.session AND b.source = y.source AND b.t < y.t),
cand AS (SELECT session, t, first, source, fixes, path, CASE WHEN t1 = t THEN lat1 ELSE lat1 + (t - t1) / (t2 - t1) * (lat2 - lat1) END AS lat FROM p WHERE CASE WHEN t1 = t THEN acc1 <= 90 ELSE coalesce(t2 - t1 <= 90 * {HOUR} AND acc1 <= 90 AND acc2 <= 90, false) END)"""


def _candidates(spark, sf):
    e = events(spark, sf)
    a = F.col("accuracy")
    f = fixes(spark, sf).withColumns({"source": F.when(a % 2 == 0, "a").otherwise("b"), "covered": a % 5 < 4})
    pins = e.where("kind = 'signup' and k % 9 = 0").select("session", "t")
    out = e.where("kind = 'view' and k % 16 = 5").select("session", F.col("t").alias("from"), (F.col("t") + 3 * HOUR).alias("to"))
    return S.pin_candidates(f, pins, out, OPTIONS)


@query("pin_candidates", f"WITH {_SURVEY} SELECT session, t, source, fixes, round(path, 4) AS path, round(lat, 8) AS lat FROM cand")
def pin_candidates(spark, sf):
    return _candidates(spark, sf).select("session", "t", "source", "fixes", F.round("path", 4).alias("path"), F.round("lat", 8).alias("lat"))


@query("pin_picks", f"""
WITH RECURSIVE {_SURVEY},
c AS (SELECT session, min(first) AS first, list({{'t': t, 'x': CAST(t // {HOUR} % 3 AS INT)}}) AS c FROM cand GROUP BY session),
g AS (
  SELECT session, first, c, 0 AS k, CAST([] AS BIGINT[]) AS picked FROM c
  UNION ALL SELECT session, first, c, k + 1, CASE WHEN len(picked) < 4 AND len(pool) > 0 THEN list_append(picked, -(list_sort(pool, 'DESC')[1].t)) ELSE picked END FROM (
    SELECT *, list_filter(list_transform(list_filter(c, lambda x: x.x = k % 3), lambda x: {{'far': coalesce(list_min(list_transform(picked, lambda p: abs(p - x.t))), x.t - first), 't': -x.t}}), lambda y: len(picked) = 0 OR y.far >= 40 * {HOUR}) AS pool FROM g WHERE k < 12))
SELECT session, t, (ARRAY['straight', 'junction', 'parallel'])[CAST(t // {HOUR} % 3 AS INT) + 1] AS context, row_number() OVER (PARTITION BY session ORDER BY t) - 1 AS place FROM (SELECT session, unnest(picked) AS t FROM g WHERE k = 12)""")
def pin_picks(spark, sf):
    """Contexts follow the hour, so that each has candidates."""
    turn = F.element_at(F.array(*map(F.lit, S.CONTEXTS)), (F.floor(F.col("t") / HOUR) % 3 + 1).cast("int"))
    return S.spread_picks(_candidates(spark, sf).withColumn("context", turn), OPTIONS)


@query("window_dynamics", f"""
WITH f AS (SELECT session, t, line_no, lat, lon, speed, course FROM @fix ), sp AS (SELECT session, t, max(kmh) / 3.6 AS mps FROM @speed GROUP BY session, t), ry AS (SELECT session, t, max(k - 50) / 1e3 AS r FROM @ev WHERE kind = 'signup' GROUP BY session, t),
g AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM f WINDOW w AS (PARTITION BY session ORDER BY t, line_no)),
h AS (SELECT *, sqrt(pow(radians(lon - o) * 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat)), 2) + pow(radians(lat - a) * 6378137.0 * (1 - 6.69437999014e-3) / pow(1 - 6.69437999014e-3 * pow(sin(radians(a)), 2), 1.5), 2)) AS leg FROM g),
s AS (SELECT session, min(t) AS t0, max(t) AS t1, coalesce(sum(leg), 0) AS path FROM h GROUP BY session),
d AS (SELECT session, sum(mps * greatest(0, least(t1, coalesce(nx, t1), t + 24 * {HOUR}) - greatest(t0, t)) / {HOUR}) AS driven FROM (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t) AS nx FROM sp) JOIN s USING (session) WHERE t1 > t0 AND t >= t0 - 24 * {HOUR} AND t <= t1 GROUP BY session),
b AS (SELECT f.session, f.t, f.speed, x.t AS ta, x.mps AS va, y.t AS tb, y.mps AS vb FROM f ASOF LEFT JOIN sp x ON f.session = x.session AND f.t >= x.t ASOF LEFT JOIN sp y ON f.session = y.session AND f.t < y.t WHERE f.speed >= 0),
q AS (SELECT session, quantile_disc(abs(speed - v) * 3.6, 0.5) AS gap FROM (SELECT *, CASE WHEN ta IS NOT NULL AND (tb IS NULL OR t - ta <= tb - t) THEN CASE WHEN t - ta <= 12 * {HOUR} THEN va END WHEN tb - t <= 12 * {HOUR} THEN vb END AS v FROM b) WHERE v IS NOT NULL GROUP BY session),
c AS (SELECT *, course - lag(course) OVER (PARTITION BY session ORDER BY t, line_no) AS dc FROM f WHERE course >= 0),
u AS (SELECT session, min(t) AS a, max(t) AS b, sum(dc - 360 * round(dc / 360)) AS turn FROM c GROUP BY session HAVING max(t) > min(t)),
y AS (SELECT session, -degrees(sum((r + pr) / 2 * (t - pt) / {HOUR})) AS gyro FROM (SELECT ry.session, r, t, lag(r) OVER w AS pr, lag(t) OVER w AS pt FROM ry JOIN u ON ry.session = u.session AND ry.t BETWEEN a AND b WINDOW w AS (PARTITION BY ry.session ORDER BY t)) GROUP BY session)
SELECT session, round(path, 4) AS path_m, round(driven, 4) AS driven_m, round(gap, 6) AS speed_gap_kmh, round(turn, 6) AS course_change, round(gyro, 4) AS gyro_turn FROM s LEFT JOIN d USING (session) LEFT JOIN q USING (session) LEFT JOIN u USING (session) LEFT JOIN y USING (session)""")
def window_dynamics(spark, sf):
    """The whole session as one window."""
    from .base import speeds

    f = fixes(spark, sf).withColumnRenamed("line_no", "line")
    sp = speeds(spark, sf).groupBy("session", "t").agg((F.max("kmh") / 3.6).alias("mps"))
    ry = events(spark, sf).where("kind = 'signup'").groupBy("session", "t").agg((F.max(F.col("k") - 50) / 1e3).alias("rad_s"))
    d = S.window_dynamics(f, sp, ry, unit=HOUR, hold=24.0, gap=12.0)
    return d.select("session", F.round("path_m", 4).alias("path_m"), F.round("driven_m", 4).alias("driven_m"), F.round("speed_gap_kmh", 6).alias("speed_gap_kmh"), F.round("course_change", 6).alias("course_change"), F.round("gyro_turn", 4).alias("gyro_turn"))
