"""Queries of motion scalars, display text and checkpoints. A click is a fix, a signup a pin, and an hour of the log counts as a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import motion as K
from ..operators import checkpoints as C
from .base import HOUR, events, query

_R = lambda c, n=9: F.round(c, n) + 0.0


@query("motion_coefficients", """
WITH b AS (SELECT line_no, k * 25e-2 AS dt, 2.5e0 AS s, (k % 4) * 10e0 AS tau, k * 1e0 AS ee, k % 7 * 3e-1 AS en, value + 1 AS nn, k - 50 AS ze, value * 5e-1 AS zn, k % 3 * 5e-1 AS cp FROM @ev ),
o AS (SELECT *, -(exp(-dt / nullif(tau, 0)) - 1) AS a FROM b),
p AS (SELECT *, CASE WHEN tau > 0 THEN s * s * tau / 2 * a * (2 - a) ELSE s * s * dt END AS v, CASE WHEN tau > 0 THEN s * s * tau * tau / 2 * a * a ELSE s * s * dt * dt / 2 END AS cv,
  CASE WHEN tau > 0 THEN s * s * tau * tau * (dt - 2 * tau * a + tau / 2 * a * (2 - a)) ELSE s * s * dt * dt * dt / 3 END AS vi, (ee + 4) * (nn + 4) - en * en AS det FROM o),
q AS (SELECT *, CASE WHEN v > 0 THEN cv / sqrt(v) ELSE 0 END AS oe, (nn + 4) / det AS iee, (ee + 4) / det AS inn, -en / det AS ien FROM p),
r AS (SELECT *, ee * iee + en * ien AS kee, ee * ien + en * inn AS ken, en * iee + nn * ien AS kne, en * ien + nn * inn AS knn, ze * (iee * ze + ien * zn) + zn * (ien * ze + inn * zn) AS chi2, cp * en / (nn + 4) AS ka, nn / (nn + 4) AS kc FROM q)
SELECT line_no, round(CASE WHEN tau > 0 THEN 1 - a ELSE 1 END, 6) + 0.0 AS decay, round(sqrt(greatest(0, v)), 6) + 0.0 AS sigma_end, round(CASE WHEN tau > 0 THEN tau * a ELSE dt END, 6) + 0.0 AS gain, round(oe, 6) + 0.0 AS on_end, round(sqrt(greatest(0, vi - oe * oe)), 3) + 0.0 AS own,
  round(kee * ze + ken * zn, 6) + 0.0 AS east, round(kne * ze + knn * zn, 6) + 0.0 AS north, round(ee - (kee * ee + ken * en), 6) + 0.0 AS ee1, round(nn - (kne * en + knn * nn), 6) + 0.0 AS nn1, round(-5e-1 * chi2 - 5e-1 * ln(det), 6) + 0.0 AS log_likelihood,
  round(-ka * 3, 6) + 0.0 AS da, round(-kc * 3, 6) + 0.0 AS dc, round(ee - 2 * ka * en + ka * ka * (nn + 4), 6) + 0.0 AS paa, round((en - ka * nn) * (1 - kc) + ka * kc * 4, 6) + 0.0 AS pac, round((1 - kc) * (1 - kc) * nn + kc * kc * 4, 6) + 0.0 AS pcc FROM r""")
def motion_coefficients(spark, sf):
    k, v, one = F.col("k"), F.col("value"), F.lit(0.0)
    o = K.ou_coefficients(k * 0.25, 2.5, (k % 4) * 10.0)
    p = K.position_update(one, one, k * 1.0, k % 7 * 0.3, v + 1, k - 50, v * 0.5, 4.0)
    x = K.cross_track_update(k * 1.0, k % 7 * 0.3, v + 1, 3.0, 4.0, k % 3 * 0.5)
    e = events(spark, sf).select("line_no", o.alias("o"), p.alias("p"), x.alias("x"))
    return e.select("line_no", *(_R(f"o.{c}", 6).alias(c) for c in ("decay", "sigma_end", "gain", "on_end")), _R("o.own", 3).alias("own"), _R("p.east", 6).alias("east"), _R("p.north", 6).alias("north"), _R("p.ee", 6).alias("ee1"), _R("p.nn", 6).alias("nn1"),
        _R("p.log_likelihood", 6).alias("log_likelihood"), *(_R(f"x.{c}", 6).alias(c) for c in ("da", "dc", "paa", "pac", "pcc")))


@query("prior_and_view_rules", """
WITH b AS (SELECT line_no, k, value AS v, CAST(k % 11 AS DOUBLE) AS gap, (ARRAY['parked', 'standingStop', 'moving'])[CAST(k % 3 + 1 AS INT)] AS kind, k % 5 = 0 AS mv, k * 3e0 AS ee, k % 4 * 1e0 AS en, k * 2e0 + 5 AS nn, k * 3.6e0 AS h, k % 28 * 1e0 AS hs, v / 5 AS sp FROM (SELECT *, value AS v FROM @ev )),
m AS (SELECT *, kind = 'moving' OR mv AS mov, greatest(sp, 11.1) * gap AS drift FROM b),
g AS (SELECT *, CASE WHEN mov THEN drift ELSE least(CASE WHEN kind = 'parked' THEN 10 ELSE 50 END, drift) END AS add_, CASE WHEN mov THEN CASE WHEN gap <= 5 THEN sqrt(hs * hs + pow(5.5 * gap, 2)) END ELSE sqrt(hs * hs + pow(least(3, 5.5 * gap), 2)) END AS s0 FROM m),
s AS (SELECT *, CASE WHEN s0 <= 30 THEN s0 END AS sg, sqrt(greatest(0, (ee + nn + 2 * add_ * add_) / 2 + sqrt(pow((ee - nn) / 2, 2) + en * en))) AS major FROM g),
e AS (SELECT *, radians(h - 2 * k) AS th, v + 30 AS a, (v + 30) * 4e-1 AS b2 FROM s)
SELECT line_no, CASE WHEN major <= 1500 THEN round(ee + add_ * add_, 6) END AS seed_ee, CASE WHEN major <= 1500 THEN round(radians(sg), 9) END AS seed_heading_sigma, CASE WHEN major <= 1500 THEN round(CASE WHEN mov AND gap <= 5 AND sg IS NOT NULL THEN sp * gap ELSE 0 END * sin(radians(h)), 6) + 0.0 END AS shift_east,
  round(CASE WHEN k > 20 THEN greatest(1.0, CASE WHEN k % 2 = 0 THEN v ELSE 0 END) * k ELSE 0 END, 6) AS growth, round(coalesce(CASE WHEN k % 3 = 0 THEN k END, CASE WHEN v < 50 THEN v END, 0), 6) AS start_speed, round(CASE WHEN k = 0 THEN 0 WHEN k % 2 = 0 THEN k / 1.51 ELSE k END, 6) AS truth_sigma,
  round(sqrt(a * a * pow(sin(th), 2) + b2 * b2 * pow(cos(th), 2)), 6) AS across, round(least(greatest(sqrt(a * a * pow(sin(th), 2) + b2 * b2 * pow(cos(th), 2)) / 180, sqrt(a * a * pow(cos(th), 2) + b2 * b2 * pow(sin(th), 2)) / 240) * 1.1 * 800, 8000), 6) AS span, round(sqrt(k * k + v * v + 4), 6) AS magnitude,
  round(CASE WHEN k * 7 - 300 < 0 THEN k * 7 - 300 + 360 ELSE (k * 7 - 300) % 360 END * 1e0, 6) AS heading, CASE WHEN (k * 7) % 360 > 180 THEN (k * 7) % 360 - 360 ELSE (k * 7) % 360 END * 1e0 AS turn FROM e""")
def prior_and_view_rules(spark, sf):
    k, v = F.col("k"), F.col("value")
    kind = F.element_at(F.array(*map(F.lit, ("parked", "standingStop", "moving"))), (k % 3 + 1).cast("int"))
    seed = K.restored_seed(kind, k % 5 == 0, (k % 11).cast("double"), k * 3.0, k % 4 * 1.0, k * 2.0 + 5, k * 3.6, k % 28 * 1.0, v / 5)
    a = v + 30
    return events(spark, sf).withColumn("s", seed).select("line_no", F.round("s.ee", 6).alias("seed_ee"), F.round("s.heading_sigma", 9).alias("seed_heading_sigma"), _R("s.shift_east", 6).alias("shift_east"), F.round(K.stale_growth(k, F.when(k % 2 == 0, v), 20.0, 1.0), 6).alias("growth"),
        F.round(K.initial_speed(F.when(k % 3 == 0, k * 1.0), F.when(v < 50, v).otherwise(-1.0)), 6).alias("start_speed"), F.round(K.truth_sigma(F.when(k % 2 == 0, "cleanFix").otherwise("manualFix"), k * 1.0), 6).alias("truth_sigma"), F.round(K.half_extents(a, a * 0.4, k * 3.6, k * 2)[0], 6).alias("across"),
        F.round(K.required_span(a, a * 0.4, k * 3.6, k * 2, 0.6, 400.0, 800.0, 10.0, 10.0, 80.0, 20.0), 6).alias("span"), F.round(K.magnitude(k, v, F.lit(2)), 6).alias("magnitude"), F.round(K.display_heading(k * 7 - 300.0), 6).alias("heading"), K.shortest_turn(F.lit(0.0), k * 7.0).alias("turn"))


@query("display_values", """
WITH b AS (SELECT line_no, k, value AS v, t, CAST(k * k * k * 997 AS BIGINT) AS n FROM @ev )
SELECT line_no, CASE WHEN k % 10 = 0 THEN '--' ELSE CAST(CAST(floor(greatest(0, v - 3) + 0.5) AS BIGINT) AS VARCHAR) END AS speed, CASE WHEN k * 100 >= 3600 THEN (k * 100 // 3600) || ':' || lpad((k * 100 % 3600 // 60)::VARCHAR, 2, '0') ELSE (k * 100 // 60)::VARCHAR END || ':' || lpad((k * 100 % 60)::VARCHAR, 2, '0') AS elapsed,
  'Drive_' || strftime(make_timestamp(t // 1000 + CASE WHEN k % 2 = 0 THEN 7200000000 ELSE 0 END), '%Y%m%d-%H%M%S') || CASE WHEN k % 4 > 1 THEN '_' || (k % 4) ELSE '' END || '.jsonl.gz' AS file,
  CASE k % 4 WHEN 0 THEN 'protocol 7 is not 11-bit ISO 15765-4 CAN (6, A6, 8, A8)' WHEN 1 THEN NULL ELSE 'no 7E8 reply to 0100' END AS cause,
  CASE k % 6 WHEN 0 THEN 'noFix' WHEN 1 THEN 'invalidPosition' WHEN 2 THEN 'inaccurate' WHEN 3 THEN 'late' WHEN 4 THEN 'stale' ELSE 'usable' END AS verdict, CASE WHEN k % 3 = 0 THEN 'obd' WHEN k % 3 = 1 AND k % 7 > 0 THEN 'gps' ELSE 'unknown' END AS source FROM b""")
def display_values(spark, sf):
    k, v = F.col("k"), F.col("value")
    at = F.timestamp_micros(F.floor(F.col("t") / 1000))
    supported = F.when(k % 4 == 1, "7E8 06 41 00 BE 1F A8 13\r7E9 41\r>").when(k % 4 == 2, "7E9 06 41 00 BE 1F A8 13\r>")
    d = lambda x: F.lit(float(x))
    m = k % 6
    verdict = K.fix_verdict(F.when(m != 0, F.when(m == 1, 95.0).otherwise(50.0)), d(30), F.when(m == 2, -1.0).otherwise(10.0), F.when(m == 3, 99.0).otherwise(1.0), F.when(m == 4, float("nan")).otherwise(1.0), F.lit(True), 100.0, 30.0, 5.0)
    gate = K.manual_gate(F.when(k % 3 != 1, v), F.when(k % 3 == 2, 3.0).otherwise(1.0), F.when(k % 3 == 2, -1.0).otherwise(v), d(1), F.when(k % 7 == 0, 200.0).otherwise(5.0), d(1))
    return events(spark, sf).select("line_no", K.display_speed(F.when(k % 10 == 0, None).otherwise(v - 3)).alias("speed"), K.display_elapsed((k * 100).cast("double")).alias("elapsed"),
        K.recording_file(at, F.when(k % 2 == 0, "Europe/Kyiv").otherwise("UTC"), k % 4).alias("file"), K.addressing_cause(F.when(k % 4 == 0, "7").otherwise("A6"), supported).alias("cause"), verdict.alias("verdict"), gate["source"].alias("source"))


_SCHED = f"""
x AS (SELECT session, t, line_no, kind, k, value AS v FROM @ev ),
fx AS (SELECT session, t, line_no AS line, 50 + k * 1e-4 AS lat, 30 + v * 1e-4 AS lon, k % 20 * 1e0 AS acc FROM x WHERE kind = 'click' AND v > 5),
rg AS (SELECT session, t AS a, t + 20 * {HOUR} AS b FROM x WHERE kind = 'view' AND k % 10 = 3),
pn AS (SELECT session, t, line_no AS line, 50 + k * 1e-4 AS lat, 30.001 AS lon, 30 + k * 1e0 AS sigma FROM x WHERE kind = 'signup'),
ex AS (SELECT session, t + CASE WHEN k % 3 = 0 THEN 50000000 ELSE 200000000 END AS t FROM x WHERE kind = 'signup' AND k % 4 = 1),
tp AS (SELECT session, t, 50 + k * 1e-4 AS lat, 30.0 AS lon, CASE WHEN k % 2 = 0 THEN 3e0 END AS sigma FROM x WHERE kind = 'purchase' AND k % 5 = 0),
en AS (SELECT session, max(t) AS t, 50.004 AS lat, 30.004 AS lon, 5e0 AS sigma FROM x WHERE session % 3 = 0 GROUP BY session),
cf AS (SELECT session, min(t) + 500 * {HOUR} AS until FROM x WHERE session % 4 = 1 GROUP BY session),
pr AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY session ORDER BY t, line) <= 30 * {HOUR}, false) AS refines FROM pn),
ht AS (SELECT DISTINCT session, line FROM (SELECT ex.session, ex.t, pn.line, row_number() OVER (PARTITION BY ex.session, ex.t ORDER BY abs(pn.t - ex.t), pn.t, pn.line) AS r FROM ex JOIN pn ON ex.session = pn.session AND abs(pn.t - ex.t) <= 100000000) WHERE r = 1),
sc AS (SELECT session, t, 'manualFix' AS kind, line, lat, lon, sigma, CASE WHEN ht.line IS NOT NULL THEN 'excluded' WHEN refines THEN 'refinement' END AS not_scored FROM pr LEFT JOIN ht USING (session, line)
  UNION ALL SELECT session, t, 'cleanFix', line, lat, lon, acc, NULL FROM fx WHERE acc <= 15 AND NOT EXISTS (SELECT 1 FROM rg WHERE rg.session = fx.session AND fx.t BETWEEN a AND b)
  UNION ALL SELECT session, t, 'truthPoint', NULL, lat, lon, sigma, NULL FROM tp UNION ALL SELECT session, t, 'truthEnd', NULL, lat, lon, sigma, NULL FROM en),
sd AS (SELECT sc.*, coalesce(t > until, false) AS after_cutoff FROM sc LEFT JOIN cf USING (session)),
re AS (SELECT *, 50.002 AS e_lat, 30.003 AS e_lon, CASE WHEN kind <> 'truthPoint' OR sigma IS NOT NULL THEN 150e0 END AS major, coalesce(line, 7) % 5 * 20e0 AS distance,
  radians(lon - 30.003) * 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat)) AS de, radians(lat - 50.002) * 6378137.0 * (1 - 6.69437999014e-3) / pow(1 - 6.69437999014e-3 * pow(sin(radians(50.002)), 2), 1.5) AS dn FROM sd),
rs AS (SELECT *, CASE WHEN major IS NOT NULL THEN sqrt(de * de + dn * dn) END AS error_m, CASE WHEN sigma > 0 THEN CASE WHEN kind = 'cleanFix' THEN sigma / 1.51 ELSE sigma END ELSE 0 END AS ts FROM re)"""


def _schedule(spark, sf):
    e, k, v, t = events(spark, sf), F.col("k"), F.col("value"), F.col("t")
    lat, line = (50 + k * 1e-4).alias("lat"), F.col("line_no").alias("line")
    kind = lambda name: e.where(F.col("kind") == name)
    f = kind("click").select("session", "t", line, lat, (30 + v * 1e-4).alias("lon"), (k % 20 * 1.0).alias("accuracy"), (v > 5).alias("withheld"))
    ranges = kind("view").where(k % 10 == 3).select("session", t.alias("from"), (t + 20 * HOUR).alias("to"))
    pins = kind("signup").select("session", "t", line, lat, F.lit(30.001).alias("lon"), (30 + k * 1.0).alias("sigma"))
    out = kind("signup").where(k % 4 == 1).select("session", (t + F.when(k % 3 == 0, 50_000_000).otherwise(200_000_000)).alias("t"))
    points = kind("purchase").where(k % 5 == 0).select("session", "t", lat, F.lit(30.0).alias("lon"), F.when(k % 2 == 0, 3.0).alias("sigma"))
    ends = e.where(F.col("session") % 3 == 0).groupBy("session").agg(F.max("t").alias("t")).select("session", "t", F.lit(50.004).alias("lat"), F.lit(30.004).alias("lon"), F.lit(5.0).alias("sigma"))
    cutoff = e.where(F.col("session") % 4 == 1).groupBy("session").agg((F.min("t") + 500 * HOUR).alias("until"))
    return C.schedule(f, pins, points, ends, ranges, out, cutoff, 30 * HOUR)


def _results(spark, sf):
    there = (F.col("kind") != "truthPoint") | F.col("sigma").isNotNull()
    s = _schedule(spark, sf).withColumns({"e_lat": F.when(there, 50.002), "e_lon": F.when(there, 30.003), "major": F.when(there, 150.0), "minor": F.when(there, 60.0), "orientation": F.when(there, 0.0), "distance": F.coalesce("line", F.lit(7)) % 5 * 20.0})
    return C.scored(s)


@query("checkpoint_schedule", f"WITH {_SCHED} SELECT session, t, kind, line, round(lat, 6) AS lat, round(lon, 6) AS lon, sigma, not_scored, after_cutoff FROM sd")
def checkpoint_schedule(spark, sf):
    return _schedule(spark, sf).select("session", "t", "kind", "line", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "sigma", "not_scored", "after_cutoff")


@query("checkpoint_results", f"""
WITH {_SCHED} SELECT session, t, kind, line, round(error_m, 6) AS error_m, round(CASE WHEN distance > 0 THEN 100 * error_m / distance END, 6) AS error_pct, CASE WHEN major IS NOT NULL THEN pow(dn / 150, 2) + pow(de / 60, 2) <= 1 END AS inside,
  CASE WHEN major IS NOT NULL THEN dn * dn / (150 * 150 + 5.991 * ts * ts) + de * de / (60 * 60 + 5.991 * ts * ts) <= 1 END AS inside_wide FROM rs""")
def checkpoint_results(spark, sf):
    return _results(spark, sf).select("session", "t", "kind", "line", F.round("error_m", 6).alias("error_m"), F.round("error_pct", 6).alias("error_pct"), "inside", "inside_wide")


@query("run_figures", f"""
WITH {_SCHED}, c AS (SELECT *, round(error_m, 6) AS e, CASE WHEN distance > 0 THEN 100 * error_m / distance END AS pct, CASE kind WHEN 'cleanFix' THEN 1 WHEN 'manualFix' THEN 2 WHEN 'truthPoint' THEN 3 ELSE 4 END AS kk, coalesce(line, -1) AS ln FROM rs WHERE error_m IS NOT NULL AND not_scored IS NULL AND NOT after_cutoff)
SELECT session, count(*) AS scored, max(e) AS max_error_m, round(arg_min(coalesce(pct, -1), (-e, t, kk, ln)), 6) AS max_error_pct, coalesce(arg_max(e, (t, kk, ln)) FILTER (kind = 'truthEnd'), arg_max(e, (t, kk, ln))) AS end_error_m, bool_or(kind = 'truthEnd') AS end_is_truth FROM c GROUP BY session""")
def run_figures(spark, sf):
    return C.run_figures(_results(spark, sf)).withColumn("max_error_pct", F.round(F.coalesce("max_error_pct", F.lit(-1.0)), 6))


@query("road_verdicts", """
WITH b AS (SELECT line_no, k, value AS v, (ARRAY['matched', 'noRoad', 'ambiguous', 'noCourse'])[CAST(k % 4 + 1 AS INT)] AS truth, CASE WHEN k % 7 > 0 THEN v END AS nearest, CASE WHEN k % 5 > 0 THEN k / 100e0 END AS share, CASE WHEN k % 6 > 0 THEN k % 3 END AS matched, k % 2 AS true_way, CASE WHEN k % 8 > 0 THEN v * 2 END AS md, v AS axis, k % 3 = 0 AS inside, k % 11 > 0 AS est FROM @ev ),
u AS (SELECT *, CASE WHEN nearest IS NULL OR nearest > 15 THEN 'noRoadWithin15' WHEN truth = 'noRoad' THEN 'noCompatibleRoadWithin15' END AS unmapped FROM b)
SELECT line_no, CASE WHEN truth = 'matched' AND est THEN CASE WHEN share IS NULL THEN 'notEngaged' WHEN share < 0.5 THEN 'off' WHEN matched IS NOT NULL AND (matched = true_way OR coalesce(md, 1e9) <= 12) THEN 'right' ELSE 'wrong' END END AS verdict, unmapped,
  unmapped IS NOT NULL AND est AND coalesce(share, 0) >= 0.5 AND matched IS NOT NULL AND axis < 25 AND NOT inside AS captured FROM u""")
def road_verdicts(spark, sf):
    k, v = F.col("k"), F.col("value")
    truth = F.element_at(F.array(*map(F.lit, ("matched", "noRoad", "ambiguous", "noCourse"))), (k % 4 + 1).cast("int"))
    r = C.road_verdict(truth, F.when(k % 7 > 0, v), F.when(k % 5 > 0, k / 100.0), F.when(k % 6 > 0, k % 3), k % 2, F.when(k % 8 > 0, v * 2), v, k % 3 == 0, 12.0, k % 11 > 0)
    return events(spark, sf).select("line_no", r.alias("r")).select("line_no", "r.verdict", "r.unmapped", "r.captured")
