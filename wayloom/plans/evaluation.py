"""Queries of evaluation and catalog rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import catalog as C
from ..operators import evaluate as V
from .base import HOUR, events, query, table

_SCORED = """
s AS (SELECT session, line_no, t, kind, (k - 50) * 12e-1 AS de, (k % 13 - 6) * 20e-1 AS dn, value * 10 AS dist FROM @ev ),
x AS (SELECT *, sqrt(de * de + dn * dn) AS m, CASE WHEN dist > 0 THEN 100 * sqrt(de * de + dn * dn) / dist END AS pct, de * de / 900e0 + dn * dn / 64e0 <= 1 AS inside FROM s)"""


def _scores(spark, sf):
    k = F.col("k")
    e = events(spark, sf).withColumns({"de": (k - 50) * 1.2, "dn": (k % 13 - 6) * 2.0, "dist": F.col("value") * 10})
    de, dn = F.col("de"), F.col("dn")
    return V.scored(e, de, dn, de * de / 900.0 + dn * dn / 64.0 <= 1, F.col("dist"))


@query("checkpoint_scores", f"WITH {_SCORED} SELECT line_no, round(m, 6) AS error_m, round(pct, 6) AS error_pct, inside FROM x")
def checkpoint_scores(spark, sf):
    return _scores(spark, sf).select("line_no", F.round("error_m", 6).alias("error_m"), F.round("error_pct", 6).alias("error_pct"), "inside")


@query("ellipse_consistency", f"WITH {_SCORED} SELECT kind, count(*) FILTER (inside) AS inside, count(*) AS scored FROM x GROUP BY ROLLUP (kind)")
def ellipse_consistency(spark, sf):
    return V.consistency(_scores(spark, sf), "kind")


@query("largest_errors", f"""
WITH {_SCORED}, r AS (SELECT kind, t, round(m, 6) AS m, round(pct, 6) AS pct FROM x)
SELECT kind, max(m) AS max_m, arg_max(t, (m, -t)) AS max_m_t, max(pct) AS max_pct, arg_max(t, (pct, -t)) FILTER (pct IS NOT NULL) AS max_pct_t FROM r GROUP BY kind""")
def largest_errors(spark, sf):
    s = _scores(spark, sf).withColumns({"error_m": F.round("error_m", 6), "error_pct": F.round("error_pct", 6)})
    return V.largest_errors(s, "kind", "t")


@query("verdict_shares", """
WITH d AS (SELECT session, t, CASE WHEN k < 60 THEN 'right' WHEN k < 80 THEN 'wrong' WHEN k < 90 THEN 'off' ELSE 'notEngaged' END AS verdict, sum(value) OVER (PARTITION BY session ORDER BY t, line_no) AS dist FROM @ev ),
w AS (SELECT *, greatest(0, coalesce(dist - lag(dist) OVER (PARTITION BY session ORDER BY t), 0)) AS w FROM d),
g AS (SELECT *, sum(w) OVER (PARTITION BY session) AS whole FROM w)
SELECT session, verdict, count(*) AS n, round(CASE WHEN max(whole) > 0 THEN sum(w) / max(whole) END, 6) AS share FROM g GROUP BY session, verdict""")
def verdict_shares(spark, sf):
    k = F.col("k")
    v = F.when(k < 60, "right").when(k < 80, "wrong").when(k < 90, "off").otherwise("notEngaged")
    e = events(spark, sf).withColumns({"verdict": v, "dist": F.sum("value").over(Window.partitionBy("session").orderBy("t", "line_no"))})
    return V.verdict_shares(e, ["session"], "t", "dist", "verdict").withColumn("share", F.round("share", 6))


_W = """
l AS (SELECT session, line_no, value AS x, CAST(k AS DOUBLE) AS y, k * 5e-2 AS h, -value / 50 AS lw, k % 9 AS edge FROM @ev ),
n AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY session)) AS e FROM l),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY session) AS w FROM n)"""


def _weights(spark, sf):
    k = F.col("k")
    e = events(spark, sf).select("session", "line_no", F.col("value").alias("x"), k.cast("double").alias("y"), (k * 0.05).alias("h"), (-F.col("value") / 50).alias("lw"), (k % 9).alias("edge"))
    return V.normalised(e, ["session"], "lw")


@query("normalised_weights", f"WITH {_W} SELECT session, line_no, round(w, 9) AS weight FROM w")
def normalised_weights(spark, sf):
    return _weights(spark, sf).select("session", "line_no", F.round("weight", 9).alias("weight"))


@query("weighted_moments", f"""
WITH {_W}, m AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM w WINDOW p AS (PARTITION BY session))
SELECT session, round(any_value(mx), 6) AS mean_x, round(any_value(my), 6) AS mean_y, round(sum(w * (x - mx) * (x - mx)) / sum(w), 5) AS xx, round(sum(w * (x - mx) * (y - my)) / sum(w), 5) AS xy, round(sum(w * (y - my) * (y - my)) / sum(w), 5) AS yy,
  round(atan2(sum(w * sin(h)) / sum(w), sum(w * cos(h)) / sum(w)), 6) AS heading, round(sqrt(-2 * ln(least(greatest(sqrt(pow(sum(w * sin(h)) / sum(w), 2) + pow(sum(w * cos(h)) / sum(w), 2)), 1e-12), 1.0))), 6) AS heading_std, round(sum(w) * sum(w) / sum(w * w), 5) AS ess FROM m GROUP BY session""")
def weighted_moments(spark, sf):
    m = V.moments(_weights(spark, sf), ["session"], "x", "y", "h", "weight")
    return m.select("session", *(F.round(c, d).alias(c) for c, d in (("mean_x", 6), ("mean_y", 6), ("xx", 5), ("xy", 5), ("yy", 5), ("heading", 6), ("heading_std", 6), ("ess", 5))))


@query("heaviest_edge", f"""
WITH {_W}, g AS (SELECT session, edge, sum(w) AS mass FROM w GROUP BY session, edge)
SELECT session, edge, round(mass, 6) AS mass FROM g QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(mass, 9) DESC, edge) = 1""")
def heaviest_edge(spark, sf):
    return V.heaviest(_weights(spark, sf), ["session"], "edge", "weight").withColumn("mass", F.round("mass", 6))


@query("offset_scan", """
WITH p AS (SELECT session % 20 AS g, k * 3.0e0 AS x, value AS y FROM @ev WHERE kind = 'click'),
s AS (SELECT a.i * 40 AS dx, b.i * 40 AS dy FROM generate_series(-3, 3) a(i), generate_series(-3, 3) b(i)),
d AS (SELECT g, dx, dy, least(100.0e0, abs((x + dx) - 60 * round((x + dx) / 60)) + abs((y + dy) - 90 * round((y + dy) / 90))) AS score FROM p, s),
m AS (SELECT g, dx, dy, avg(score) AS mean, median(score) AS median, quantile_disc(score, 0.9) AS p90 FROM d GROUP BY ALL)
SELECT g, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(mean, 6) AS mean, round(median, 6) AS median, round(p90, 6) AS p90, round(cume_dist() OVER (PARTITION BY g ORDER BY round(mean, 9)), 6) AS rank FROM m""")
def offset_scan(spark, sf):
    p = events(spark, sf).where("kind = 'click'").select((F.col("session") % 20).alias("g"), (F.col("k") * 3.0).alias("x"), F.col("value").alias("y"))
    side = F.sequence(F.lit(-3), F.lit(3))
    s = spark.range(1).select(F.explode(side).alias("i")).select((F.col("i") * 40).alias("dx"), F.explode(side).alias("j")).select("dx", (F.col("j") * 40).alias("dy"))
    x, y = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    score = F.least(F.lit(100.0), F.abs(x - 60 * F.round(x / 60)) + F.abs(y - 90 * F.round(y / 90)))
    r = V.offset_scan(p, s, ["g"], score)
    return r.select("g", "dx", "dy", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "rank")))


@query("config_differences", """
WITH a AS (SELECT k, min(value) AS v FROM @ev WHERE kind = 'click' GROUP BY k), b AS (SELECT k, min(value) AS v FROM @ev WHERE kind = 'view' AND k % 3 <> 0 GROUP BY k)
SELECT k, a.v AS a, b.v AS b FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def config_differences(spark, sf):
    e = events(spark, sf)
    a = e.where("kind = 'click'").groupBy("k").agg(F.min("value").alias("v"))
    b = e.where("kind = 'view' and k % 3 <> 0").groupBy("k").agg(F.min("value").alias("v"))
    return V.key_differences(a, b, "k", "v")


@query("metrics_upsert", """
WITH o AS (SELECT session, kind, max(value) AS v, count(*) AS n FROM @ev WHERE k < 50 GROUP BY ALL), n AS (SELECT session, kind, min(value) AS v FROM @ev WHERE k >= 80 GROUP BY ALL)
SELECT session, kind, CASE WHEN n.v IS NULL THEN o.v ELSE n.v END AS v, CASE WHEN n.v IS NULL THEN o.n END AS n FROM o FULL JOIN n USING (session, kind)""")
def metrics_upsert(spark, sf):
    e = events(spark, sf)
    o = e.where("k < 50").groupBy("session", "kind").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    n = e.where("k >= 80").groupBy("session", "kind").agg(F.min("value").alias("v"))
    return V.upserted(o, n, ["session", "kind"])


@query("manifest_entries", """
WITH m AS (SELECT p_partkey AS idx, CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'Bad Name' ELSE replace(p_name, ' ', '-') || '-' || p_partkey % 400 END AS name, CASE WHEN p_size % 13 = 0 THEN 'city' ELSE 'region' END AS kind,
  CAST(p_size % 5 - 1 AS DOUBLE) AS w, 3.0e0 AS e, CASE WHEN p_size % 3 = 0 THEN 'http://a.example/x' WHEN p_size % 17 = 0 THEN 'https://b.example/x' ELSE 'https://a.example/x' END AS url, p_partkey % 50 AS size FROM part),
r AS (SELECT *, CASE WHEN name IS NULL THEN 'missing name' WHEN name = 'Bad Name' THEN 'invalid name' WHEN kind = 'city' THEN 'unknown kind' WHEN url LIKE 'http:%' THEN 'not https' WHEN url LIKE '%b.example%' THEN 'other host' WHEN size = 0 THEN 'invalid size' END AS reason FROM m)
SELECT idx, name, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY name, reason IS NULL ORDER BY idx) > 1 THEN 'duplicate name' ELSE reason END AS reason FROM r""")
def manifest_entries(spark, sf):
    s = F.col("p_size")
    name = F.when(s % 11 == 0, None).when(s % 7 == 0, "Bad Name").otherwise(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), (F.col("p_partkey") % 400).cast("string")))
    url = F.when(s % 3 == 0, "http://a.example/x").when(s % 17 == 0, "https://b.example/x").otherwise("https://a.example/x")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), name.alias("name"), F.when(s % 13 == 0, "city").otherwise("region").alias("kind"), (s % 5 - 1).cast("double").alias("w"), url.alias("url"), (F.col("p_partkey") % 50).alias("size"))
    reason = C.entry_reason(F.col("name"), F.col("kind"), (F.col("w"), F.lit(0.0), F.lit(3.0), F.lit(1.0)), F.col("url"), "a.example", F.col("size"), F.lit("0" * 64), F.lit("a" * 16), F.lit(1), F.lit("title"))
    return C.first_of_name(p.withColumn("reason", reason), "idx").select("idx", "name", "reason")


_FILES = """f AS (SELECT p_partkey AS file, p_brand AS name, p_partkey * 31 % 97 AS osm, p_size AS installed, p_type AS content_hash, p_partkey % 9 = 0 AS marked FROM part)"""


def _files(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("file"), F.col("p_brand").alias("name"), (k * 31 % 97).alias("osm"), F.col("p_size").alias("installed"), F.col("p_type").alias("content_hash"), (k % 9 == 0).alias("marked"))


@query("active_set", f"""
WITH {_FILES} SELECT file, name, CASE WHEN marked THEN 'marked' WHEN row_number() OVER (PARTITION BY name, marked ORDER BY osm DESC, installed DESC, content_hash DESC, file DESC) = 1 THEN 'active' ELSE 'superseded' END AS state FROM f""")
def active_set(spark, sf):
    return C.active_set(_files(spark, sf)).select("file", "name", "state")


@query("stale_files", f"""
WITH {_FILES} SELECT file, name FROM f WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = f.file)""")
def stale_files(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"))
    return _files(spark, sf).join(known, "file", "left_anti").select("file", "name")


@query("verification_cache", f"""
WITH {_FILES}, k AS (SELECT file, installed FROM f WHERE file % 3 = 0 UNION SELECT file, installed + 1 FROM f WHERE file % 5 = 0)
SELECT f.file, k.file IS NOT NULL AS hit FROM f LEFT JOIN k ON f.file = k.file AND f.installed = k.installed""")
def verification_cache(spark, sf):
    f = _files(spark, sf)
    k = f.where("file % 3 = 0").select("file", "installed").union(f.where("file % 5 = 0").select("file", F.col("installed") + 1)).distinct()
    return C.cached(f, k, ["file", "installed"]).select("file", "hit")


_PACKS = """packs AS (SELECT s_name AS name, 29.0e0 + s_suppkey % 8 * 2.5e-1 AS w, 29.0e0 + s_suppkey % 8 * 2.5e-1 + 4e-1 AS e, 49.8e0 + s_suppkey % 5 * 1e-1 AS s, 49.8e0 + s_suppkey % 5 * 1e-1 + 2e-1 AS n FROM supplier),
p AS (SELECT c_custkey, 28.8e0 + c_custkey % 97 * 2.6e-2 AS lon, 49.7e0 + c_custkey % 89 * 8e-3 AS lat FROM customer)"""


def _packs(spark, sf):
    k = F.col("s_suppkey")
    w, s = 29.0 + k % 8 * 0.25, 49.8 + k % 5 * 0.1
    packs = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), w.alias("w"), (w + 0.4).alias("e"), s.alias("s"), (s + 0.2).alias("n"))
    c = F.col("c_custkey")
    return packs, table(spark, sf, "customer").select(c, (28.8 + c % 97 * 0.026).alias("lon"), (49.7 + c % 89 * 0.008).alias("lat"))


@query("containing_region", f"""
WITH {_PACKS}, j AS (SELECT c_custkey, name, round(pow(lon - (w + e) / 2, 2) + pow(lat - (s + n) / 2, 2), 12) AS d2 FROM p JOIN packs ON lon BETWEEN w AND e AND lat BETWEEN s AND n)
SELECT c_custkey, arg_min(name, (d2, name)) AS name FROM j GROUP BY c_custkey""")
def containing_region(spark, sf):
    packs, points = _packs(spark, sf)
    return C.containing_region(points, packs, "c_custkey")


@query("region_neighbours", f"""
WITH {_PACKS}, j AS (SELECT c_custkey, name, sqrt(pow(greatest(0, w - lon, lon - e) * 111320 * cos(radians(lat)), 2) + pow(greatest(0, s - lat, lat - n) * 111320, 2)) AS d FROM p, packs)
SELECT c_custkey, name, round(d, 3) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 6), name) AS place FROM j WHERE d <= 20000""")
def region_neighbours(spark, sf):
    packs, points = _packs(spark, sf)
    return C.neighbours(points, packs, "c_custkey", 20000.0, digits=3)


@query("pack_offers", f"""
WITH x AS (SELECT session, line_no, t, k % 10 < 8 AS outside, k % 10 < 7 AS stopped FROM @ev ),
y AS (SELECT *, t - coalesce(max(CASE WHEN NOT outside THEN t END) OVER w, min(t) OVER w) AS o, t - coalesce(max(CASE WHEN NOT stopped THEN t END) OVER w, min(t) OVER w) AS s, sum((NOT stopped)::INT) OVER w AS stop FROM x WINDOW w AS (PARTITION BY session ORDER BY t)),
d AS (SELECT *, row_number() OVER (PARTITION BY session, stop ORDER BY t) AS r FROM y WHERE outside AND stopped AND o >= {20 * HOUR} AND s >= {10 * HOUR}),
z AS (SELECT session, line_no, t, row_number() OVER (PARTITION BY session ORDER BY t) AS shows FROM d WHERE r = 1)
SELECT session, line_no, t, shows FROM z WHERE shows <= 3""")
def pack_offers(spark, sf):
    k = F.col("k")
    x = events(spark, sf).select("session", "line_no", "t", (k % 10 < 8).alias("outside"), (k % 10 < 7).alias("stopped"))
    return C.offers(x, ["session"], "t", 20 * HOUR, 10 * HOUR, 3).select("session", "line_no", "t", F.col("shows").cast("long").alias("shows"))


@query("merge_clocks", """
WITH u AS (SELECT t // 1000000000 AS s, 0 AS rank, line_no FROM @ev WHERE kind = 'view' UNION ALL SELECT t // 1000000000, 1, line_no FROM @ev WHERE kind = 'click' UNION ALL SELECT t // 1000000000, 2, line_no FROM @ev WHERE kind = 'error')
SELECT s // 86400 AS day, line_no, rank, row_number() OVER (PARTITION BY s // 86400 ORDER BY s, rank, line_no) AS place FROM u""")
def merge_clocks(spark, sf):
    e = events(spark, sf).withColumn("s", F.floor(F.col("t") / 1000000000))
    u = None
    for r, k in enumerate(("view", "click", "error")):
        x = e.where(F.col("kind") == k).select("s", F.lit(r).alias("rank"), "line_no")
        u = x if u is None else u.unionByName(x)
    day = F.floor(F.col("s") / 86400)
    return u.select(day.alias("day"), "line_no", "rank", F.row_number().over(Window.partitionBy(day).orderBy("s", "rank", "line_no")).cast("long").alias("place"))
