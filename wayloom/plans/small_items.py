"""Queries of hashes, shapes, names, lists and logs that are an expression or a window each."""

from __future__ import annotations

from math import log

from pyspark.sql import Window, functions as F

from ..functions import fnv as H, geo as G, rules as D, text as T
from ..operators import catalog as C, roads as R, sequence as S
from ..sources import csv_export as X, osm as O
from .base import events, fixes, query, table
from .evaluation import _files
from .offsets import _SIZE, _STREETS, _streets, _tracks

# the hash in SQL: a fold with 128-bit products
_FNV = "printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, strlen({h}) // 2), lambda i: ('0x' || substr({h}, CAST(2 * i + 1 AS INT), 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT) AS UBIGINT))"


@query("fnv1a64", f"SELECT line_no, {_FNV.format(h='hex(encode(props))')} AS hash FROM @ev ")
def fnv1a64(spark, sf):
    """The hash of each event's props, as 16 hex digits."""
    return events(spark, sf).select("line_no", H.fnv1a64(F.col("props")).alias("hash"))


@query("road_set_hashes", f"""
WITH h AS (SELECT p_brand, printf('%016x', p_partkey * 7919 * 1000003) AS h FROM part WHERE p_size % 5 = 0),
s AS (SELECT p_brand, string_agg(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '' ORDER BY h) AS b, count(*) AS n FROM (SELECT DISTINCT * FROM h) GROUP BY p_brand)
SELECT p_brand, n, {_FNV.format(h='b')} AS hash FROM s""")
def road_set_hashes(spark, sf):
    """One hash for the packs of a brand, whatever their order or repeats."""
    p = table(spark, sf, "part").where("p_size % 5 = 0").select("p_brand", F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 * 1000003), 16, "0")).alias("h"))
    g = p.unionByName(p).groupBy("p_brand").agg(F.collect_set("h").alias("h"))  # a brand's packs
    return g.select("p_brand", F.size("h").cast("long").alias("n"), H.set_hash(F.col("h")).alias("hash"))


@query("nearest_compatible", f"""
WITH {_STREETS}, p AS (SELECT pt.*, CASE WHEN f.course >= 0 THEN f.course END AS course FROM pt JOIN @fix f ON f.line_no = i),
d AS (SELECT i, way_id, course, degrees(atan2(bx - ax, by_ - ay)) AS brg, sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2)) AS dist FROM (SELECT p.*, st.*, least(1e0, greatest(0e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM p JOIN st ON px BETWEEN ax - 40 AND bx + 40 AND py BETWEEN ay - 40 AND by_ + 40)),
g AS (SELECT *, abs(course - brg) % 180 AS a FROM d WHERE dist <= 40)
SELECT i, arg_min(way_id, (round(dist, 3), way_id)) AS way_id, min(round(dist, 3)) AS distance FROM g WHERE course IS NULL OR least(a, 180 - a) <= 30 GROUP BY i""")
def nearest_compatible(spark, sf):
    """The nearest street within 40 m that keeps the course by 30 degrees, either way; of any direction for a fix without one."""
    course = fixes(spark, sf).select(F.col("line_no").alias("i"), F.when(F.col("course") >= 0, F.col("course")).alias("course"))
    index = R.grid_index(R.shapes(_streets(spark, sf)), _SIZE, 40.0)
    bearing = F.degrees(G.bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    gate = F.col("course").isNull() | (G.angle_difference("course", bearing, 180.0) <= 30)
    tracks = _tracks(spark, sf).drop("session").join(course, "i")
    return R.at_places(tracks, "i", lambda p: R.nearest_segment(p, index, "i", _SIZE, 40.0, gate)).select("i", "way_id", "distance")


@query("shapes", """
WITH b AS (SELECT line_no, k, value AS v FROM @ev ),
s AS (SELECT *, k * 2 - 90.5 AS px, v - 20 AS py, 10.0 AS bx, k % 3 * 5.0 AS by_, sqrt(100 + pow(k % 3 * 5.0, 2)) AS l FROM b),
u AS (SELECT *, bx / l AS ux, by_ / l AS uy FROM s), q AS (SELECT *, least(greatest(px * ux + py * uy, 0), l) AS al FROM u),
r AS (SELECT *, radians(k * 3.6) AS br, 10 * 2 * pi() / 36 AS a FROM q)
SELECT line_no, round(al * ux, 6) + 0.0 AS qx, round(sqrt(pow(px - al * ux, 2) + pow(py - al * uy, 2)), 6) AS distance, round(px * uy - py * ux, 6) + 0.0 AS across, 37 AS corners,
  round((v + 1) * cos(a) * sin(radians(k)) - (v + 1) * 0.5 * sin(a) * cos(radians(k)), 6) + 0.0 AS east, round((v + 1) * cos(a) * cos(radians(k)) + (v + 1) * 0.5 * sin(a) * sin(radians(k)), 6) + 0.0 AS north,
  round(50 + degrees(v * cos(br) / (6378137.0 * (1 - 0.0066943799901413165) / pow(1 - 0.0066943799901413165 * pow(sin(radians(50)), 2), 1.5))), 9) AS lat FROM r""")
def shapes(spark, sf):
    k, v = F.col("k"), F.col("value")
    n = G.nearest_on_segment(k * 2 - 90.5, v - 20, 0.0, 0.0, 10.0, k % 3 * 5.0)
    lat, _ = G.shifted(F.lit(50.0), F.lit(30.0), v, k * 3.6)
    e = events(spark, sf).select("line_no", n.alias("n"), G.ellipse_ring(v + 1, (v + 1) * 0.5, k).alias("r"), F.round(lat, 9).alias("lat"))
    p = lambda c: F.round(c, 6) + 0.0
    return e.select("line_no", p("n.qx").alias("qx"), F.round("n.distance", 6).alias("distance"), p("n.across").alias("across"), F.size("r").alias("corners"), p(F.col("r")[10]["east"]).alias("east"), p(F.col("r")[10]["north"]).alias("north"), "lat")


@query("download_names", """
WITH p AS (SELECT p_partkey, p_size % 6 AS d, 'p-' || p_partkey AS name, printf('%016x', p_partkey * 7919) AS hash FROM part),
f AS (SELECT *, CASE d WHEN 0 THEN '.download-' || name || '-' || hash || '.part' WHEN 1 THEN '.download-' || name || '-' || hash || '.json' WHEN 2 THEN name || '-' || hash || '.part' WHEN 3 THEN '.download-' || hash || '.part' WHEN 4 THEN '.download--' || name || '-' || hash || '.part' ELSE '.download-' || name || '-' || upper(hash) || 'G.part' END AS file FROM p)
SELECT p_partkey, file, CASE d WHEN 0 THEN 'partial' WHEN 1 THEN 'metadata' END AS kind, CASE WHEN d < 2 THEN name END AS name, CASE WHEN d < 2 THEN hash END AS hash FROM f""")
def download_names(spark, sf):
    d, key = F.col("p_size") % 6, F.col("p_partkey").cast("string")
    p = table(spark, sf, "part").select("p_partkey", d.alias("d"), F.concat(F.lit("p-"), key).alias("n"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919), 16, "0")).alias("h"))
    s = lambda *parts: F.concat(*(F.col(x) if x in ("n", "h") else F.lit(x) for x in parts))
    d = F.col("d")
    file = F.when(d == 0, s(".download-", "n", "-", "h", ".part")).when(d == 1, s(".download-", "n", "-", "h", ".json")).when(d == 2, s("n", "-", "h", ".part")).when(d == 3, s(".download-", "h", ".part")).when(d == 4, s(".download--", "n", "-", "h", ".part")).otherwise(F.concat(s(".download-", "n", "-"), F.upper("h"), F.lit("G.part")))
    p = p.withColumn("file", file).withColumn("x", T.download_parts(F.col("file")))
    return p.select("p_partkey", "file", "x.kind", "x.name", "x.hash")


@query("list_order", """
SELECT p_partkey, row_number() OVER (ORDER BY p_size % 9 <> 0, p_size % 4 <> 0, lower(p_type), p_partkey) AS place FROM part""")
def list_order(spark, sf):
    """A catalogue's order: national packs, installed ones, titles without regard to case, names."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 9 == 0, "national").otherwise("region").alias("kind"), (F.col("p_size") % 4 == 0).alias("installed"), F.col("p_type").alias("title"), F.col("p_partkey").alias("name"))
    return C.list_order(p).select("p_partkey", "place")


@query("launch_cleanup", """
SELECT file, name FROM (SELECT p_partkey AS file, p_brand AS name, p_partkey % 9 = 0 AS marked, row_number() OVER (PARTITION BY p_brand, p_partkey % 9 = 0 ORDER BY p_partkey * 31 % 97 DESC, p_size DESC, p_type DESC, p_partkey DESC) AS r FROM part) WHERE marked OR r > 1""")
def launch_cleanup(spark, sf):
    """The files that a launch deletes: marked and superseded ones."""
    return C.to_delete(_files(spark, sf)).select("file", "name")


@query("first_errors", """
SELECT session, t, line_no FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, line_no) AS r FROM @ev WHERE kind = 'error') WHERE r <= 10""")
def first_errors(spark, sf):
    """Ten errors of each recording: what a report shows."""
    r = F.row_number().over(Window.partitionBy("session").orderBy("t", "line_no"))
    return events(spark, sf).where("kind = 'error'").withColumn("r", r).where("r <= 10").select("session", "t", "line_no")


@query("replay_start", """
WITH p AS (SELECT session, arg_min(k, line_no) AS k FROM @ev WHERE kind = 'purchase' GROUP BY session),
c AS (SELECT session, min(t) + 100 * 3600000000000 AS cut FROM @ev GROUP BY session),
s AS (SELECT session, count(*) FILTER (greatest(t, t + k * 60000000000) >= cut) AS inputs, bool_or(greatest(t, t + k * 60000000000) < cut AND kind <> 'purchase') AS before FROM @ev JOIN c USING (session) GROUP BY session)
SELECT session, inputs, k AS prior, CASE WHEN k IS NULL THEN 'absent' WHEN session % 5 = 0 THEN 'overridden' WHEN session % 5 = 1 THEN 'ignored' WHEN k % 7 = 0 THEN 'invalid' WHEN before THEN 'cut' ELSE 'used' END AS source FROM s LEFT JOIN p USING (session)""")
def replay_start(spark, sf):
    """Inputs that arrive from the start on, the recording's first prior, and which prior a replay uses."""
    e = events(spark, sf).withColumn("arrival", F.greatest("t", F.col("t") + F.col("k") * 60_000_000_000))
    cut = F.min("t").over(Window.partitionBy("session")) + 100 * 3_600_000_000_000
    e = e.withColumn("late", F.col("arrival") >= cut)
    prior = F.min_by(F.when(F.col("kind") == "purchase", F.col("k")), F.when(F.col("kind") == "purchase", F.col("line_no")))
    g = e.groupBy("session").agg(F.count_if("late").alias("inputs"), prior.alias("prior"), F.max(~F.col("late") & (F.col("kind") != "purchase")).alias("before"))
    s, k = F.col("session"), F.col("prior")
    return g.select("session", "inputs", "prior", S.prior_source(k.isNotNull(), s % 5 == 0, s % 5 == 1, k % 7 != 0, F.col("before")).alias("source"))


@query("step_timing", """
WITH s AS (SELECT session, list(value ORDER BY t, line_no) AS v FROM @ev GROUP BY session)
SELECT session, round(list_reduce(v, lambda m, x: m + 0.1 * (x - m)), 6) AS mean, list_max(v) AS most FROM s""")
def step_timing(spark, sf):
    """A mean that moves a tenth of the way with each step, and the longest step."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("t", "line_no")).cast("long")
    e = events(spark, sf).withColumn("place", place)
    m = S.smoothed(e, ["session"], "place", "line_no", "value", -1 / log(0.9))
    last = m.groupBy("session").agg(F.round(F.max_by("mean", "place"), 6).alias("mean"))
    return last.join(e.groupBy("session").agg(F.max("value").alias("most")), "session")


@query("way_lookup", """
WITH w AS (SELECT o_orderkey AS way_id, o_orderpriority AS class, o_orderstatus AS tag FROM orders)
SELECT l_orderkey, l_linenumber, class, tag FROM lineitem LEFT JOIN w ON w.way_id = l_orderkey AND l_linenumber < 3""")
def way_lookup(spark, sf):
    """Class and tag of the way that an edge belongs to; edges of unknown ways stay."""
    ways = table(spark, sf, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("tag"))
    edges = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 3, F.col("l_orderkey")).alias("way_id"))
    return R.with_ways(edges, ways).select("l_orderkey", "l_linenumber", "class", "tag")


@query("download_decisions", """
WITH b AS (SELECT line_no, k, (ARRAY[200, 206, 416, 404, 503, 401, 302])[CAST(k % 7 + 1 AS INT)] AS st, CASE WHEN k % 5 > 0 THEN k * 10 END AS off FROM @ev )
SELECT line_no, CASE st WHEN 200 THEN CASE WHEN k % 4 = 0 THEN 'fail' ELSE 'writeFromZero' END WHEN 206 THEN CASE WHEN off IS NULL THEN 'fail' WHEN k % 3 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN 'restart' ELSE 'append' END WHEN 416 THEN CASE WHEN off IS NULL THEN 'fail' ELSE 'restart' END ELSE 'fail' END AS action,
  CASE st WHEN 200 THEN CASE WHEN k % 4 = 0 THEN 'length' ELSE '' END WHEN 206 THEN CASE WHEN off IS NULL THEN 'norange' WHEN k % 3 = 0 THEN 'noheader' WHEN k % 11 = 0 THEN 'start' WHEN k % 13 = 0 THEN 'size' WHEN k % 17 = 0 THEN 'etag' ELSE '' END WHEN 416 THEN CASE WHEN off IS NULL THEN 'norange' ELSE 'unservable' END
    WHEN 404 THEN 'gone' WHEN 503 THEN 'server' WHEN 401 THEN 'client' ELSE 'unexpected' END AS why FROM b""")
def download_decisions(spark, sf):
    k = F.col("k")
    status = F.element_at(F.array(*map(F.lit, (200, 206, 416, 404, 503, 401, 302))), (k % 7 + 1).cast("int"))
    got = F.when(k % 3 != 0, F.concat(F.lit("bytes "), (k * 10 + F.when(k % 11 == 0, 1).otherwise(0)).cast("string"), F.lit("-4999/"), F.when(k % 13 == 0, "*").otherwise("5000")))
    d = D.response_decision(status, F.when(k % 5 > 0, k * 10), got, F.when(k % 17 == 0, 'W/"b"').otherwise('W/"a"'), F.lit('"a"'), F.lit(5000), F.when(k % 4 == 0, 1).otherwise(5000))
    return events(spark, sf).select("line_no", d.alias("d")).select("line_no", "d.action", "d.why")


@query("opl_problems", """
WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS n, l_partkey AS p, l_orderkey % 12 AS d FROM lineitem)
SELECT n, CASE d WHEN 1 THEN 'bad way id' WHEN 2 THEN 'way ' || p || ' has no node list' WHEN 3 THEN 'tag without ''=''' WHEN 4 THEN 'bad % escape' WHEN 5 THEN 'bad node reference' WHEN 6 THEN 'bad node id' WHEN 7 THEN 'node ' || p || ': x without y' WHEN 8 THEN 'node ' || p || ': bad location' WHEN 9 THEN 'bad % escape' END AS message FROM b WHERE d BETWEEN 1 AND 9""")
def opl_problems(spark, sf):
    """A way line for each row, with one of nine faults or none; node lines and unlocated nodes are fine."""
    p, d = F.col("l_partkey").cast("string"), F.col("l_orderkey") % 12
    s = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    good = s("w", p, " v1 Ta=%20%b,c=d Nn", p, "x30.1234567y50,n2xy,n3")
    line = (
        F.when(d == 1, s("w", p, "x v1 Nn1")).when(d == 2, s("w", p, " v1 Ta=b")).when(d == 3, s("w", p, " Tab,c=d Nn1")).when(d == 4, s("w", p, " Ta=%2 Nn1")).when(d == 5, s("w", p, " Nn1,m2")).when(d == 6, s("w", p, " Nn1,nax1y2"))
        .when(d == 7, s("w", p, " Nn", p, "x1")).when(d == 8, s("w", p, " Nn", p, "x1.12345678y2")).when(d == 9, s("w", p, " Ta=%d800% Nn1")).when(d == 10, s("n", p, " x1")).otherwise(good)
    )
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), line.alias("value"))
    return O.opl_problems(rows, "n")


@query("csv_lines", r'''
WITH b AS (SELECT line_no, t, k, kind AS k0, (ARRAY['motion', 'obd', 'marker', 'stats', 'gpsSwitch', 'odd kind!'])[CAST(k % 6 + 1 AS INT)] AS kind FROM @ev )
SELECT line_no, CASE WHEN k % 6 = 5 THEN 'odd_kind_' ELSE kind END || '.csv' AS file, t || ',' || CASE k % 6 WHEN 0 THEN k || ',1.5,,,,,,,,,,,0.5,,,,7' WHEN 1 THEN '13,' || k || ',km/h,"41 0D, ""x""",,,7E8,' WHEN 2 THEN '"a' || k || ',b"'
  WHEN 3 THEN '10.0,,,,,,,' || k || ',,2,,,,"{""' || k0 || '"":1}"' WHEN 4 THEN CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END || ',' ELSE '"{""x"":[' || k || ',null]}"' END AS line FROM b''')
def csv_lines(spark, sf):
    k, n = F.col("k"), F.col("k").cast("string")
    s = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    data = (
        F.when(k % 6 == 0, s('{"userAcceleration":{"x":', n, ',"y":1.5},"attitude":{"w":0.5},"magneticAccuracy":7}')).when(k % 6 == 1, s('{"pid":13,"value":', n, r',"unit":"km/h","raw":"41 0D, \"x\"","ecu":"7E8"}'))
        .when(k % 6 == 2, s('"a', n, ',b"')).when(k % 6 == 3, s('{"windowS":10.0,"gaps":{"motion":', n, ',"gyro":2},"counts":{"', F.col("kind"), '":1}}')).when(k % 6 == 4, s('{"on":', F.when(k % 4 == 0, "true").otherwise("false"), "}")).otherwise(s('{"x":[', n, ",null]}"))
    )
    kind = F.element_at(F.array(*map(F.lit, ("motion", "obd", "marker", "stats", "gpsSwitch", "odd kind!"))), (k % 6 + 1).cast("int"))
    e = events(spark, sf).withColumn("data", data).withColumn("kind", kind)
    name = F.concat(F.coalesce(F.nullif(T.file_name(F.col("kind")), F.lit("")), F.lit("_")), F.lit(".csv"))
    return e.select("line_no", name.alias("file"), X.line(F.col("t"), F.col("kind"), F.col("data")).alias("line"))
