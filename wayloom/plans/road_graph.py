"""Queries of the road graph, over whole tables: ways are orders and a node is a part from a supplier, placed beside its
part on a lattice, so some ways share nodes and are split, as roads are."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import roads as R
from .base import fixes, nodes, query, table

_SIZE, _RADIUS = 400.0, 150.0
_K_LAT, _K_LON = 0.0111, 0.0071

# one row per way and position
_WN = """
w0 AS (SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_partkey, l_suppkey FROM lineitem),
w1 AS (SELECT way_id, pos, l_partkey * 10000000 + l_suppkey AS node_id, n.lat_e7 + l_suppkey % 30 * 290 AS lat_e7, n.lon_e7 + l_suppkey // 30 * 410 AS lon_e7 FROM w0 JOIN @node n ON l_partkey = n.node_id),
w2 AS (SELECT * FROM (SELECT *, lag(node_id) OVER w AS pn, lag(lat_e7) OVER w AS pa, lag(lon_e7) OVER w AS po FROM w1 WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE NOT coalesce(pn = node_id OR (pa = lat_e7 AND po = lon_e7), false)),
wn AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS pos, node_id, lat_e7, lon_e7 FROM w2)"""


def _raw(spark, sf):
    w = Window.partitionBy("way_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").withColumn("way_id", F.col("l_orderkey"))
    wn = li.select("way_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "l_partkey", "l_suppkey")
    k = F.col("l_suppkey")
    place = ((F.col("l_partkey") * 10000000 + k).alias("node_id"), (F.col("lat_e7") + k % 30 * 290).alias("lat_e7"), (F.col("lon_e7") + F.floor(k / 30) * 410).alias("lon_e7"))
    return wn.join(nodes(spark, sf).withColumnRenamed("node_id", "l_partkey"), "l_partkey").select("way_id", "pos", *place)


def _nodes(spark, sf):
    return R.without_repeats(_raw(spark, sf))


@query("way_nodes_without_repeats", f"WITH {_WN} SELECT * FROM wn")
def way_nodes_without_repeats(spark, sf):
    return _nodes(spark, sf).select("way_id", "pos", "node_id", "lat_e7", "lon_e7")


@query("way_filter", """
WITH o AS (SELECT o_orderkey, (ARRAY['motorway', 'primary', 'footway', 'service'])[CAST(o_orderkey % 4 + 1 AS INT)] AS hw, o_orderkey % 7 = 0 AS area, o_orderkey % 5 = 0 AS aisle, coalesce(n, 0) AS located FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_partkey % 3 > 0) AS n FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)),
r AS (SELECT *, CASE WHEN hw = 'footway' THEN 'class' WHEN area THEN 'area' WHEN aisle THEN 'aisle' WHEN located < 2 THEN 'degenerate' END AS reason FROM o)
SELECT hw AS highway, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def way_filter(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k, F.element_at(F.array(*map(F.lit, ("motorway", "primary", "footway", "service"))), (k % 4 + 1).cast("int")).alias("highway"), F.when(k % 7 == 0, "yes").alias("area"), F.when(k % 5 == 0, "parking_aisle").alias("service"))
    located = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_partkey") % 3 > 0).alias("located"))
    r = R.way_decisions(o.join(located, "o_orderkey", "left"), ["motorway", "primary", "service"], F.coalesce("located", F.lit(0)))
    return r.groupBy("highway", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_EDGES = _WN + """,
u AS (SELECT node_id, count(*) AS uses FROM wn GROUP BY node_id),
c AS (SELECT wn.*, uses > 1 AND pos > 0 AND lead(wn.node_id) OVER w IS NOT NULL AS cut, lag(lat_e7) OVER w AS plat, lag(lon_e7) OVER w AS plon FROM wn JOIN u USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
p AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece, (lat_e7 + plat) / 2e7 AS mid,
  (lat_e7 - plat) * 1.0 AS da, (lon_e7 - plon) * 1.0 AS dl FROM c),
m AS (SELECT *, sqrt(pow(dl * 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(mid)), 2)) * cos(radians(mid)) * pi() / 180 / 1e7, 2) + pow(da * 6378137.0 * (1 - 6.69437999014e-3) / pow(1 - 6.69437999014e-3 * pow(sin(radians(mid)), 2), 1.5) * pi() / 180 / 1e7, 2)) AS step FROM p),
b AS (SELECT way_id, pos, node_id, step, piece FROM m UNION ALL SELECT way_id, pos, node_id, step, piece + 1 FROM m WHERE cut),
i AS (SELECT *, CASE WHEN pos > min(pos) OVER (PARTITION BY way_id, piece) THEN step END AS inner_ FROM b),
edges AS (SELECT way_id, min(pos) AS offset_, arg_min(node_id, pos) AS from_node, arg_max(node_id, pos) AS to_node, count(*) AS points, CAST(round(10 * coalesce(sum(inner_), 0)) AS BIGINT) AS length_dm FROM i GROUP BY way_id, piece HAVING count(*) > 1)"""


def _edges(spark, sf):
    return R.split_edges(_nodes(spark, sf))


@query("split_edges", f"WITH {_EDGES} SELECT way_id, offset_, from_node, to_node, points, length_dm FROM edges")
def split_edges(spark, sf):
    return _edges(spark, sf).select("way_id", F.col("offset").alias("offset_"), "from_node", "to_node", "points", "length_dm")


@query("node_numbering", f"""
WITH {_EDGES}, e AS (SELECT way_id, offset_, 0 AS k, from_node AS node_id FROM edges UNION ALL SELECT way_id, offset_, 1, to_node FROM edges),
f AS (SELECT node_id, min((way_id, offset_, k)) AS at_ FROM e GROUP BY node_id)
SELECT node_id, row_number() OVER (ORDER BY at_) - 1 AS number FROM f""")
def node_numbering(spark, sf):
    return R.numbered_nodes(_edges(spark, sf))


@query("adjacency", f"""
WITH {_EDGES}, x AS (SELECT way_id * 100 + offset_ AS edge_id, unnest(list_distinct([from_node, to_node])) AS node_id FROM edges)
SELECT node_id, count(*) AS degree, string_agg(edge_id, ',' ORDER BY edge_id) AS edges FROM x GROUP BY node_id""")
def adjacency(spark, sf):
    e = _edges(spark, sf).withColumn("edge_id", F.col("way_id") * 100 + F.col("offset"))
    return R.adjacency(e).select("node_id", F.size("edges").cast("long").alias("degree"), F.concat_ws(",", F.col("edges").cast("array<string>")).alias("edges"))


@query("graph_statistics", f"""
WITH {_EDGES}
SELECT count(*) AS edges, count(DISTINCT way_id) AS ways, CAST(sum(points) AS BIGINT) AS points, count(*) FILTER (from_node = to_node) AS loops, max(points) AS longest, (SELECT count(*) FROM u WHERE uses > 1) AS shared,
  (SELECT min(lat_e7) FROM wn) AS south, (SELECT max(lon_e7) FROM wn) AS east FROM edges""")
def graph_statistics(spark, sf):
    n = _nodes(spark, sf)
    e = R.split_edges(n).agg(F.count("*").alias("edges"), F.count_distinct("way_id").alias("ways"), F.sum("points").alias("points"), F.count_if(F.col("from_node") == F.col("to_node")).alias("loops"), F.max("points").alias("longest"))
    shared = R.node_uses(n).agg(F.count_if(F.col("uses") > 1).alias("shared"))
    box = n.agg(F.min("lat_e7").alias("south"), F.max("lon_e7").alias("east"))
    return e.join(F.broadcast(shared)).join(F.broadcast(box))  # one row each


@query("within_two_hops", f"""
WITH {_EDGES}, x AS (SELECT way_id * 100 + offset_ AS edge_id, unnest(list_distinct([from_node, to_node])) AS node_id FROM edges),
near AS (SELECT DISTINCT a.edge_id, b.edge_id AS other FROM x a JOIN x b USING (node_id) WHERE a.edge_id <> b.edge_id),
h0 AS (SELECT edge_id AS start, edge_id AS edge, 0 AS hops FROM (SELECT DISTINCT edge_id FROM x)),
h1 AS (SELECT start, other AS edge, 1 AS hops FROM h0 JOIN near ON h0.edge = near.edge_id),
h2 AS (SELECT start, other AS edge, 2 AS hops FROM h1 JOIN near ON h1.edge = near.edge_id)
SELECT start, edge, CAST(min(hops) AS INT) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY start, edge""")
def within_two_hops(spark, sf):
    e = _edges(spark, sf).withColumn("edge_id", F.col("way_id") * 100 + F.col("offset"))
    return R.within_hops(e, e, 2)


@query("polylines", f"""
WITH {_EDGES}, r AS (SELECT *, coalesce(lag(offset_ + points - 1) OVER (PARTITION BY way_id ORDER BY offset_) <> offset_, true)::INT AS starts FROM edges WHERE length_dm > 10000),
g AS (SELECT *, sum(starts) OVER (PARTITION BY way_id ORDER BY offset_) AS line FROM r),
l AS (SELECT way_id, line, min(offset_) AS a, max(offset_ + points - 1) AS z, count(*) AS n FROM g GROUP BY way_id, line)
SELECT l.way_id, a AS offset_, n AS edges, string_agg(node_id, ',' ORDER BY pos) AS nodes FROM l JOIN wn ON wn.way_id = l.way_id AND pos BETWEEN a AND z GROUP BY l.way_id, a, n""")
def polylines(spark, sf):
    lines = R.polylines(_edges(spark, sf), _nodes(spark, sf), F.col("length_dm") > 10000)
    return lines.select("way_id", F.col("offset").alias("offset_"), "edges", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))


@query("merged_nodes", """
WITH RECURSIVE s AS (SELECT o_orderkey // 8 AS way_id, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_custkey, o_orderkey) AS pos, o_orderkey // 3 AS node_id, o_orderkey // 12 AS spot FROM orders),
p AS (SELECT DISTINCT node_id AS a, lag(node_id) OVER w AS b, lag(spot) OVER w = spot AS same FROM s WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
l AS (SELECT a, b FROM p WHERE same AND a <> b UNION SELECT b, a FROM p WHERE same AND a <> b),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS node_id, least(a, min(b)) AS merged FROM r GROUP BY a""")
def merged_nodes(spark, sf):
    """Neighbours of a way often lie at one spot, and ways share nodes, so groups go over several ways."""
    w = Window.partitionBy("way_id").orderBy("o_custkey", "o_orderkey")
    part = lambda n: F.floor(F.col("o_orderkey") / n)
    o = table(spark, sf, "orders").withColumn("way_id", part(8))
    s = o.select("way_id", F.row_number().over(w).alias("pos"), part(3).alias("node_id"), part(12).alias("lat_e7"), part(12).alias("lon_e7"))
    return R.merged_nodes(s)


_SEG = _WN + f""",
seg AS (SELECT * FROM (SELECT way_id, pos AS seg, (lon_e7 - 300000000) * {_K_LON} AS ax, (lat_e7 - 500000000) * {_K_LAT} AS ay, (lead(lon_e7) OVER w - 300000000) * {_K_LON} AS bx, (lead(lat_e7) OVER w - 500000000) * {_K_LAT} AS by_ FROM wn WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE bx IS NOT NULL),
pt AS (SELECT line_no, ((lon - 30.0) * 1e7) * {_K_LON} * 4 AS px, ((lat - 50.0) * 1e7) * {_K_LAT} * 2 AS py, course FROM @fix ),
t AS (SELECT line_no, px, py, course, way_id, seg, ax, ay, bx, by_, least(1.0, greatest(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM pt JOIN seg ON px BETWEEN least(ax, bx) - {_RADIUS} AND greatest(ax, bx) + {_RADIUS} AND py BETWEEN least(ay, by_) - {_RADIUS} AND greatest(ay, by_) + {_RADIUS}),
d AS (SELECT *, sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2)) AS distance FROM t)"""


def _segs(spark, sf):
    return R.segments(_nodes(spark, sf), 500000000, 300000000, _K_LAT, _K_LON)


def _points(spark, sf):
    f = fixes(spark, sf)
    return f.select("line_no", (((F.col("lon") - 30.0) * 1e7) * _K_LON * 4).alias("px"), (((F.col("lat") - 50.0) * 1e7) * _K_LAT * 2).alias("py"), "course")


def _at_places(spark, sf, find):
    """``find`` of points and an index, once for each place."""
    return R.at_places(_points(spark, sf).drop("course"), "line_no", lambda p: find(p, R.grid_index(_segs(spark, sf), _SIZE, _RADIUS, p)))


@query("nearest_segment", f"""
WITH {_SEG}, k AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY round(distance, 3), way_id, seg) AS n FROM d WHERE distance <= {_RADIUS})
SELECT line_no, way_id, seg, round(distance, 3) AS distance FROM k WHERE n = 1""")
def nearest_segment(spark, sf):
    return _at_places(spark, sf, lambda p, index: R.nearest_segment(p, index, "line_no", _SIZE, _RADIUS))


@query("candidates_in_radius", f"""
WITH {_SEG} SELECT line_no, count(*) AS n, round(min(distance), 4) AS near FROM d WHERE distance <= 100 GROUP BY line_no""")
def candidates_in_radius(spark, sf):
    counted = lambda c: c.groupBy("line_no").agg(F.count("*").alias("n"), F.round(F.min("distance"), 4).alias("near"))
    return _at_places(spark, sf, lambda p, index: counted(R.candidates(p, index, _SIZE, 100.0)))


@query("road_semi_join", f"WITH {_SEG} SELECT DISTINCT line_no FROM d WHERE distance <= 60")
def road_semi_join(spark, sf):
    return _at_places(spark, sf, lambda p, index: R.near_any(p, index, _SIZE, 60.0).select("line_no"))


@query("truth_match", f"""
WITH {_SEG}, l AS (SELECT line_no, way_id, seg, round(-0.5 * pow(distance / 20.0, 2), 6) AS log_l FROM d WHERE distance <= {_RADIUS}),
b AS (SELECT *, first_value(way_id) OVER (PARTITION BY line_no ORDER BY log_l DESC, way_id, seg) AS way FROM l),
m AS (SELECT line_no, any_value(way) AS way_id, max(log_l) + 0.0 AS best, max(log_l) FILTER (way_id <> way) + 0.0 AS other FROM b GROUP BY line_no)
SELECT *, CASE WHEN other IS NULL OR best - other >= ln(2.0) THEN 'matched' ELSE 'ambiguous' END AS verdict FROM m""")
def truth_match(spark, sf):
    log_l = F.round(-0.5 * F.pow(F.col("distance") / 20.0, 2), 6) + 0.0
    match = lambda p, index: R.truth_match(R.candidates(p, index, _SIZE, _RADIUS).withColumn("log_l", log_l), "line_no")
    return _at_places(spark, sf, match).select("line_no", "way_id", "best", "other", "verdict")


@query("shadowed_segments", """
SELECT l_orderkey, l_linenumber, arg_min(l_suppkey, (l_suppkey % 7, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def shadowed_segments(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return R.one_per_key(li, ["l_orderkey", "l_linenumber"], [F.col("l_suppkey") % 7, F.col("l_suppkey")])


@query("points_in_polygons", """
WITH ring0(area, ring, i, x, y) AS (VALUES ('a', 0, 0, 0.0, 0.0), ('a', 0, 1, 500.0, 50.0), ('a', 0, 2, 420.0, 600.0), ('a', 0, 3, 30.0, 480.0), ('a', 1, 0, 100.0, 100.0), ('a', 1, 1, 250.0, 120.0), ('a', 1, 2, 180.0, 300.0),
  ('b', 0, 0, 300.0, 20.0), ('b', 0, 1, 900.0, 40.0), ('b', 0, 2, 650.0, 700.0)),
ring AS (SELECT area, ring, i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ring0),
e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ring WINDOW w AS (PARTITION BY area, ring ORDER BY i)),
bx AS (SELECT area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ring GROUP BY area),
p AS (SELECT line_no, CAST(k AS DOUBLE) * 83e-1 AS px, value * 2 AS py FROM @ev )
SELECT line_no, area, count(*) FILTER (((y > py) <> (y2 > py)) AND px < (x2 - x) * (py - y) / (y2 - y) + x) % 2 = 1 AS inside FROM p JOIN bx ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 JOIN e USING (area) GROUP BY line_no, area""")
def points_in_polygons(spark, sf):
    from .base import events

    rows = [("a", 0, 0, 0.0, 0.0), ("a", 0, 1, 500.0, 50.0), ("a", 0, 2, 420.0, 600.0), ("a", 0, 3, 30.0, 480.0), ("a", 1, 0, 100.0, 100.0), ("a", 1, 1, 250.0, 120.0), ("a", 1, 2, 180.0, 300.0), ("b", 0, 0, 300.0, 20.0), ("b", 0, 1, 900.0, 40.0), ("b", 0, 2, 650.0, 700.0)]
    rings = spark.createDataFrame(rows, "area string, ring int, i int, x double, y double")
    p = events(spark, sf).select("line_no", (F.col("k") * 8.3).alias("px"), (F.col("value") * 2).alias("py"))
    return R.in_polygons(p, rings, "line_no", 100.0)
