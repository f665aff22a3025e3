"""Queries of graph rules and packs: an edge is an order, eight edges are a way, and each rule is broken by some edges."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import road_rules as V
from ..operators.lineage import cut
from .base import query, table

# the graph in SQL: edge e has points 4 e to 4 e + 3; planted faults are by the remainder of e modulo 701
_GRAPH = """
o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS e FROM orders),
edges AS (SELECT e AS edge, CASE WHEN e % 701 = 9 THEN e // 8 - 1 ELSE e // 8 END AS way_id, CASE e % 701 WHEN 5 THEN 4294967295 ELSE e % 8 * 3 END AS offset_, e // 8 * 9 + e % 8 AS from_node, CASE WHEN e % 701 = 17 THEN -1 ELSE e // 8 * 9 + e % 8 + 1 END AS to_node,
  CASE WHEN e % 701 = 21 THEN 4 * e + 1 ELSE 4 * e END AS first_point, 4 AS points, CASE WHEN e % 701 = 3 THEN 99 ELSE e % 15 + 1 END AS class, CASE WHEN e % 701 = 11 THEN 7 ELSE e % 5 - 2 END AS level, CASE WHEN e % 701 = 13 THEN 64 ELSE e % 64 END AS flags FROM o),
points AS (SELECT 4 * e + j AS point, CASE WHEN e % 701 = 25 AND j = 1 THEN e + 1 ELSE e END AS edge, CASE WHEN e % 701 = 29 AND j = 2 THEN 1 ELSE j END * 100 + (e // 8 * 9 + e % 8) * 300 AS lat_e7, e // 8 * 7 + CASE WHEN e % 701 = 33 AND j = 3 THEN 1 ELSE 0 END AS lon_e7 FROM o, range(4) t(j)),
nodes AS (SELECT DISTINCT n AS node, n * 300 AS lat_e7, e // 8 * 7 AS lon_e7 FROM (SELECT e, unnest([e // 8 * 9 + e % 8, e // 8 * 9 + e % 8 + 1]) AS n FROM o)),
i0 AS (SELECT e, k, e // 8 * 9 + e % 8 + k AS node FROM o, range(2) t(k) WHERE NOT (e % 701 = 41 AND k = 1) AND NOT (e % 701 = 17 AND k = 1)),
adj AS (SELECT node, CASE WHEN e % 701 = 45 AND k = 0 THEN -e ELSE e END AS place, CASE WHEN e % 701 = 37 AND k = 0 THEN e + 3 ELSE e END AS edge FROM i0),
cells AS (SELECT (4 * e + j) // 10 AS cell, CASE WHEN e % 701 = 49 THEN -j ELSE 4 * e + j END AS place, CASE WHEN e % 701 = 53 AND j = 0 THEN 4 * e + 3 ELSE 4 * e + j END AS point FROM o, range(3) t(j))"""


def _graph(spark, sf):
    n = table(spark, sf, "orders").select(F.col("o_orderkey"))
    # orders are numbered by range: ranks within a block, blocks added up
    block = F.floor(F.col("o_orderkey") / 4096)
    sizes = n.groupBy(block.alias("block")).agg(F.count("*").alias("c"))
    base = sizes.select("block", (F.sum("c").over(Window.orderBy("block")) - F.col("c")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("o_orderkey")) - 1
    o = cut(n.withColumn("block", block).withColumn("rank", rank).join(base, "block").select((F.col("base") + F.col("rank")).alias("e")))  # numbered once for all tables and rules
    e, m = F.col("e"), F.col("e") % 701
    way = F.floor(e / 8)
    node = way * 9 + e % 8
    edges = o.select(
        e.alias("edge"), F.when(m == 9, way - 1).otherwise(way).alias("way_id"), F.when(m == 5, 4294967295).otherwise(e % 8 * 3).alias("offset"), node.alias("from_node"), F.when(m == 17, -1).otherwise(node + 1).alias("to_node"),
        F.when(m == 21, 4 * e + 1).otherwise(4 * e).alias("first_point"), F.lit(4).alias("points"), F.when(m == 3, 99).otherwise(e % 15 + 1).alias("class"), F.when(m == 11, 7).otherwise(e % 5 - 2).alias("level"), F.when(m == 13, 64).otherwise(e % 64).alias("flags"))
    each = lambda n_: o.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_ - 1))))
    j = F.col("j")
    points = each(4).select((4 * e + j).alias("point"), F.when((m == 25) & (j == 1), e + 1).otherwise(e).alias("edge"), (F.when((m == 29) & (j == 2), 1).otherwise(j) * 100 + node * 300).alias("lat_e7"), (way * 7 + F.when((m == 33) & (j == 3), 1).otherwise(0)).alias("lon_e7"))
    nodes = each(2).select((node + j).alias("node"), ((node + j) * 300).alias("lat_e7"), (way * 7).alias("lon_e7")).distinct()
    listed = each(2).where(~((m == 41) & (j == 1)) & ~((m == 17) & (j == 1)))
    adjacency = listed.select((node + j).alias("node"), F.when((m == 45) & (j == 0), -e).otherwise(e).alias("place"), F.when((m == 37) & (j == 0), e + 3).otherwise(e).alias("edge"))
    cells = each(3).select(F.floor((4 * e + j) / 10).alias("cell"), F.when(m == 49, -j).otherwise(4 * e + j).alias("place"), F.when((m == 53) & (j == 0), 4 * e + 3).otherwise(4 * e + j).alias("point"))
    return nodes, edges, points, adjacency, cells


@query("graph_violations", f"""
WITH {_GRAPH},
inc AS (SELECT DISTINCT edge, unnest([from_node, to_node]) AS node FROM edges),
span AS (SELECT edge AS of_, unnest(range(first_point, first_point + points)) AS point FROM edges),
own AS (SELECT point, min(of_) AS of_, count(*) AS n FROM span GROUP BY point),
ends AS (SELECT edge, from_node AS node, first_point AS point FROM edges UNION ALL SELECT edge, to_node, first_point + points - 1 FROM edges)
SELECT 'class' AS rule, edge AS "at" FROM edges WHERE class NOT BETWEEN 1 AND 15
UNION ALL SELECT 'flags', edge FROM edges WHERE flags >= 64 UNION ALL SELECT 'level', edge FROM edges WHERE level NOT BETWEEN -5 AND 5 UNION ALL SELECT 'offset', edge FROM edges WHERE offset_ + points > 4294967295
UNION ALL SELECT 'order', edge FROM (SELECT edge, way_id, offset_, lag(way_id) OVER (ORDER BY edge) AS w, lag(offset_) OVER (ORDER BY edge) AS f FROM edges) WHERE w > way_id OR w = way_id AND f >= offset_
UNION ALL SELECT 'contiguous', edge FROM (SELECT edge, first_point, coalesce(lag(first_point + points) OVER (ORDER BY edge), 0) AS next FROM edges) WHERE first_point <> next
UNION ALL SELECT DISTINCT 'node', edge FROM ends ANTI JOIN nodes USING (node)
UNION ALL SELECT DISTINCT 'ends', ends.edge FROM ends JOIN nodes USING (node) LEFT JOIN points p ON p.point = ends.point WHERE p.point IS NULL OR p.lat_e7 <> nodes.lat_e7 OR p.lon_e7 <> nodes.lon_e7
UNION ALL SELECT 'point_edge', p.point FROM points p LEFT JOIN own USING (point) WHERE of_ IS NULL OR of_ <> p.edge OR n <> 1
UNION ALL SELECT 'zero_length', point FROM (SELECT point, lat_e7, lon_e7, lead(lat_e7) OVER w AS a, lead(lon_e7) OVER w AS b FROM points WINDOW w AS (PARTITION BY edge ORDER BY point)) WHERE a = lat_e7 AND b = lon_e7
UNION ALL SELECT DISTINCT 'incident', node FROM adj ANTI JOIN inc ON adj.edge = inc.edge AND adj.node = inc.node
UNION ALL SELECT DISTINCT 'adjacency_order', node FROM (SELECT node, edge, lag(edge) OVER (PARTITION BY node ORDER BY place) AS p FROM adj) WHERE edge <= p
UNION ALL SELECT DISTINCT 'both_ends', edge FROM inc ANTI JOIN adj ON adj.edge = inc.edge AND adj.node = inc.node
UNION ALL SELECT DISTINCT 'cell_order', cell FROM (SELECT cell, point, lag(point) OVER (PARTITION BY cell ORDER BY place) AS p FROM cells) WHERE point <= p
UNION ALL SELECT DISTINCT 'segment_start', cell FROM cells WHERE NOT EXISTS (SELECT 1 FROM points a JOIN points b ON b.point = a.point + 1 AND a.edge = b.edge WHERE a.point = cells.point)""")
def graph_violations(spark, sf):
    return V.violations(*_graph(spark, sf))


@query("refused_packs", """
WITH p AS (SELECT 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS pack, CASE WHEN s_suppkey % 19 = 7 THEN 'other' ELSE 'roads' END AS family, s_suppkey % 17 = 5 AS odd, s_suppkey % 40 AS hash FROM supplier),
f AS (SELECT * FROM p ORDER BY pack LIMIT 1)
SELECT pack, reason FROM (SELECT p.pack, CASE WHEN p.family <> f.family THEN 'family' WHEN p.odd <> f.odd THEN 'grid' WHEN row_number() OVER (PARTITION BY p.hash ORDER BY p.pack) > 1 THEN 'duplicate' END AS reason FROM p, f) WHERE reason IS NOT NULL""")
def refused_packs(spark, sf):
    k = F.col("s_suppkey")
    packs = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.lpad(k.cast("string"), 6, "0")).alias("pack"), F.when(k % 19 == 7, "other").otherwise("roads").alias("family"), F.when(k % 17 == 5, "b").otherwise("a").alias("grid_id"), (k % 40).alias("content_hash"))
    return V.refused_packs(packs)


@query("adjacent_edges", """
WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS e FROM orders),
x AS (SELECT e, p, e // 8 AS way, e % 8 AS r FROM o, range(2) t(p) WHERE p = 0 AND e % 8 < 6 OR p = 1 AND e % 8 >= 3),
edges AS (SELECT p AS pack, e AS edge, way AS way_id, r * 3 + p AS offset_, way * 9 + r AS from_node, way * 9 + r + 1 AS to_node, 4 - p AS points FROM x),
points AS (SELECT pack, edge, i, (way_id * 24 + offset_ + i) * 100 AS lat_e7, CASE WHEN way_id % 4 = 0 THEN 0 ELSE pack * 5 END AS lon_e7 FROM edges, range(4) t(i) WHERE i < points),
ends AS (SELECT p.*, i = 0 OR i = e.points - 1 AS is_end FROM points p JOIN edges e USING (pack, edge)),
c AS (SELECT a.pack, a.edge, b.pack AS other_pack, b.edge AS other FROM edges a JOIN edges b ON a.pack = b.pack AND a.edge <> b.edge AND (a.from_node IN (b.from_node, b.to_node) OR a.to_node IN (b.from_node, b.to_node)) AND abs(a.edge - b.edge) < 8
  UNION SELECT a.pack, a.edge, b.pack, b.edge FROM edges a JOIN edges b ON a.way_id = b.way_id AND a.pack <> b.pack AND a.offset_ <= b.offset_ + b.points - 1 AND b.offset_ <= a.offset_ + a.points - 1
  UNION SELECT a.pack, a.edge, b.pack, b.edge FROM ends a JOIN ends b ON a.lat_e7 = b.lat_e7 AND a.lon_e7 = b.lon_e7 AND a.pack <> b.pack AND (a.is_end OR b.is_end))
SELECT * FROM c""")
def adjacent_edges(spark, sf):
    """Two packs with overlapping ways; the second one's edges begin a point later, and every fourth way lies at the same place in both."""
    e = _graph(spark, sf)[1].select(F.col("edge").alias("e"))
    e = e.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"way": F.floor(F.col("e") / 8), "r": F.col("e") % 8})
    e = e.where("(p = 0 and r < 6) or (p = 1 and r >= 3)")
    edges = e.select(F.col("p").alias("pack"), F.col("e").alias("edge"), F.col("way").alias("way_id"), (F.col("r") * 3 + F.col("p")).alias("offset"), (F.col("way") * 9 + F.col("r")).alias("from_node"), (F.col("way") * 9 + F.col("r") + 1).alias("to_node"), (4 - F.col("p")).alias("points"))
    i = F.col("i")
    points = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("points") - 1))).select("pack", "edge", "i", ((F.col("way_id") * 24 + F.col("offset") + i) * 100).alias("lat_e7"), F.when(F.col("way_id") % 4 == 0, 0).otherwise(F.col("pack") * 5).alias("lon_e7"))
    return V.adjacent_edges(edges, points)
