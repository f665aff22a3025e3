"""Rules that a road graph's tables keep, and neighbours across the graphs of several packs.

A graph is five tables: nodes (node, lat_e7, lon_e7), edges (edge, way_id, offset, from_node, to_node, first_point, points, class, level,
flags), points (point, edge, lat_e7, lon_e7), adjacency (node, place, edge) and cells (cell, place, point). Numbers count from 0 in the
order of the table. Rules about what comes before or after are equi-joins on the number, not windows over a whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import shuffled

# fixed values: classes, known flags (bits) and levels of an edge, the largest offset
CLASSES, FLAGS, LEVELS, LAST_OFFSET = range(1, 16), 0x3F, (-5, 5), 2**32 - 1


def violations(nodes: DataFrame, edges: DataFrame, points: DataFrame, adjacency: DataFrame, cells: DataFrame, classes: range = CLASSES, flags: int = FLAGS, levels: tuple[int, int] = LEVELS) -> DataFrame:
    """(rule, at): rows that break a rule, by the number of the edge, point, node or cell. A null where a number should be breaks
    the rule that reads it. An edge breaks as many rules as it breaks; none come back for a sound graph."""
    edge, out = F.col("edge"), []

    def broken(df: DataFrame, rule: str, at: str, bad: Column) -> None:
        out.append(df.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(at).cast("long").alias("at")))

    broken(edges, "class", "edge", ~F.col("class").between(classes.start, classes.stop - 1))
    broken(edges, "flags", "edge", F.col("flags").bitwiseAND(~flags) != 0)
    broken(edges, "level", "edge", ~F.col("level").between(*levels))
    broken(edges, "offset", "edge", (F.col("offset") < 0) | (F.col("offset") + F.col("points") > LAST_OFFSET))
    # order and contiguity: each edge beside the one before it
    before = edges.select((edge + 1).alias("edge"), F.struct("way_id", "offset").alias("key0"), (F.col("first_point") + F.col("points")).alias("next"))
    pair = edges.join(shuffled(before), "edge", "left")
    first = edge == 0
    broken(pair, "order", "edge", ~first & ~(F.col("key0") < F.struct("way_id", "offset")))
    broken(pair, "contiguous", "edge", (F.col("points") < 2) | (F.col("first_point") != F.when(first, 0).otherwise(F.col("next"))))
    # ends: the nodes are there, and lie where the first and last point do
    place = lambda c: F.struct(f"{c}.lat_e7", f"{c}.lon_e7")
    ends = edges.select("edge", F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("first_point").alias("point")), F.struct(F.col("to_node").alias("node"), (F.col("first_point") + F.col("points") - 1).alias("point")))).alias("e")).select("edge", "e.*")
    met = ends.join(shuffled(nodes.select("node", F.struct("lat_e7", "lon_e7").alias("n"))), "node", "left").join(shuffled(points.select("point", F.struct("lat_e7", "lon_e7").alias("p"))), "point", "left")
    broken(met.where("n is null").select("edge").distinct(), "node", "edge", F.lit(True))
    broken(met.where("n is not null").groupBy("edge").agg(F.max(F.col("p").isNull() | (place("n") != place("p"))).alias("bad")), "ends", "edge", F.col("bad"))
    # points: marked with the edge that has them, none outside, no two in a row at one place
    span = edges.select(F.col("edge").alias("of"), F.explode(F.sequence("first_point", F.col("first_point") + F.greatest(F.col("points"), F.lit(1)) - 1)).alias("point"))
    marked = points.join(shuffled(span.groupBy("point").agg(F.min("of").alias("of"), F.count("*").alias("n"))), "point", "left")
    broken(marked, "point_edge", "point", (F.col("of") != edge) | (F.col("n") != 1))
    w = Window.partitionBy("edge").orderBy("point")
    step = points.withColumn("same", (F.lead("lat_e7").over(w) == F.col("lat_e7")) & (F.lead("lon_e7").over(w) == F.col("lon_e7")))
    broken(step, "zero_length", "point", F.coalesce(F.col("same"), F.lit(False)))
    # adjacency: of edges that are there and end at the node, ascending, and all of them
    incident = edges.select("edge", F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("node"))
    listed = adjacency.join(shuffled(incident.withColumn("there", F.lit(True))), ["edge", "node"], "left")
    broken(listed.groupBy("node").agg(F.max(F.col("there").isNull()).alias("bad")), "incident", "node", F.col("bad"))
    w = Window.partitionBy("node").orderBy("place")
    broken(adjacency.withColumn("p", F.lag("edge").over(w)).groupBy("node").agg(F.max(edge <= F.col("p")).alias("bad")), "adjacency_order", "node", F.coalesce(F.col("bad"), F.lit(False)))
    broken(incident.join(shuffled(adjacency), ["edge", "node"], "left_anti").select("edge").distinct(), "both_ends", "edge", F.lit(True))
    # cells: entries ascend and begin a segment
    w = Window.partitionBy("cell").orderBy("place")
    broken(cells.withColumn("p", F.lag("point").over(w)).groupBy("cell").agg(F.max(F.col("point") <= F.col("p")).alias("bad")), "cell_order", "cell", F.coalesce(F.col("bad"), F.lit(False)))
    starts = points.select("point", F.col("edge").alias("e0")).join(shuffled(points.select((F.col("point") - 1).alias("point"), F.col("edge").alias("e1"))), "point").where("e0 = e1").select("point", F.lit(True).alias("there"))
    broken(cells.join(shuffled(starts), "point", "left").groupBy("cell").agg(F.max(F.col("there").isNull()).alias("bad")), "segment_start", "cell", F.col("bad"))
    return reduce(DataFrame.unionByName, out)


def refused_packs(packs: DataFrame) -> DataFrame:
    """(pack, reason) of packs (pack, family, grid_id, content_hash) that can't be used together: another family or grid than the first
    pack's (the smallest name), or a content hash that a pack before has."""
    first = packs.agg(F.min(F.struct("pack", "family", "grid_id")).alias("f"))
    p = packs.crossJoin(F.broadcast(first))  # one row
    again = F.row_number().over(Window.partitionBy("content_hash").orderBy("pack")) > 1
    reason = F.when(F.col("family") != F.col("f.family"), "family").when(F.col("grid_id") != F.col("f.grid_id"), "grid").when(again, "duplicate")
    return p.withColumn("reason", reason).where("reason is not null").select("pack", "reason")


def adjacent_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(pack, edge, other_pack, other): neighbours of every edge, within its pack and across packs.

    ``edges`` are (pack, edge, way_id, offset, from_node, to_node, points), ``points`` (pack, edge, i, lat_e7, lon_e7) with i from 0. Edges of a
    pack are neighbours at a shared node; those of two packs if they are of one way and share a point of it (its place in the way), or if an
    end of one of them lies at a point of the other. All of it is joins on equal keys: node, (way, place) and coordinate. An edge isn't its own neighbour."""
    key = F.struct("pack", "edge").alias("a")
    nodes = edges.select(key, "pack", F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("node"))
    pairs = lambda x, y, on: x.join(y.withColumnRenamed("a", "b"), on).select("a", "b")
    inside = pairs(nodes, nodes, ["pack", "node"])
    places = edges.select(key, "way_id", F.explode(F.sequence("offset", F.col("offset") + F.col("points") - 1)).alias("place"))
    same_way = pairs(places, places, ["way_id", "place"]).where("a.pack <> b.pack")
    last = edges.select("pack", "edge", (F.col("points") - 1).alias("last"))
    at = points.join(last, ["pack", "edge"]).select(key, "lat_e7", "lon_e7", ((F.col("i") == 0) | (F.col("i") == F.col("last"))).alias("end"))
    ends = at.where("end").drop("end")
    touch = pairs(ends, at.drop("end"), ["lat_e7", "lon_e7"]).where("a.pack <> b.pack")
    across = same_way.unionByName(touch).unionByName(touch.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = inside.unionByName(across).where("a <> b").distinct()
    return out.select("a.pack", "a.edge", F.col("b.pack").alias("other_pack"), F.col("b.edge").alias("other"))
