"""From tagged ways to the edges of a road graph, with what was left out counted.

Ways are (way_id, highway, oneway, junction, area, service), their nodes (way_id, pos, node_id, lat_e7, lon_e7), where a node may lack
a location. All work is windows by way, joins on node and components of stacked nodes; nothing is gathered.

Results for odd input: a null tag is an absent one; nodes of a way that isn't there are ignored; a way without nodes is degenerate; a way id
that comes twice is an error (``twice`` names them); an empty table gives no edges and a row of zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G, rules
from .lineage import cut
from .roads import merged_nodes

# fixed values: classes of a country's and of a region's graph
NATIONAL = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")
REGION = (*NATIONAL, "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")


class Built(NamedTuple):
    ways: DataFrame  # way_id, direction, reason (null: kept)
    nodes: DataFrame  # way_id, pos (anew, in driving order), node_id (merged), lat_e7, lon_e7 of kept ways
    edges: DataFrame
    repeated: DataFrame  # one row: points dropped at a repeated coordinate
    merged: DataFrame  # node_id, merged


def twice(ways: DataFrame) -> DataFrame:
    return ways.groupBy("way_id").agg(F.count("*").alias("n")).where("n > 1").select("way_id")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes in driving order with the first of their run: nodes that repeat the one before or lie at its place."""
    order = F.when(F.col("direction") == "reversed", -F.col("pos")).otherwise(F.col("pos"))
    n = nodes.withColumn("at", order)
    w = Window.partitionBy("way_id").orderBy("at")
    same = (F.lag("node_id").over(w) == F.col("node_id")) | ((F.lag("lat_e7").over(w) == F.col("lat_e7")) & (F.lag("lon_e7").over(w) == F.col("lon_e7")))
    n = n.withColumn("new", F.coalesce(~same, F.lit(True)).cast("int"))
    n = n.withColumn("run", F.sum("new").over(w) - 1)
    return n.withColumn("head", F.last(F.when(F.col("new") == 1, F.col("node_id")), ignorenulls=True).over(w))  # in the same order: no second sort


def build(ways: DataFrame, way_nodes: DataFrame, classes: tuple[str, ...] = REGION, name: Callable[[Column], Column] | None = None) -> Built:
    """Decides on ways, turns those against their nodes' order, drops repeats, merges stacked nodes, and cuts ways at nodes that are used
    more than once, at their ends and beside nodes without a location. ``name`` gives the node that an id stands for, where several ids do: merged
    nodes take it, and so do all other ids that stand for a merged one."""
    absent = F.lit(None).cast("string")
    tags = ways.select("way_id", *(F.col(c) if c in ways.columns else absent.alias(c) for c in ("highway", "oneway", "junction", "area", "service")))
    reason = F.when(~F.coalesce(F.col("highway").isin(*classes), F.lit(False)), "class").when(F.col("area") == "yes", "area").when(F.col("service") == "parking_aisle", "aisle")
    way = rules.direction(F.col("oneway"), F.col("junction"), F.col("highway"))
    tags = tags.select("way_id", way.alias("direction"), reason.alias("reason"))
    runs = cut(_runs(way_nodes.join(tags.where("reason is null").select("way_id", "direction"), "way_id")))
    located = F.count_if((F.col("new") == 1) & F.col("lat_e7").isNotNull())
    sound = runs.groupBy("way_id").agg(located.alias("located"))
    decided = tags.join(sound, "way_id", "left")
    few = F.col("reason").isNull() & (F.coalesce("located", F.lit(0)) < 2)
    decided = cut(decided.select("way_id", "direction", F.when(few, "degenerate").otherwise(F.col("reason")).alias("reason")))
    stacked = (F.col("new") == 0) & (F.col("node_id") != F.col("head"))
    repeated = runs.agg(F.count_if(stacked).alias("n"))
    # stacked nodes as pairs that follow each other at one place: what ``merged_nodes`` takes
    pairs = runs.where(stacked).select("node_id", "head").distinct().withColumn("way_id", F.concat_ws(":", "head", "node_id"))
    pairs = pairs.select("way_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("head").alias("node_id")), F.struct(F.lit(1).alias("pos"), F.col("node_id").alias("node_id")))).alias("p"))
    merged = merged_nodes(pairs.select("way_id", "p.pos", "p.node_id", F.lit(0).alias("lat_e7"), F.lit(0).alias("lon_e7")))
    kept = runs.where("new = 1").join(decided.where("reason is null").select("way_id"), "way_id")
    if name is None:
        kept = kept.join(merged, "node_id", "left")
    else:
        merged = merged.withColumn("merged", name(F.col("merged")))
        named = merged.select("merged").distinct()
        kept = kept.withColumn("__n", name(F.col("node_id"))).join(named, F.col("__n") == F.col("merged"), "left")
    kept = kept.select("way_id", F.col("run").alias("pos"), F.coalesce("merged", "node_id").alias("node_id"), "lat_e7", "lon_e7")
    kept = cut(kept)
    return Built(decided, kept, _edges(kept), repeated, merged)


def _edges(nodes: DataFrame) -> DataFrame:
    """(way_id, offset, from_node, to_node, points, length_dm): pieces between nodes without a location, cut at shared nodes."""
    uses = nodes.groupBy("node_id").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("way_id").orderBy("pos")
    there = F.col("lat_e7").isNotNull()
    n = nodes.join(uses, "node_id").withColumn("gap", F.sum((~there).cast("int")).over(w)).where(there)
    piece = Window.partitionBy("way_id", "gap").orderBy("pos")
    inner = F.lag("pos").over(piece).isNotNull() & F.lead("pos").over(piece).isNotNull()
    n = n.withColumn("cut", (inner & (F.col("uses") > 1)).cast("int"))
    n = n.withColumns({"part": F.coalesce(F.sum("cut").over(piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "step": G.distance_e7(F.lag("lat_e7").over(piece), F.lag("lon_e7").over(piece), F.col("lat_e7"), F.col("lon_e7"))})
    # a node where a piece begins has no step in it
    ends, begins = F.struct("part", F.col("step").alias("inner")), F.struct((F.col("part") + 1).alias("part"), F.lit(None).cast("double").alias("inner"))
    both = n.select("way_id", "gap", "pos", "node_id", F.explode(F.when(F.col("cut") == 1, F.array(ends, begins)).otherwise(F.array(ends))).alias("e")).select("*", "e.*")
    e = both.groupBy("way_id", "gap", "part").agg(F.min("pos").alias("offset"), F.min_by("node_id", "pos").alias("from_node"), F.max_by("node_id", "pos").alias("to_node"), F.count("*").alias("points"), F.round(10 * F.coalesce(F.sum("inner"), F.lit(0.0))).cast("long").alias("length_dm"))
    return e.where("points > 1").drop("gap", "part")


def counters(b: Built) -> DataFrame:
    """One row: ways read, kept, left out by reason, one-way and reversed ones that weren't left out by their tags, points and nodes lost, edges."""
    why = lambda r: F.count_if(F.col("reason") == r)
    through = F.col("reason").isNull() | (F.col("reason") == "degenerate")
    ways = b.ways.agg(
        F.count("*").alias("ways_read"), F.count_if(F.col("reason").isNull()).alias("ways_kept"), why("class").alias("ways_wrong_class"), why("area").alias("ways_area"), why("aisle").alias("ways_aisle"), why("degenerate").alias("ways_degenerate"),
        F.count_if(through & (F.col("direction") != "twoWay")).alias("ways_oneway"), F.count_if(through & (F.col("direction") == "reversed")).alias("ways_reversed"),
    )
    lost = b.nodes.agg(F.count_if(F.col("lat_e7").isNull()).alias("nodes_without_location"))
    merged = b.merged.agg((F.count("*") - F.count_distinct("merged")).alias("nodes_merged"))
    edges = b.edges.agg(F.count("*").alias("edges"))
    out = ways
    for one in (lost, b.repeated.select(F.col("n").alias("points_repeated")), merged, edges):
        out = out.join(F.broadcast(one))  # one row each
    return out
