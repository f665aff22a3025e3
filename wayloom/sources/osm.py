"""Map extracts: ways from OPL text, coverage rings from GeoJSON. Text is read by Spark; parsing is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def unescaped(c: Column) -> Column:
    """``%hex%`` sequences as the characters they name."""
    parts = F.split(c, "%")
    code = lambda x: F.decode(F.unhex(F.lpad(F.conv(x, 16, 16), 8, "0")), "UTF-32")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).when(x == "", F.lit("%")).otherwise(code(x))), "")


def e7(c: Column) -> Column:
    """Degrees in text as whole 1e-7 degrees, without floating point; null with more than seven decimals."""
    ok = c.rlike(r"^-?\d{1,3}(\.\d{1,7})?\z")
    return F.when(ok, F.round(c.try_cast("decimal(12,7)") * F.lit(10000000)).cast("long"))


def opl_ways(lines: DataFrame, value: str = "value") -> DataFrame:
    """(way_id, tags, nodes) of way lines; other lines are dropped. A node without a location has null coordinates."""
    w = lines.where(F.col(value).startswith("w"))
    fields = F.split(value, " ")
    part = lambda letter: F.substring(F.element_at(F.filter(fields, lambda x: x.startswith(letter)), 1), 2, 1 << 30)
    tags = F.filter(F.split(F.coalesce(part("T"), F.lit("")), ","), lambda x: x != "")
    pairs = F.transform(tags, lambda x: F.struct(unescaped(F.substring_index(x, "=", 1)).alias("k"), unescaped(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    refs = F.filter(F.split(F.coalesce(part("N"), F.lit("")), ","), lambda x: x != "")

    def node(x: Column) -> Column:
        at = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
        return F.struct(F.regexp_extract(x, r"^n(\d+)", 1).cast("long").alias("node_id"), e7(at(r"y(-?[\d.]+)")).alias("lat_e7"), e7(at(r"x(-?[\d.]+)")).alias("lon_e7"))

    return w.select(F.substring(fields[0], 2, 30).cast("long").alias("way_id"), F.map_from_entries(pairs).alias("tags"), F.transform(refs, node).alias("nodes"))


def opl_problems(lines: DataFrame, n: str, value: str = "value") -> DataFrame:
    """(n, message) of way lines that don't parse, by their line number: the first thing wrong with each. ``opl_ways`` of the others is sound."""
    w = lines.where(F.col(value).startswith("w")).select(F.col(n).alias("n"), F.regexp_replace(value, r"\r\z", "").alias("l"))
    fields = F.filter(F.split("l", " "), lambda x: x != "")
    some = lambda a, f: F.get(F.filter(F.transform(a, f), lambda m: m.isNotNull()), F.lit(0))
    whole = lambda c: c.rlike(r"^-?\d+\z") & c.try_cast("long").isNotNull()

    def escape(c: Column) -> Column:  # a text whose % signs don't pair, or whose code is no character
        parts = F.split(c, "%")
        code = lambda x: F.conv(x, 16, 10).cast("long")
        bad = F.exists(F.transform(parts, lambda x, i: (i % 2 == 1) & (~x.rlike(r"^[0-9A-Fa-f]{1,6}\z") | F.coalesce(code(x).between(0xD800, 0xDFFF) | (code(x) > 0x10FFFF), F.lit(True)))), lambda b: b)
        return (F.size(parts) % 2 == 0) | bad

    def tags(body: Column) -> Column:
        pairs = F.filter(F.split(body, ","), lambda x: x != "")
        return some(pairs, lambda p: F.when(~F.contains(p, F.lit("=")), "tag without '='").when(escape(p), "bad % escape"))

    def node(r: Column) -> Column:
        key = F.regexp_extract(r, r"^n([^x]*)", 1)
        lon, lat = F.regexp_extract(r, "x([^y]*)y", 1), F.regexp_extract(r, "x[^y]*y(.*)", 1)
        named = lambda text: F.concat(F.lit("node "), key, F.lit(text))
        sound = lambda c: F.coalesce(e7(F.regexp_replace(c, r"\.\z", "")).between(-(2**31), 2**31 - 1), F.lit(False))
        return (
            F.when(~r.rlike("^n."), "bad node reference").when(~whole(key), "bad node id").when(F.contains(r, F.lit("x")) & ~r.rlike("x[^y]*y"), named(": x without y"))
            .when(((lon != "") | (lat != "")) & ~(sound(lon) & sound(lat)), named(": bad location"))
        )

    def field(f: Column) -> Column:
        body = F.substring(f, 2, 1 << 30)
        refs = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(body, r",\z", ""), ","))
        return F.when(f.startswith("w"), F.when(~whole(body), "bad way id")).when(f.startswith("T"), tags(body)).when(f.startswith("N"), some(refs, node))

    none = F.when(~F.exists(fields, lambda f: f.startswith("N")), F.concat(F.lit("way "), F.substring(fields[0], 2, 1 << 30), F.lit(" has no node list")))
    return w.select("n", F.coalesce(some(fields, field), none).alias("message")).where("message is not null")


def way_nodes(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", F.posexplode("nodes").alias("pos", "n")).select("way_id", F.col("pos").cast("long").alias("pos"), "n.node_id", "n.lat_e7", "n.lon_e7")


def read_opl(spark: SparkSession, path: str) -> DataFrame:
    return opl_ways(spark.read.text(path))


def geojson_rings(docs: DataFrame, value: str = "value") -> DataFrame:
    """(area, ring, i, x, y) of polygons, multipolygons, features and collections; a ring is named by its part, polygon and place. The closing point is dropped and rings of
    fewer than three points are left out. ``docs`` has one GeoJSON text a row, with an ``area`` name."""
    ring = "array<array<array<double>>>"
    geometry = "struct<type:string,coordinates:string>"
    d = docs.withColumn("g", F.from_json(value, f"type string, coordinates string, geometry {geometry}, features array<struct<geometry:{geometry}>>"))
    single = F.when(F.col("g.type") == "Feature", F.array("g.geometry")).when(F.col("g.type") == "FeatureCollection", F.transform("g.features", lambda f: f.geometry)).otherwise(F.array(F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"))))
    x = d.select("area", F.posexplode(single).alias("part", "geo"))
    polygons = F.when(F.col("geo.type") == "Polygon", F.array(F.from_json("geo.coordinates", ring))).when(F.col("geo.type") == "MultiPolygon", F.from_json("geo.coordinates", f"array<{ring}>"))
    x = x.select("area", "part", F.posexplode(polygons).alias("poly", "rings")).select("area", "part", "poly", F.posexplode("rings").alias("r", "points"))
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    x = x.withColumn("points", F.when(closed, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))).where(F.size("points") >= 3)
    x = x.withColumn("ring", F.struct("part", "poly", "r"))
    return x.select("area", "ring", F.posexplode("points").alias("i", "p")).select("area", "ring", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def framed_replies(chunks: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Replies of a byte stream that came in chunks: split at the prompt, NULs dropped; what follows the last prompt waits."""
    whole = chunks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("__s"))
    parts = F.split(F.replace("__s", F.lit("\0"), F.lit("")), ">")
    return whole.select(*keys, F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("place", "reply"))
