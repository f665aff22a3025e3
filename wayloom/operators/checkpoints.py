"""Checkpoints of an evaluation: their schedule, scores with the truth's own deviation, road verdicts, and a run's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G, motion as K

# fixed values: accuracy of a clean fix (m), tolerance by which an excluded pin is matched (ns), share on the road, distances (m)
CLEAN_M, PIN_TOLERANCE_NS, ON_ROAD, UNMAPPED_M, CAPTURED_M = 15.0, 100_000_000, 0.5, 15.0, 25.0
KINDS = ("cleanFix", "manualFix", "truthPoint", "truthEnd")


def schedule(fixes: DataFrame, pins: DataFrame, points: DataFrame, ends: DataFrame, ranges: DataFrame, excluded: DataFrame, cutoff: DataFrame, pair_window: int, key: str = "session") -> DataFrame:
    """(key, t, kind, line, lat, lon, sigma, not_scored, after_cutoff): withheld clean fixes outside excluded ranges, pins, truth points and the end.

    ``fixes``: line, t, lat, lon, accuracy, withheld; ``pins``: line, t, lat, lon, sigma; ``points`` and ``ends`` (the end at the last time): t, lat, lon,
    sigma; ``ranges``: from, to; ``excluded``: t of pins that don't count; ``cutoff``: until. A pin within the window of the one before it is a refinement;
    an exclusion takes the nearest pin within its tolerance (the earlier on ties)."""
    clean = fixes.where(F.col("withheld") & F.col("accuracy").between(0, CLEAN_M))
    out = (clean[key] == ranges[key]) & clean["t"].between(ranges["from"], ranges["to"])
    clean = clean.join(ranges, out, "left_anti").select(key, "t", F.lit("cleanFix").alias("kind"), "line", "lat", "lon", F.col("accuracy").alias("sigma"))
    w = Window.partitionBy(key).orderBy("t", "line")
    p = pins.withColumn("refines", F.coalesce((F.col("t") - F.lag("t").over(w) <= pair_window) & F.lit(pair_window > 0), F.lit(False)))
    slot = lambda c: F.floor(c / (2 * PIN_TOLERANCE_NS))
    e = excluded.select(key, F.col("t").alias("et")).distinct().withColumn("b", F.explode(F.sequence(slot(F.col("et") - PIN_TOLERANCE_NS), slot(F.col("et") + PIN_TOLERANCE_NS))))
    near = pins.select(key, "t", "line", slot(F.col("t")).alias("b")).join(e, [key, "b"]).where(F.abs(F.col("t") - F.col("et")) <= PIN_TOLERANCE_NS)
    hit = near.groupBy(key, "et").agg(F.min(F.struct(F.abs(F.col("t") - F.col("et")).alias("d"), "t", "line")).alias("m")).select(key, "m.line", F.lit(True).alias("hit")).distinct()
    p = p.join(hit, [key, "line"], "left")
    why = F.when(F.coalesce("hit", F.lit(False)), "excluded").when(F.col("refines"), "refinement")
    p = p.select(key, "t", F.lit("manualFix").alias("kind"), "line", "lat", "lon", "sigma", why.alias("not_scored"))
    given = lambda df, kind: df.select(key, "t", F.lit(kind).alias("kind"), "lat", "lon", "sigma")
    every = p.unionByName(clean, True).unionByName(given(points, "truthPoint"), True).unionByName(given(ends, "truthEnd"), True)
    return every.join(cutoff, key, "left").withColumn("after_cutoff", F.coalesce(F.col("t") > F.col("until"), F.lit(False))).drop("until")


def scored(checkpoints: DataFrame) -> DataFrame:
    """Adds the error in the estimate's plane, its share of the distance, and whether truth lies in the ellipse, as it is and widened by the truth's
    deviation. Columns of the estimate (null where there is none): e_lat, e_lon, major, minor, orientation; distance."""
    east, north = G.enu("lat", "lon", "e_lat", "e_lon")
    c = checkpoints.withColumns({"de": east, "dn": north})
    error = F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn"))
    sigma = K.truth_sigma(F.col("kind"), F.col("sigma"))
    wide = lambda axis: G.widened(axis, sigma)
    return c.withColumns({
        "error_m": error, "error_pct": F.when(F.col("distance") > 0, 100 * error / F.col("distance")), "inside": G.in_ellipse("major", "minor", "orientation", "de", "dn"),
        "inside_wide": G.in_ellipse(wide("major"), wide("minor"), "orientation", "de", "dn"),
    }).drop("de", "dn")


def road_verdict(truth: Column, nearest: Column, share: Column, matched: Column, true_way: Column, matched_distance: Column, semi_axis: Column, inside: Column, tolerance: float, estimated: Column) -> Column:
    """struct(verdict, unmapped, captured) of a fix: right, wrong, off or notEngaged where the truth is matched and there is an estimate; why no road
    is mapped there; and whether the estimate sits on a mapped one all the same."""
    off = F.coalesce(nearest, F.lit(float("inf"))) > UNMAPPED_M
    unmapped = F.when(off, "noRoadWithin15").when(truth == "noRoad", "noCompatibleRoadWithin15")
    near = F.coalesce(matched_distance, F.lit(float("inf"))) <= tolerance
    right = matched.isNotNull() & (F.coalesce(matched == true_way, F.lit(False)) | near)
    verdict = F.when((truth == "matched") & estimated, F.when(share.isNull(), "notEngaged").when(share < ON_ROAD, "off").when(right, "right").otherwise("wrong"))
    on_edge = (F.coalesce(share, F.lit(0.0)) >= ON_ROAD) & matched.isNotNull()
    captured = on_edge & (F.coalesce(semi_axis, F.lit(float("inf"))) < CAPTURED_M) & F.coalesce(~inside, F.lit(False))
    return F.struct(verdict.alias("verdict"), unmapped.alias("unmapped"), (unmapped.isNotNull() & estimated & captured).alias("captured"))


def run_figures(checkpoints: DataFrame, key: str = "session") -> DataFrame:
    """(key, scored, max_error_m, max_error_pct, end_error_m, end_is_truth): of checkpoints that count, the largest error (the first one on
    ties) with its own percentage, and the error at the end: the scored truth end, else the last scored checkpoint."""
    counts = F.col("error_m").isNotNull() & F.col("not_scored").isNull() & ~F.col("after_cutoff")
    order = ["t", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), F.coalesce("line", F.lit(-1)).alias("line")]
    c = checkpoints.where(counts)
    top = F.min(F.struct((-F.round("error_m", 6)).alias("e"), *order, "error_pct")).alias("top")
    last = F.max(F.struct(*order, F.round("error_m", 6).alias("e"), "kind")).alias("last")
    end = F.max(F.when(F.col("kind") == "truthEnd", F.struct(*order, F.round("error_m", 6).alias("e")))).alias("end")
    g = c.groupBy(key).agg(F.count("*").alias("scored"), top, last, end)
    return g.select(key, "scored", (-F.col("top.e")).alias("max_error_m"), F.col("top.error_pct").alias("max_error_pct"), F.coalesce("end.e", "last.e").alias("end_error_m"), F.col("end").isNotNull().alias("end_is_truth"))
