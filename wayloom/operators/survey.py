"""Cumulative series of held rates, road context of positions, and the survey of times at which a pin could have been set.

Times are whole nanoseconds. Running sums are made within blocks of time and the blocks' sums added up, so a session with a large part of
all rows isn't one task's work. A session's candidates are a grid of its time, so their number follows its duration, not its rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G
from . import align, roads as R

SECOND = 1_000_000_000


def cumulative(df: DataFrame, keys: list[str], t: str, rate: str, order: str, block: int, unit: float = SECOND, hold: float | None = None, gate: float | None = None) -> DataFrame:
    """(keys, t, order, total): the integral of a rate up to each row. Each rate lasts until the next row: at most ``hold`` units, or not at all
    over gaps longer than ``gate``. Equal times add nothing; rows of one time are in ``order``."""
    of = F.floor(F.col(t) / block)
    rows = df.select(*keys, t, order, F.col(rate).alias("rate"), of.alias("__b"))
    inside = Window.partitionBy(*keys, "__b").orderBy(t, order)
    rows = rows.withColumn("__p", F.lag(F.struct(t, "rate")).over(inside))
    last = rows.groupBy(*keys, "__b").agg(F.max(F.struct(t, order, "rate")).alias("z"))
    before = last.select(*keys, "__b", F.lag(F.struct(f"z.{t}", "z.rate")).over(Window.partitionBy(*keys).orderBy("__b")).alias("__q"))
    rows = rows.join(before, [*keys, "__b"]).withColumn("__p", F.coalesce("__p", "__q"))
    gap = F.greatest((F.col(t) - F.col(f"__p.{t}")) / unit, F.lit(0.0))
    held = F.least(gap, F.lit(float(hold))) if hold is not None else gap
    add = F.col("__p.rate") * (F.when(gap <= gate, held).otherwise(0.0) if gate is not None else held)
    rows = rows.withColumn("__add", F.coalesce(add, F.lit(0.0))).drop("__p", "__q")
    sums = rows.groupBy(*keys, "__b").agg(F.sum("__add").alias("s"))
    base = sums.select(*keys, "__b", F.coalesce(F.sum("s").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    running = F.sum("__add").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(base, [*keys, "__b"]).select(*keys, t, order, (F.col("base") + running).alias("total"))


def value_at(probes: DataFrame, series: DataFrame, keys: list[str], t: str, order: str) -> DataFrame:
    """``probes`` with ``total``: the series' value at its last sample at or before their time, null before the first."""
    last = series.groupBy(*keys, t).agg(F.max_by("total", order).alias("total"))
    return align.as_of(probes, last, keys, t, "total").withColumn("total", F.col("prev_v")).drop("prev_t", "prev_v")


# fixed values: radii, distances (metres) and angles (degrees) of a junction and of a parallel road
JUNCTION_M, JUNCTION_DEG, PARALLEL_MIN_M, PARALLEL_MAX_M, PARALLEL_DEG, REACH_M, MOVING = 25.0, 45.0, 15.0, 80.0, 20.0, 20.0, 2.0


def road_context(points: DataFrame, index: DataFrame, key: str, size: float) -> DataFrame:
    """(key, junction, parallel, context) of points (key, px, py, course, speed) near roads; no row where none is near.

    The direction is the course of a moving point, else that of the nearest road. A junction is a road within its radius that crosses
    the direction, a parallel a road beside the nearest one that keeps it. The index's radius must be the largest distance looked at.
    Points of one place and direction are looked at once."""
    moving = F.col("course").isNotNull() & (F.col("speed") >= MOVING)
    places = points.select(key, "px", "py", F.when(moving, F.col("course")).alias("course"))
    return R.at_places(places, key, lambda p: _context(R.candidates(p, index, size, PARALLEL_MAX_M + REACH_M), key))


def _context(c: DataFrame, key: str) -> DataFrame:
    """The context from candidates; the course is null where a point doesn't move."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    along = (F.col("px") - F.col("ax")) * F.col("ux") + (F.col("py") - F.col("ay")) * F.col("uy")
    c = c.withColumn("len", length).where("len > 0").withColumns({"ux": dx / F.col("len"), "uy": dy / F.col("len")})
    c = c.withColumn("interior", (along > 0) & (along < F.col("len")))
    near = F.min(F.struct("distance", "way_id", "seg", "ux", "uy")).over(Window.partitionBy(key))
    c = c.withColumn("near", near)
    moving = F.col("course").isNotNull()
    east, north = F.when(moving, F.sin(F.radians("course"))).otherwise(F.col("near.ux")), F.when(moving, F.cos(F.radians("course"))).otherwise(F.col("near.uy"))
    c = c.withColumn("cos", F.abs(F.col("ux") * east + F.col("uy") * north))
    d, first = F.col("distance"), F.col("near.distance")
    cosine = lambda deg: F.cos(F.radians(F.lit(deg)))
    junction = F.max((d <= JUNCTION_M) & (F.col("cos") < cosine(JUNCTION_DEG)))
    parallel = F.max(F.col("interior") & (d >= F.greatest(F.lit(PARALLEL_MIN_M), first + PARALLEL_MIN_M)) & (d <= PARALLEL_MAX_M) & (F.col("cos") >= cosine(PARALLEL_DEG)))
    out = c.groupBy(key).agg(junction.alias("junction"), parallel.alias("parallel"))
    return out.withColumn("context", F.when(F.col("junction"), "junction").when(F.col("parallel"), "parallel").otherwise("straight"))


class Options(NamedTuple):
    """Times in ``unit`` nanoseconds, distances in metres."""

    unit: int = SECOND
    before: float = 90.0
    window: float = 120.0
    step: float = 5.0
    least_fixes: int = 25
    least_path: float = 250.0
    least_covered: int = 22
    longest_gap: float = 3.0
    accuracy: float = 15.0
    clearance: float = 30.0
    picks: int = 6
    apart: float = 60.0


#: Contexts in the order in which they are served.
CONTEXTS = ("straight", "junction", "parallel")


def pin_candidates(fixes: DataFrame, pins: DataFrame, excluded: DataFrame, o: Options = Options()) -> DataFrame:
    """(session, t, first, source, fixes, path, lat, lon): grid times at which a pin could stand.

    ``fixes`` are (session, t, source, lat, lon, accuracy, covered), one per time and source; ``pins`` (session, t); ``excluded`` (session, from,
    to). A time needs a source with enough fixes, path and covered fixes in the time before it (that with the most fixes, the
    smaller name on ties) and a position there; its window must touch no exclusion and keep clear of pins."""
    u = lambda x: int(x * o.unit)
    ends = fixes.groupBy("session").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    start = F.ceil((F.col("first") + u(o.before)) / o.unit) * o.unit
    stop = F.col("last") - u(o.window - o.before)
    grid = ends.where(start <= stop).select("session", "first", F.explode(F.sequence(start.cast("long"), stop.cast("long"), F.lit(u(o.step)).cast("long"))).alias("t"))
    grid = grid.withColumns({"t0": F.col("t") - u(o.before), "end": F.col("t") + u(o.window - o.before)})
    # exclusions and pins as ranges of grid times they rule out: then an anti join on session and time
    out = excluded.select("session", (F.col("from") - u(o.window - o.before)).alias("from"), (F.col("to") + u(o.before)).alias("to"))
    out = out.unionByName(pins.select("session", (F.col("t") - u(o.window - o.before + o.clearance)).alias("from"), (F.col("t") + u(o.before + o.clearance)).alias("to")))
    grid = align.excluded(grid, out, ["session"], "t", u(o.window))
    # rings: each fix meets the grid times of its bucket and the next
    near = grid.select("session", "t", "t0", F.explode(F.sequence(F.floor(F.col("t0") / u(o.before)), F.floor(F.col("t") / u(o.before)))).alias("b"))
    f = fixes.select("session", F.col("t").alias("ft"), "source", "lat", "lon", "covered", F.floor(F.col("t") / u(o.before)).alias("b"))
    ring = near.join(f, ["session", "b"]).where("ft between t0 and t")
    key = Window.partitionBy("session", "t", "source")
    at = key.orderBy("ft")
    ring = ring.withColumns({"lat0": F.first("lat").over(at), "lon0": F.first("lon").over(at)})
    east, north = G.enu("lat", "lon", "lat0", "lon0")
    ring = ring.withColumns({"e": east, "n": north})
    leg = F.sqrt(F.pow(F.col("e") - F.lag("e").over(at), 2) + F.pow(F.col("n") - F.lag("n").over(at), 2))
    ring = ring.withColumn("leg", leg).groupBy("session", "t", "source").agg(F.count("*").alias("fixes"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("path"), F.count_if("covered").alias("covered"))
    ring = ring.where((F.col("fixes") >= o.least_fixes) & (F.round("path", 6) >= o.least_path))
    best = ring.withColumn("r", F.row_number().over(Window.partitionBy("session", "t").orderBy(F.desc("fixes"), "source"))).where("r = 1").drop("r").where(F.col("covered") >= o.least_covered)
    # the position at the time: exact, or between two fixes of that source
    place = fixes.select("session", "source", "t", F.struct("lat", "lon", "accuracy").alias("v"))
    p = align.as_of(best, place, ["session", "source"], "t", "v", forward=True)
    sound = lambda x: F.col(f"{x}.accuracy") <= o.accuracy
    share = (F.col("t") - F.col("prev_t")) / (F.col("next_t") - F.col("prev_t"))
    exact = F.col("prev_t") == F.col("t")
    between = (F.col("next_t") - F.col("prev_t") <= u(o.longest_gap)) & sound("prev_v") & sound("next_v")
    mixed = lambda c: F.when(exact, F.col(f"prev_v.{c}")).otherwise(F.col(f"prev_v.{c}") + share * (F.col(f"next_v.{c}") - F.col(f"prev_v.{c}")))
    p = p.where(F.when(exact, sound("prev_v")).otherwise(F.coalesce(between, F.lit(False))))
    return p.select("session", "t", "source", "fixes", "path", mixed("lat").alias("lat"), mixed("lon").alias("lon")).join(ends.select("session", "first"), "session")


def spread_picks(candidates: DataFrame, o: Options = Options()) -> DataFrame:
    """(session, t, context, place): picks among candidates (session, t, first, context), contexts served in turn: of each the time farthest from all
    picked so far (from the session's first fix, when there is none), the earlier on ties, at least ``apart`` from all of them."""
    c = candidates.groupBy("session").agg(F.min("first").alias("first"), F.collect_list(F.struct("t", "context")).alias("c"))
    apart = int(o.apart * o.unit)
    kind = "array<struct<t:bigint,context:string>>"

    def serve(picked: Column, k: Column) -> Column:
        turn = F.element_at(F.array(*map(F.lit, CONTEXTS)), (k % len(CONTEXTS) + 1).cast("int"))
        gap = lambda x: F.array_min(F.transform(picked, lambda p: F.abs(p.t - x.t)))
        pool = F.filter(F.transform(F.filter(F.col("c"), lambda x: x.context == turn), lambda x: F.struct(F.coalesce(gap(x), x.t - F.col("first")).alias("far"), (-x.t).alias("t"))), lambda x: (F.size(picked) == 0) | (x.far >= apart))
        best = F.array_max(pool)
        more = F.array(F.struct((-best.t).alias("t"), turn.alias("context")))
        return F.when((F.size(picked) < o.picks) & (F.size(pool) > 0), F.concat(picked, more)).otherwise(picked).cast(kind)

    rounds = F.sequence(F.lit(0), F.lit(len(CONTEXTS) * o.picks - 1))
    picks = F.aggregate(rounds, F.array().cast(kind), serve)
    return c.select("session", F.posexplode(F.array_sort(picks)).alias("place", "p")).select("session", "p.t", "p.context", "place")


def window_dynamics(fixes: DataFrame, speeds: DataFrame, rates: DataFrame, key: str = "session", unit: int = SECOND, hold: float = 2.0, gap: float = 1.0) -> DataFrame:
    """(key, path_m, driven_m, speed_gap_kmh, course_change, gyro_turn): whether a window's fixes move as its vehicle did.

    ``fixes``: t, line, lat, lon, speed (m/s), course (both negative where invalid); ``speeds``: t, mps, one per time; ``rates``: t, rad_s, one per time. The path is that of
    the fixes; the distance driven holds each speed until the next one, ``hold`` units at most, within the window; the gap is the median of the
    differences to the nearest speed within ``gap``; the course's changes and the turn by the gyroscope (clockwise) are from the first fix with a course to the last."""
    from . import sequence as Q

    w = Window.partitionBy(key).orderBy("t", "line")
    east, north = G.enu("lat", "lon", F.lag("lat").over(w), F.lag("lon").over(w))
    f = fixes.withColumns({"e": east, "n": north})
    span = f.groupBy(key).agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.coalesce(F.sum(F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))), F.lit(0.0)).alias("path_m"))
    held = speeds.withColumn("next", F.lead("t").over(Window.partitionBy(key).orderBy("t"))).join(span.where("stop > start"), key)
    first = F.greatest("start", "t")
    end = F.least("stop", F.coalesce("next", "stop"), F.col("t") + int(hold * unit))
    driven = held.where(F.col("t") >= F.col("start") - int(hold * unit)).where("t <= stop").groupBy(key).agg(F.sum(F.col("mps") * F.greatest(end - first, F.lit(0)) / unit).alias("driven_m"))
    near = align.as_of(fixes.where("speed >= 0").select(key, "t", "speed"), speeds, [key], "t", "mps", forward=True)
    _, mps = align.nearest(near, "t", int(gap * unit))
    off = near.withColumn("d", F.abs(F.col("speed") - mps) * 3.6).where("d is not null").groupBy(key).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("speed_gap_kmh"))
    coursed = fixes.where("course >= 0").withColumn("d", Q.wrapped_change(F.col("course"), F.lag("course").over(w)))
    turns = coursed.groupBy(key).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.sum("d").alias("course_change")).where("b > a")
    inside = rates.join(turns.select(key, "a", "b"), key).where(F.col("t").between(F.col("a"), F.col("b")))
    by = Window.partitionBy(key).orderBy("t")
    piece = (F.col("rad_s") + F.lag("rad_s").over(by)) / 2 * (F.col("t") - F.lag("t").over(by)) / unit
    gyro = inside.withColumn("y", piece).groupBy(key).agg((-F.degrees(F.sum("y"))).alias("gyro_turn"))
    out = span.select(key, "path_m")
    for more in (driven, off, turns.select(key, "course_change"), gyro):
        out = out.join(more, key, "left")
    return out
