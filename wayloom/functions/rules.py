"""Rule tables as column expressions: road tags, downloads, connections, priors. No UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: road classes by tag value, 1 the largest
CLASSES = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "unclassified": 6, "residential": 7, "living_street": 8, "service": 9, "road": 10}
NATIONAL = ["motorway", "trunk", "primary", "motorway_link", "trunk_link", "primary_link"]


def road_class(highway: Column) -> Column:
    """struct(class, is_link) of a highway tag; class is null for other ways."""
    base = F.regexp_replace(highway, "_link$", "")
    table = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    return F.struct(F.try_element_at(table, base).alias("class"), highway.endswith("_link").alias("is_link"))


def direction(oneway: Column, junction: Column, highway: Column) -> Column:
    """twoWay, forward, implied (by the kind of road) or reversed."""
    return (
        F.when(oneway.isin("yes", "true", "1"), "forward").when(oneway.isin("-1", "reverse"), "reversed").when(oneway.isin("no", "false", "0", "reversible", "alternating"), "twoWay")
        .when(F.coalesce(junction.isin("roundabout", "circular"), F.lit(False)) | F.coalesce(highway.isin("motorway", "motorway_link"), F.lit(False)), "implied").otherwise("twoWay")
    )


def level(layer: Column, bridge: Column, tunnel: Column) -> Column:
    n = F.trim(layer).try_cast("int")
    whole = F.when(F.trim(layer).rlike(r"^[+-]?\d+$"), n)
    return F.coalesce(F.when(whole.isNotNull(), F.least(F.greatest(whole, F.lit(-5)), F.lit(5))), F.when(bridge != "no", 1).when(tunnel != "no", -1).otherwise(0)).cast("long")


def lanes(text: Column) -> Column:
    n = F.trim(text).try_cast("int")
    return F.coalesce(F.when(n > 0, F.least(n, F.lit(255))), F.lit(0)).cast("long")


def flags(*bits: Column) -> Column:
    """A bit set: the first condition is bit 0."""
    total = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        total = total + F.when(b, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def download_plan(partial: Column, expected: Column, etag: Column) -> Column:
    return F.when(partial.isNull() | (partial == 0), "fresh").when(partial == expected, "verifyOnly").when(partial > expected, "discard").when(etag.isNotNull(), "resume").otherwise("discard")


def status_decision(status: Column, offset: Column, range_first: Column, range_total: Column, expected: Column) -> Column:
    """What to do with a download's response."""
    return (
        F.when(status == 200, "restart")
        .when((status == 206) & (range_first == offset) & (range_total == expected), "append")
        .when(status == 206, "discard")
        .when(status == 416, F.when(offset == expected, "verify").otherwise("discard"))
        .when(status.isin(404, 410), "gone").when((status == 429) | (status >= 500), "retry").otherwise("fail")
    )


def response_decision(status: Column, offset: Column, content_range: Column, etag: Column, stored_etag: Column, expected: Column, length: Column) -> Column:
    """struct(action, why) of a download's response: writeFromZero, append, restart (without a range) or fail. ``offset`` is null for a request
    without a range; tags are compared without their weak mark."""
    at = lambda k: F.nullif(F.regexp_extract(content_range, r"^bytes (\d+)-(\d+)/(\d+|\*)\z", k), F.lit(""))
    first, last, total = (at(k).try_cast("long") for k in (1, 2, 3))
    usable = F.coalesce((first <= last) & (total.isNull() | (last < total)), F.lit(False))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    of = lambda action, why: F.struct(F.lit(action).alias("action"), F.lit(why).alias("why"))
    resumed = (
        F.when(offset.isNull(), of("fail", "norange")).when(content_range.isNull(), of("restart", "noheader")).when(~usable, of("restart", "header")).when(first != offset, of("restart", "start"))
        .when(~total.eqNullSafe(expected), of("restart", "size")).when(tag(etag) != tag(stored_etag), of("restart", "etag")).otherwise(of("append", ""))
    )
    return (
        F.when(status == 200, F.when(length != expected, of("fail", "length")).otherwise(of("writeFromZero", ""))).when(status == 206, resumed)
        .when(status == 416, F.when(offset.isNull(), of("fail", "norange")).otherwise(of("restart", "unservable"))).when(status == 404, of("fail", "gone")).when(status.between(500, 599), of("fail", "server"))
        .when(status.between(400, 499), of("fail", "client")).otherwise(of("fail", "unexpected"))
    )


def byte_range(first: Column, last: Column, size: Column) -> Column:
    """struct(ok, first, last): a requested range held against a file's size; an open end is the last byte."""
    end = F.least(F.coalesce(last, size - 1), size - 1)
    ok = (first >= 0) & (first < size) & (end >= first)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, first).alias("first"), F.when(ok, end).alias("last"))


def connection(satisfied: Column, cellular: Column, expensive: Column, constrained: Column) -> Column:
    return F.when(~satisfied, "offline").when(constrained, "constrained").when(cellular | expensive, "metered").otherwise("free")


def unmapped_reason(nearest: Column, far: float = 15.0, captured: float = 25.0) -> Column:
    return F.when(nearest.isNull(), "noRoad").when(nearest > captured, "far").when(nearest > far, "unmapped")


def level_allows(own: Column, other: Column, within_hops: Column) -> Column:
    return own.isNull() | (own == other) | within_hops


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """A setting brought into its range; null and NaN become the default."""
    good = F.when(~F.isnan(value), value)
    return F.coalesce(F.when(good < low, F.lit(low)).when(good > high, F.lit(high)).otherwise(good), F.lit(default))


def pin_sigma(span: Column) -> Column:
    return F.greatest(F.lit(30.0), F.coalesce(span / 12, F.lit(30.0)))


def network_temper(seconds: Column, correlation: float = 60.0) -> Column:
    return F.least(F.lit(1.0), F.coalesce(seconds / correlation, F.lit(1.0)))


def yaw_rate(r: tuple, g: tuple) -> Column:
    """Rotation about gravity; null where gravity is too small to tell."""
    size = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
    return F.when(size > 0.5, (r[0] * g[0] + r[1] * g[1] + r[2] * g[2]) / size)


def prior_age(wall: Column, uptime: Column, same_boot: Column, skew: float = 5.0) -> Column:
    """Age of a saved state: the longer of both clocks within one boot; a small negative is 0, a large one unknown."""
    age = F.when(same_boot, F.greatest(wall, uptime)).otherwise(wall)
    return F.when(age >= 0, age).when(age >= -skew, F.lit(0.0))


def first_invalid(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first failed check, or null."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return out


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, constant outside."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, u), (b, v) in zip(points, points[1:]):
        out = out.when(x <= b, u + (x - a) * (v - u) / (b - a))
    return out.otherwise(F.lit(points[-1][1]))


# fixed values: kinds of events that reach the live engine
TAPPED = ["motion", "location", "obd", "manualFix", "gpsSwitch"]


def tapped(kind: Column) -> Column:
    return F.coalesce(kind.isin(TAPPED), F.lit(False))


def stopped(kmh: Column, reply: Column, now: Column, fresh: float = 2.0) -> Column:
    """Speed 0 from a fresh reply; an old 0 is unknown, not stopped."""
    return F.coalesce((kmh == 0) & (now - reply <= fresh), F.lit(False))


def update_available(installed: Column, offered: Column) -> Column:
    return F.coalesce(installed != offered, F.lit(False))


def needs_refresh(fetched: Column, now: Column, interval: int = 24 * 60 * 60) -> Column:
    """Never fetched, a day or more ago, or in the future (the clock was set back)."""
    age = now - fetched
    return fetched.isNull() | (age < 0) | (age >= interval)


def may_start(free: Column, warning: Column) -> Column:
    return free >= warning


def restore_class(awaiting: Column, parked: Column, engine_off: Column, prior: Column, kmh: Column, vetoed: Column, age: Column, zero_for: Column, prior_run: Column, max_age: float, least: float) -> Column:
    """parked, standingStop or moving. ``awaiting``: no reply yet since a restored prior (of class ``prior``); ``parked``: parked
    since a zero; ``zero_for``: length of the run of zeros; ``prior_run``: whether that run continues the prior's stop."""
    still = F.coalesce((kmh == 0) & ~vetoed, F.lit(False))
    fresh = age <= max_age
    stands = fresh & (prior_run | (zero_for >= least))
    return (
        F.when(awaiting, F.when(~parked, "moving").when(engine_off, "parked").otherwise(prior))
        .when(~still, "moving").when(engine_off | (~fresh & parked), "parked").when(F.coalesce(stands, F.lit(False)), "standingStop").otherwise("moving")
    )


def refused_flags(given: Column, refused: list[str]) -> Column:
    """Those of ``given`` that are refused, each once, in the order given."""
    return F.array_distinct(F.filter(given, lambda x: x.isin(refused)))


def missing_of(wanted: Column, present: Column) -> Column:
    return F.array_except(wanted, present)


def strict_superset(new: Column, old: Column) -> Column:
    return (F.size(F.array_except(old, new)) == 0) & (F.size(F.array_except(new, old)) > 0)
