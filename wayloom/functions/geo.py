"""Geometry and angle expressions over columns: no UDF, so they stay inside whole-stage codegen.

Angles are radians unless a name says otherwise; positions are metres east and north of an anchor, or degrees.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

# fixed values: WGS-84 and the 95 % quantile of chi-square with two degrees of freedom
SEMI_MAJOR = 6378137.0
ECCENTRICITY2 = 6.69437999014e-3
CHI2_95 = 5.991


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def meridian_radius(lat_deg) -> Column:
    s = F.sin(F.radians(_c(lat_deg)))
    w = 1 - ECCENTRICITY2 * s * s
    return SEMI_MAJOR * (1 - ECCENTRICITY2) / (w * F.sqrt(w))


def prime_vertical_radius(lat_deg) -> Column:
    s = F.sin(F.radians(_c(lat_deg)))
    return SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY2 * s * s)


def wrap_degrees(d: Column) -> Column:
    """A difference of longitudes brought back to one turn."""
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def enu(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """(east, north) of a position about an anchor."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    north = F.radians(lat - lat0) * meridian_radius(lat0)
    east = F.radians(wrap_degrees(lon - lon0)) * prime_vertical_radius(lat) * F.cos(F.radians(lat))
    return east, north


def geodetic(east, north, lat0, lon0) -> tuple[Column, Column]:
    """(lat, lon) of a point of the anchor's plane."""
    east, north, lat0, lon0 = map(_c, (east, north, lat0, lon0))
    lat = lat0 + F.degrees(north / meridian_radius(lat0))
    lon = lon0 + F.degrees(east / (prime_vertical_radius(lat) * F.cos(F.radians(lat))))
    return lat, wrap_degrees(lon)


def metres_per_e7(lat_deg) -> tuple[Column, Column]:
    """(north-south, east-west) metres of 1e-7 degree."""
    unit = pi / 180 / 1e7
    return meridian_radius(lat_deg) * unit, prime_vertical_radius(lat_deg) * F.cos(F.radians(_c(lat_deg))) * unit


def offset_e7(lat_a, lon_a, lat_b, lon_b) -> tuple[Column, Column]:
    """(east, north) from a to b, both in 1e-7 degrees, at the scale of the middle latitude."""
    lat_a, lon_a, lat_b, lon_b = (_c(x) for x in (lat_a, lon_a, lat_b, lon_b))
    k_lat, k_lon = metres_per_e7((lat_a.cast("double") + lat_b.cast("double")) / 2e7)
    return (lon_b.cast("long") - lon_a.cast("long")) * k_lon, (lat_b.cast("long") - lat_a.cast("long")) * k_lat


def distance_e7(lat_a, lon_a, lat_b, lon_b) -> Column:
    e, n = offset_e7(lat_a, lon_a, lat_b, lon_b)
    return F.sqrt(e * e + n * n)


def bearing(east, north) -> Column:
    """Clockwise from north, 0 up to a full turn."""
    b = F.atan2(_c(east), _c(north))
    return F.when(b < 0, b + 2 * pi).otherwise(b)


def wrap_pi(angle) -> Column:
    """Into (-pi, pi], by the remainder that keeps the sign."""
    a = _c(angle) % F.lit(2 * pi)
    return F.when(a > pi, a - 2 * pi).when(a <= -pi, a + 2 * pi).otherwise(a)


def wrap_2pi(angle) -> Column:
    a = F.pmod(_c(angle), F.lit(2 * pi))
    return F.when(a >= 2 * pi, F.lit(0.0)).otherwise(a)


def heading_difference(heading, segment_bearing, oneway) -> Column:
    """Between a heading and a segment; one that runs both ways may be met from either end."""
    forward = F.abs(wrap_pi(_c(heading) - _c(segment_bearing)))
    return F.when(_c(oneway), forward).otherwise(F.least(forward, pi - forward))


def project(px, py, ax, ay, bx, by) -> Column:
    """struct(d2, t, qx, qy) of the nearest point of segment a-b; a zero-length segment is its first end."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(F.lit(0.0))
    qx, qy = ax + t * dx, ay + t * dy
    return F.struct(((px - qx) * (px - qx) + (py - qy) * (py - qy)).alias("d2"), t.alias("t"), qx.alias("qx"), qy.alias("qy"))


def nearest_on_segment(px, py, ax, ay, bx, by) -> Column:
    """struct(qx, qy, distance, ux, uy, across): the nearest point of a segment, the segment's unit vector and the point's signed distance
    from its line (positive to the right of a-b). A segment without length points north."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    ux, uy = F.when(length > 0, (bx - ax) / length).otherwise(0.0), F.when(length > 0, (by - ay) / length).otherwise(1.0)
    along = F.least(F.greatest((px - ax) * ux + (py - ay) * uy, F.lit(0.0)), length)
    qx, qy = ax + along * ux, ay + along * uy
    return F.struct(qx.alias("qx"), qy.alias("qy"), F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)).alias("distance"), ux.alias("ux"), uy.alias("uy"), ((px - ax) * uy - (py - ay) * ux).alias("across"))


def segment_rectangle_d2(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """Squared distance of segment a-b and a rectangle; 0 where they touch.

    They touch if the parts of the segment within both slabs overlap; else the distance is from one of its ends to the
    rectangle or from a corner to the segment."""
    ax, ay, bx, by, x0, y0, x1, y1 = map(_c, (ax, ay, bx, by, x0, y0, x1, y1))
    dx, dy = bx - ax, by - ay

    def slab(a, d, low, high):
        """(from, to) along the segment within [low, high] of one axis; empty is (1, 0)."""
        p, q = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
        flat = a.between(low, high)
        return F.when(d != 0, F.least(p, q)).when(flat, 0.0).otherwise(1.0), F.when(d != 0, F.greatest(p, q)).when(flat, 1.0).otherwise(0.0)

    (u0, u1), (v0, v1) = slab(ax, dx, x0, x1), slab(ay, dy, y0, y1)
    meets = F.greatest(u0, v0, F.lit(0.0)) <= F.least(u1, v1, F.lit(1.0))
    zero = F.lit(0.0)
    ends = [F.pow(F.greatest(zero, x0 - x, x - x1), 2) + F.pow(F.greatest(zero, y0 - y, y - y1), 2) for x, y in ((ax, ay), (bx, by))]
    n = F.nullif(dx * dx + dy * dy, zero)
    corners = []
    for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)):
        t = F.least(F.lit(1.0), F.greatest(zero, F.coalesce(((x - ax) * dx + (y - ay) * dy) / n, zero)))
        corners.append(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2))
    return F.when(meets, zero).otherwise(F.least(*ends, *corners))


def cell(v, size: float) -> Column:
    """Grid cell of a coordinate, held within 32 bits."""
    f = F.floor(_c(v) / size)
    return F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), f)).cast("long")


def cell_key(cx, cy) -> Column:
    """Both cells' 32-bit patterns in one long: y above x."""
    return F.shiftleft(_c(cy).cast("long"), 32).bitwiseOR(_c(cx).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def cell_of_key(key) -> tuple[Column, Column]:
    low = _c(key).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low), F.shiftright(_c(key), 32)


def ellipse(ee, en, nn) -> Column:
    """struct(major, minor, orientation) of the 95 % ellipse of a covariance; the bearing in degrees, [0, 180)."""
    ee, en, nn = map(_c, (ee, en, nn))
    mean, half = (ee + nn) / 2, (ee - nn) / 2
    radius = F.sqrt(half * half + en * en)
    theta = 0.5 * F.atan2(2 * en, ee - nn)
    b = (90 - F.degrees(theta)) % 180
    return F.struct(
        F.sqrt(CHI2_95 * F.greatest(mean + radius, F.lit(0.0))).alias("major"),
        F.sqrt(CHI2_95 * F.greatest(mean - radius, F.lit(0.0))).alias("minor"),
        F.when(b < 0, b + 180).otherwise(b).alias("orientation"),
    )


def in_ellipse(major, minor, orientation, east, north) -> Column:
    major, minor, east, north = map(_c, (major, minor, east, north))
    b = F.radians(_c(orientation))
    along, across = east * F.sin(b) + north * F.cos(b), north * F.sin(b) - east * F.cos(b)
    small = F.greatest(minor, F.lit(1e-9))
    inside = (along / major) * (along / major) + (across / small) * (across / small) <= 1
    return F.when(major > 0, inside).otherwise((along == 0) & (across == 0))


def ellipse_covariance(major, minor, orientation) -> Column:
    """struct(ee, en, nn) of a 95 % ellipse."""
    b = F.radians(_c(orientation))
    a2, b2 = _c(major) * _c(major) / CHI2_95, _c(minor) * _c(minor) / CHI2_95
    s, c = F.sin(b), F.cos(b)
    return F.struct((a2 * s * s + b2 * c * c).alias("ee"), ((a2 - b2) * s * c).alias("en"), (a2 * c * c + b2 * s * s).alias("nn"))


def widened(axis, sigma) -> Column:
    """An ellipse's axis after adding an isotropic deviation."""
    return F.sqrt(_c(axis) * _c(axis) + CHI2_95 * _c(sigma) * _c(sigma))


def ellipse_support(major, minor, orientation, normal_east, normal_north) -> Column:
    """Half width of an ellipse along a unit normal."""
    b = F.radians(_c(orientation))
    along = _c(normal_east) * F.sin(b) + _c(normal_north) * F.cos(b)
    across = -_c(normal_east) * F.cos(b) + _c(normal_north) * F.sin(b)
    return F.sqrt(F.pow(_c(major) * along, 2) + F.pow(_c(minor) * across, 2))


def chi2(east, north, ee, en, nn) -> Column:
    """Squared Mahalanobis distance; infinite where the covariance has no inverse."""
    east, north, ee, en, nn = map(_c, (east, north, ee, en, nn))
    det = ee * nn - en * en
    return F.when(det > 0, (east * east * nn - 2 * east * north * en + north * north * ee) / det).otherwise(F.lit(float("inf")))


def ou_transition(dt, sigma, tau) -> Column:
    """struct(decay, sigma_end): of an Ornstein-Uhlenbeck error over dt seconds."""
    x = -_c(dt) / _c(tau)
    return F.struct(F.exp(x).alias("decay"), (_c(sigma) * F.sqrt(-F.expm1(2 * x))).alias("sigma_end"))


def angle_difference(a, b, period: float) -> Column:
    d = F.abs(_c(a) - _c(b)) % period
    return F.least(d, period - d)


def shifted(lat, lon, metres, bearing_deg) -> tuple[Column, Column]:
    """A position moved by a distance along a bearing."""
    b = F.radians(_c(bearing_deg))
    return geodetic(_c(metres) * F.sin(b), _c(metres) * F.cos(b), lat, lon)


def ellipse_ring(major, minor, orientation, points: int = 36) -> Column:
    """array of (east, north) around an ellipse, closed."""
    b = F.radians(_c(orientation))

    def at(k: Column) -> Column:
        a = k * (2 * pi / points)
        u, v = _c(major) * F.cos(a), _c(minor) * F.sin(a)
        return F.struct((u * F.sin(b) - v * F.cos(b)).alias("east"), (u * F.cos(b) + v * F.sin(b)).alias("north"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), at)
