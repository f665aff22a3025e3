"""Scalar rules of motion, priors and display: column expressions. Null in is null out, unless a rule says otherwise."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

from . import geo as G, replies as P

_c = lambda x: x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def ou_coefficients(dt, sigma, tau) -> Column:
    """struct(decay, sigma_end, gain, on_end, own): the exact step of a speed error dX = -X / tau dt + sigma dW over dt and of its
    integral: X' = decay X + sigma_end n1, I = gain X + on_end n1 + own n2. A tau of 0 or less is a random walk."""
    dt, sigma, tau = map(_c, (dt, sigma, tau))
    s2, a = sigma * sigma, -F.expm1(-dt / F.nullif(tau, F.lit(0.0)))  # a: one less the decay
    a2 = a * (2 - a)
    real = tau > 0
    pick = lambda x, walk: F.when(real, x).otherwise(walk)
    end = F.sqrt(F.greatest(F.lit(0.0), pick(s2 * tau / 2 * a2, s2 * dt)))
    both = pick(s2 * tau * tau / 2 * a * a, s2 * dt * dt / 2)
    on_end = F.when(end > 0, both / end).otherwise(0.0)
    whole = pick(s2 * tau * tau * (dt - 2 * tau * a + tau / 2 * a2), s2 * dt * dt * dt / 3)
    own = F.sqrt(F.greatest(F.lit(0.0), whole - on_end * on_end))
    return F.struct(pick(1 - a, F.lit(1.0)).alias("decay"), end.alias("sigma_end"), pick(tau * a, dt).alias("gain"), on_end.alias("on_end"), own.alias("own"))


def position_update(east, north, ee, en, nn, z_east, z_north, variance) -> Column:
    """struct(east, north, ee, en, nn, log_likelihood, chi2): a Kalman update of a position by an isotropic measurement; the likelihood
    is without its constant."""
    east, north, ee, en, nn, ze, zn, r = map(_c, (east, north, ee, en, nn, z_east, z_north, variance))
    see, snn = ee + r, nn + r
    det = see * snn - en * en
    iee, inn, ien = snn / det, see / det, -en / det
    de, dn = ze - east, zn - north
    chi2 = de * (iee * de + ien * dn) + dn * (ien * de + inn * dn)
    kee, ken, kne, knn = ee * iee + en * ien, ee * ien + en * inn, en * iee + nn * ien, en * ien + nn * inn
    return F.struct(
        (east + kee * de + ken * dn).alias("east"), (north + kne * de + knn * dn).alias("north"), (ee - (kee * ee + ken * en)).alias("ee"), (en - (kee * en + ken * nn)).alias("en"), (nn - (kne * en + knn * nn)).alias("nn"),
        (-0.5 * chi2 - 0.5 * F.log(det)).alias("log_likelihood"), chi2.alias("chi2"),
    )


def cross_track_update(paa, pac, pcc, distance, rw, coupling) -> Column:
    """struct(da, dc, paa, pac, pcc): an update across a road, whose gain along it is scaled by ``coupling``: 0 none, 1 the full one."""
    paa, pac, pcc, d, rw, k = map(_c, (paa, pac, pcc, distance, rw, coupling))
    sw = pcc + rw
    kc, ka = pcc / sw, k * pac / sw
    left = 1 - kc
    return F.struct(
        F.when(k == 0, 0.0).otherwise(-ka * d).alias("da"), (-kc * d).alias("dc"), F.when(k == 0, paa).otherwise(paa - 2 * ka * pac + ka * ka * sw).alias("paa"),
        F.when(k == 0, pac * left).otherwise((pac - ka * pcc) * left + ka * kc * rw).alias("pac"), (left * left * pcc + kc * kc * rw).alias("pcc"),
    )


def worst_scale(low_lat, high_lat, k_lat, k_lon) -> Column:
    """The most by which a frame of fixed metres per 1e-7 degree stretches the truth between two latitudes; 1 at least."""
    low, high = _c(low_lat), _c(high_lat)

    def at(lat: Column) -> Column:
        lat = F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat))
        north, east = G.metres_per_e7(lat)
        return F.greatest(_c(k_lat) / north, _c(k_lon) / east)

    return F.greatest(F.lit(1.0), at(low), at(high), F.when((low < 0) & (high > 0), at(F.lit(0.0))))


# fixed values: slack of a search radius, relative and in metres
_RELATIVE, _ABSOLUTE = 1e-3, 0.05


def effective_radius(radius: float, size: float, low_lat, high_lat, k_lat, k_lon) -> Column:
    """A search radius in the frame that holds all within ``radius`` true metres, for points up to a cell and the radius beyond the data."""
    margin = (size + 2 * radius) / 100_000
    return radius * worst_scale(_c(low_lat) - margin, _c(high_lat) + margin, k_lat, k_lon) * (1 + _RELATIVE) + _ABSOLUTE


def half_extents(major, minor, orientation, heading) -> tuple[Column, Column]:
    """(across, along): half the box of an ellipse in a frame turned to a heading."""
    a, b, turn = _c(major), _c(minor), F.radians(_c(orientation) - _c(heading))
    s, c = F.sin(turn), F.cos(turn)
    return F.sqrt(a * a * s * s + b * b * c * c), F.sqrt(a * a * c * c + b * b * s * s)


# fixed values: largest axis and span, margin, least room (points)
_MAX_AXIS, _MAX_SPAN, _MARGIN, _ROOM = 4000.0, 8000.0, 1.1, 40.0


def required_span(major, minor, orientation, heading, from_top, width, height, top, leading, bottom, trailing) -> Column:
    """The map's height in metres in which an ellipse about the car fits; 0 where a number isn't finite or there is no room."""
    major, minor, from_top, width, height = map(_c, (major, minor, from_top, width, height))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    a = F.least(F.greatest(major, F.lit(0.0)), F.lit(_MAX_AXIS))
    b = F.least(F.greatest(F.when(finite(minor), minor).otherwise(a), F.lit(0.0)), a)
    across, along = half_extents(a, b, orientation, heading)
    half_width = F.greatest(F.least(width / 2 - leading, width / 2 - trailing), F.lit(_ROOM))
    half_height = F.least(F.greatest(height * from_top - top, F.lit(_ROOM)), F.greatest(height * (1 - from_top) - bottom, F.lit(_ROOM)))
    ok = finite(major) & finite(_c(orientation)) & finite(_c(heading)) & finite(from_top) & (width > 0) & (height > 0)
    return F.when(ok, F.least(F.greatest(across / half_width, along / half_height) * _MARGIN * height, F.lit(_MAX_SPAN))).otherwise(0.0)


#: Accuracy of a clean fix in standard deviations of one axis.
ACCURACY_PER_SIGMA = 1.51


def truth_sigma(kind: Column, sigma: Column) -> Column:
    """A truth's deviation on each axis: a clean fix gives its accuracy, others theirs; 0 where there is none."""
    sound = (sigma > 0) & (sigma < float("inf"))
    return F.when(sound, F.when(kind == "cleanFix", sigma / ACCURACY_PER_SIGMA).otherwise(sigma)).otherwise(0.0)


def stale_growth(age: Column, speed: Column, after: float, rate: float) -> Column:
    """Metres by which an old fix's deviation grows: with its own speed, where valid, or a least rate; 0 for a fresh one."""
    own = F.when(F.coalesce((speed >= 0) & (speed < float("inf")), F.lit(False)), speed).otherwise(0.0)
    return F.when((age > after) & F.lit(rate > 0), F.greatest(F.lit(rate), own) * age).otherwise(0.0)


def initial_speed(fresh: Column, doppler: Column) -> Column:
    """The fresh speed of the vehicle, else the fix's own where valid, else 0."""
    return F.coalesce(fresh, F.when((doppler >= 0) & (doppler < float("inf")), doppler), F.lit(0.0))


# fixed values: what a prior gains by class and gap
PARKED_M, STANDING_M, STOPPED_DEG, MOVING_MPS, UNIFORM_AFTER_S, TURN_DEG_S, SHIFT_GAP_S, UNIFORM_ABOVE_DEG, MOST_SIGMA_M = 10.0, 50.0, 3.0, 11.1, 5.0, 5.5, 5.0, 30.0, 1500.0


def restored_seed(kind: Column, moving_at_start: Column, gap: Column, ee: Column, en: Column, nn: Column, heading: Column, heading_std: Column, speed: Column) -> Column:
    """struct(ee, en, nn, heading, heading_sigma, shift_east, shift_north) of a prior after ``gap`` seconds, null where it is
    too wide to use: a moving one grows by its speed and is moved on for a short gap, a parked or standing one only so far. A null
    heading (in radians) is a uniform one."""
    g = F.greatest(F.lit(0.0), gap)
    moving = (kind == "moving") | moving_at_start
    drift, turn = F.greatest(speed, F.lit(MOVING_MPS)) * g, TURN_DEG_S * g
    add = F.when(moving, drift).otherwise(F.least(F.when(kind == "parked", PARKED_M).otherwise(STANDING_M), drift))
    wide = lambda x: F.sqrt(heading_std * heading_std + x * x)
    sigma = F.when(moving, F.when(g <= UNIFORM_AFTER_S, wide(turn))).otherwise(wide(F.least(F.lit(STOPPED_DEG), turn)))
    sigma = F.when(sigma <= UNIFORM_ABOVE_DEG, sigma)
    shift = F.when(moving & (g <= SHIFT_GAP_S) & sigma.isNotNull(), speed * g).otherwise(0.0)
    e, n, h = ee + add * add, nn + add * add, heading * (pi / 180)
    major = F.sqrt(F.greatest(F.lit(0.0), (e + n) / 2 + F.sqrt((e - n) / 2 * ((e - n) / 2) + en * en)))
    known = sigma.isNotNull()
    return F.when(major <= MOST_SIGMA_M, F.struct(e.alias("ee"), en.alias("en"), n.alias("nn"), F.when(known, h).alias("heading"), (sigma * (pi / 180)).alias("heading_sigma"), (shift * F.sin(h)).alias("shift_east"), (shift * F.cos(h)).alias("shift_north")))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def display_heading(degrees: Column) -> Column:
    r = F.pmod(degrees, F.lit(360.0))
    return F.when(r >= 360, 0.0).otherwise(r)


def shortest_turn(start: Column, end: Column) -> Column:
    """From one heading to another, in (-180, 180]."""
    d = (end - start) % 360.0
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def display_speed(kmh: Column) -> Column:
    fine = kmh.isNotNull() & ~F.isnan(kmh) & (F.abs(kmh) < float("inf"))
    return F.when(fine, F.floor(F.greatest(F.lit(0.0), kmh) + 0.5).cast("long").cast("string")).otherwise("--")


def display_elapsed(seconds: Column) -> Column:
    total = F.greatest(F.lit(0), F.coalesce(F.when(~F.isnan(seconds) & (F.abs(seconds) < float("inf")), seconds).cast("long"), F.lit(0)))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def display_bytes(count: Column) -> Column:
    """Decimal units: whole bytes and kB, one digit of MB, two of GB."""
    n = F.greatest(F.lit(0).cast("long"), count)
    shown = lambda unit, digits, name: F.concat(F.format_string(f"%.{digits}f", F.bround(n / float(unit), digits)), F.lit(" " + name))
    return F.when(n < 1000, F.concat(n.cast("string"), F.when(n == 1, " byte").otherwise(" bytes"))).when(n < 999_500, shown(10**3, 0, "kB")).when(n < 999_950_000, shown(10**6, 1, "MB")).otherwise(shown(10**9, 2, "GB"))


def recording_file(start: Column, zone: Column, copy: Column) -> Column:
    """``Drive_<local time>.jsonl.gz`` of a start (UTC timestamp) in a time zone; later files of one second are numbered from 2."""
    stamp = F.date_format(F.from_utc_timestamp(start, zone), "yyyyMMdd-HHmmss")
    return F.concat(F.lit("Drive_"), stamp, F.when(copy > 1, F.concat(F.lit("_"), copy.cast("string"))).otherwise(""), F.lit(".jsonl.gz"))


# fixed values: protocols with 11-bit CAN headers
ELEVEN_BIT = ("6", "A6", "8", "A8")


def addressing_cause(protocol: Column, supported: Column) -> Column:
    """Why requests can't be sent to one unit only, or null: the protocol's headers, or no answer of the engine's unit."""
    number = F.upper(F.regexp_replace(protocol, r"(?U)\s", ""))
    replies = F.coalesce(P.scan_replies(supported)["replies"], F.array().cast("array<struct<header:string,bytes:string>>"))
    there = F.exists(replies, lambda r: (r.header == "7E8") & r["bytes"].startswith("4100"))
    return F.when(~number.isin(*ELEVEN_BIT), F.concat(F.lit("protocol "), protocol, F.lit(" is not 11-bit ISO 15765-4 CAN (6, A6, 8, A8)"))).when(~there, "no 7E8 reply to 0100")


def fix_verdict(lat: Column, lon: Column, accuracy: Column, wait: Column, age: Column, after_request: Column, most_accuracy: float, most_wait: float, most_age: float) -> Column:
    """noFix (null latitude), invalidPosition, inaccurate, late, stale or usable: the first that holds. NaN fails its test."""
    within = lambda x, low, high: F.coalesce(~F.isnan(x) & x.between(low, high), F.lit(False))
    return (
        F.when(lat.isNull(), "noFix").when(~(within(lat, -90, 90) & within(lon, -180, 180)), "invalidPosition").when(~within(accuracy, 0, most_accuracy), "inaccurate")
        .when(~within(wait, 0, most_wait), "late").when(~F.coalesce(after_request & ~F.isnan(age) & (age <= most_age), F.lit(False)), "stale").otherwise("usable")
    )


def manual_gate(kmh: Column, kmh_age: Column, speed: Column, speed_accuracy: Column, accuracy: Column, fix_age: Column, most_kmh_age: float = 2.0, most_fix_age: float = 5.0, most_accuracy: float = 100.0) -> Column:
    """struct(source, kmh) that a manual fix may be judged by: the vehicle's speed while fresh, else a sound and fresh fix's, else unknown."""
    vehicle = ~F.isnan(kmh) & (F.abs(kmh) < float("inf")) & (kmh_age <= most_kmh_age)
    fix = (speed >= 0) & (speed < float("inf")) & (speed_accuracy >= 0) & accuracy.between(0, most_accuracy) & (fix_age <= most_fix_age)
    return F.when(vehicle, F.struct(F.lit("obd").alias("source"), kmh.alias("kmh"))).when(fix, F.struct(F.lit("gps").alias("source"), (speed * 3.6).alias("kmh"))).otherwise(F.struct(F.lit("unknown").alias("source"), F.lit(None).cast("double").alias("kmh")))
