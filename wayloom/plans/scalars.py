"""Queries of the scalar functions, over columns derived from the event log by fixed arithmetic."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import rules as R
from ..functions import text as T
from .base import events, fixes, query, table

_A, _E2 = 6378137.0, 6.69437999014e-3


def _M(lat):
    return f"({_A} * (1 - {_E2}) / pow(1 - {_E2} * pow(sin(radians({lat})), 2), 1.5))"


def _N(lat):
    return f"({_A} / sqrt(1 - {_E2} * pow(sin(radians({lat})), 2)))"


@query("geo_plane", f"""
WITH e AS (SELECT session, line_no, lat, lon, radians(lat - 50.05) * {_M(50.05)} AS north, radians(lon - 30.0) * {_N('lat')} * cos(radians(lat)) AS east FROM @fix )
SELECT session, line_no, round(east, 4) AS east, round(north, 4) AS north, round(lat, 9) AS back_lat, round(lon, 9) AS back_lon,
  round({_M('lat')} * {pi} / 180 / 1e7, 9) AS per_lat, round({_N('lat')} * cos(radians(lat)) * {pi} / 180 / 1e7, 9) AS per_lon,
  round(CASE WHEN atan2(east, north) < 0 THEN atan2(east, north) + 2 * pi() ELSE atan2(east, north) END, 8) AS bearing FROM e""")
def geo_plane(spark, sf):
    east, north = G.enu("lat", "lon", 50.05, 30.0)
    f = fixes(spark, sf).withColumns({"east": east, "north": north})
    lat, lon = G.geodetic("east", "north", 50.05, 30.0)
    k_lat, k_lon = G.metres_per_e7("lat")
    return f.select("session", "line_no", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round(lat, 9).alias("back_lat"), F.round(lon, 9).alias("back_lon"),
        F.round(k_lat, 9).alias("per_lat"), F.round(k_lon, 9).alias("per_lon"), F.round(G.bearing("east", "north"), 8).alias("bearing"))


@query("geo_angles", """
WITH a AS (SELECT line_no, (k - 50) * 0.37 AS x, k * 0.11 AS b, k % 2 = 0 AS one FROM @ev ),
w AS (SELECT *, CASE WHEN fmod(x, 2 * pi()) > pi() THEN fmod(x, 2 * pi()) - 2 * pi() WHEN fmod(x, 2 * pi()) <= -pi() THEN fmod(x, 2 * pi()) + 2 * pi() ELSE fmod(x, 2 * pi()) END AS w,
  CASE WHEN fmod(x - b, 2 * pi()) > pi() THEN fmod(x - b, 2 * pi()) - 2 * pi() WHEN fmod(x - b, 2 * pi()) <= -pi() THEN fmod(x - b, 2 * pi()) + 2 * pi() ELSE fmod(x - b, 2 * pi()) END AS d FROM a)
SELECT line_no, round(w, 8) AS wrapped, round(x - 2 * pi() * floor(x / (2 * pi())), 8) AS turn, round(CASE WHEN one THEN abs(d) ELSE least(abs(d), pi() - abs(d)) END, 8) AS difference,
  round(least(fmod(abs(x * 57), 180.0), 180 - fmod(abs(x * 57), 180.0)), 6) AS modulo FROM w""")
def geo_angles(spark, sf):
    k = F.col("k")
    a = events(spark, sf).select("line_no", ((k - 50) * 0.37).alias("x"), (k * 0.11).alias("b"), (k % 2 == 0).alias("one"))
    return a.select("line_no", F.round(G.wrap_pi("x"), 8).alias("wrapped"), F.round(G.wrap_2pi("x"), 8).alias("turn"), F.round(G.heading_difference("x", "b", "one"), 8).alias("difference"),
        F.round(G.angle_difference(F.col("x") * 57, 0.0, 180.0), 6).alias("modulo"))


_P = """WITH s AS (SELECT line_no, k * 1.5 AS px, value / 4 AS py, 10.0 + k % 9 AS ax, 5.0 + k % 4 AS ay, CASE WHEN k % 11 = 0 THEN 10.0 + k % 9 ELSE 60.0 END AS bx, CASE WHEN k % 11 = 0 THEN 5.0 + k % 4 ELSE 40.0 - k % 13 END AS by_ FROM @ev ),
t AS (SELECT *, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) > 0 THEN least(1.0, greatest(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) ELSE 0.0 END AS t FROM s)"""


def _segments(spark, sf):
    k = F.col("k")
    one = k % 11 == 0
    ax, ay = 10.0 + k % 9, 5.0 + k % 4
    return events(spark, sf).select("line_no", "k", (k * 1.5).alias("px"), (F.col("value") / 4).alias("py"), ax.alias("ax"), ay.alias("ay"), F.when(one, ax).otherwise(60.0).alias("bx"), F.when(one, ay).otherwise(40.0 - k % 13).alias("by"))


@query("segment_projection", _P + """
SELECT line_no, round(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2), 4) AS d2, round(t, 9) AS part, round(ax + t * (bx - ax), 6) AS qx, round(ay + t * (by_ - ay), 6) AS qy FROM t""")
def segment_projection(spark, sf):
    p = G.project("px", "py", "ax", "ay", "bx", "by")
    return _segments(spark, sf).withColumn("p", p).select("line_no", F.round("p.d2", 4).alias("d2"), F.round("p.t", 9).alias("part"), F.round("p.qx", 6).alias("qx"), F.round("p.qy", 6).alias("qy"))


@query("segment_rectangle", _P + """,
e(cx, cy, dx, dy) AS (VALUES (30e0, 31e0, 14e0, 0e0), (30e0, 38e0, 14e0, 0e0), (30e0, 31e0, 0e0, 7e0), (44e0, 31e0, 0e0, 7e0)),
x AS (SELECT line_no, ax, ay, bx - ax AS ux, by_ - ay AS uy, e.*, (bx - ax) * dy - (by_ - ay) * dx AS det FROM t, e),
y AS (SELECT *, ((cx - ax) * dy - (cy - ay) * dx) / nullif(det, 0) AS p, ((cx - ax) * uy - (cy - ay) * ux) / nullif(det, 0) AS q, coalesce(least(1, greatest(0, ((cx - ax) * ux + (cy - ay) * uy) / nullif(ux * ux + uy * uy, 0))), 0) AS r, coalesce(least(1, greatest(0, ((cx + dx - ax) * ux + (cy + dy - ay) * uy) / nullif(ux * ux + uy * uy, 0))), 0) AS s FROM x),
m AS (SELECT line_no, least(
  min(CASE WHEN p BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1 THEN 0 ELSE least(pow(cx - ax - r * ux, 2) + pow(cy - ay - r * uy, 2), pow(cx + dx - ax - s * ux, 2) + pow(cy + dy - ay - s * uy, 2)) END),
  min(pow(greatest(0, 30 - ax, ax - 44), 2) + pow(greatest(0, 31 - ay, ay - 38), 2)), min(pow(greatest(0, 30 - ax - ux, ax + ux - 44), 2) + pow(greatest(0, 31 - ay - uy, ay + uy - 38), 2))) AS d2 FROM y GROUP BY line_no)
SELECT line_no, round(sqrt(d2), 6) AS distance, sqrt(d2) < 4.0 AS near FROM m""")
def segment_rectangle(spark, sf):
    """SQL takes the sides one by one (crossing, corners and ends)."""
    d = F.sqrt(G.segment_rectangle_d2("ax", "ay", "bx", "by", 30.0, 31.0, 44.0, 38.0))
    return _segments(spark, sf).select("line_no", F.round(d, 6).alias("distance"), (d < 4.0).alias("near"))


_ELL = """WITH c AS (SELECT line_no, 4e0 + k AS ee, (k - 50) * 3e-1 AS en, 900e0 / (1 + k) + 30 AS nn, (k % 17 - 8) * 2e0 AS de, (k % 23 - 11) * 15e-1 AS dn FROM @ev ),
m AS (SELECT *, (ee + nn) / 2 AS mean, sqrt(pow((ee - nn) / 2, 2) + en * en) AS rad, 90 - degrees(0.5 * atan2(2 * en, ee - nn)) AS b0 FROM c),
e AS (SELECT *, sqrt(5.991 * greatest(mean + rad, 0)) AS major, sqrt(5.991 * greatest(mean - rad, 0)) AS minor, b0 - 180 * floor(b0 / 180) AS b FROM m)"""


@query("error_ellipse", _ELL + """
SELECT line_no, round(major, 6) AS major, round(minor, 6) AS minor, round(b, 6) AS orientation, round(ee, 6) AS back_ee, round(en, 6) + 0.0 AS back_en, round(sqrt(major * major + 5.991 * 25), 6) AS wide,
  pow((de * sin(radians(b)) + dn * cos(radians(b))) / major, 2) + pow((dn * sin(radians(b)) - de * cos(radians(b))) / greatest(minor, 1e-9), 2) <= 1 AS inside,
  round(CASE WHEN ee * nn - en * en > 0 THEN (de * de * nn - 2 * de * dn * en + dn * dn * ee) / (ee * nn - en * en) END, 6) AS chi2,
  round(sqrt(pow(major * (0.6 * sin(radians(b)) + 0.8 * cos(radians(b))), 2) + pow(minor * (-0.6 * cos(radians(b)) + 0.8 * sin(radians(b))), 2)), 6) AS support FROM e
WHERE major > 0 AND minor > 0""")
def error_ellipse(spark, sf):
    k = F.col("k")
    c = events(spark, sf).select("line_no", (4.0 + k).alias("ee"), ((k - 50) * 0.3).alias("en"), (900.0 / (1 + k) + 30).alias("nn"), ((k % 17 - 8) * 2.0).alias("de"), ((k % 23 - 11) * 1.5).alias("dn"))
    e = c.withColumn("e", G.ellipse("ee", "en", "nn")).where("e.major > 0 and e.minor > 0")
    e = e.withColumn("v", G.ellipse_covariance("e.major", "e.minor", "e.orientation"))
    return e.select("line_no", F.round("e.major", 6).alias("major"), F.round("e.minor", 6).alias("minor"), F.round("e.orientation", 6).alias("orientation"), F.round("v.ee", 6).alias("back_ee"), (F.round("v.en", 6) + 0.0).alias("back_en"),
        F.round(G.widened("e.major", 5.0), 6).alias("wide"), G.in_ellipse("e.major", "e.minor", "e.orientation", "de", "dn").alias("inside"), F.round(G.chi2("de", "dn", "ee", "en", "nn"), 6).alias("chi2"),
        F.round(G.ellipse_support("e.major", "e.minor", "e.orientation", 0.6, 0.8), 6).alias("support"))


@query("grid_cells", """
WITH f AS (SELECT line_no, CAST(floor(((lon - 30.005) * 1e7) * 0.0071 / 64) AS BIGINT) AS cx, CAST(floor(((lat - 50.05) * 1e7) * 0.0111 / 64) AS BIGINT) AS cy FROM @fix )
SELECT line_no, cx, cy, (cy << 32) | (cx & 4294967295) AS cell_key FROM (SELECT line_no, cx, cy FROM f WHERE cy >= 0)
UNION ALL SELECT line_no, cx, cy, cy * 4294967296 + (cx & 4294967295) FROM f WHERE cy < 0""")
def grid_cells(spark, sf):
    f = fixes(spark, sf).select("line_no", G.cell(((F.col("lon") - 30.005) * 1e7) * 0.0071, 64).alias("cx"), G.cell(((F.col("lat") - 50.05) * 1e7) * 0.0111, 64).alias("cy"))
    f = f.withColumn("cell_key", G.cell_key("cx", "cy"))
    x, y = G.cell_of_key("cell_key")
    return f.select("line_no", x.alias("cx"), y.alias("cy"), "cell_key")


@query("motion_scalars", """
SELECT line_no, round(exp(-k / 20.0), 9) AS decay, round(2.5 * sqrt(1 - exp(-2 * k / 20.0)), 7) AS sigma_end, greatest(30.0, coalesce(CASE WHEN k % 3 > 0 THEN k * 20 / 12.0 END, 30.0)) AS pin_sigma,
  round(least(1.0, coalesce(CASE WHEN k % 4 > 0 THEN k / 60.0 END, 1.0)), 9) AS temper, round(CASE WHEN sqrt(0.01 * k % 7 * 0 + 1 + pow(k % 3, 2)) > 0.5 THEN (0.1 * k + (k % 5) * (k % 3)) / sqrt(1 + pow(k % 3, 2)) END, 8) AS yaw,
  CAST(CASE WHEN k - 60 >= 0 THEN k - 60 WHEN k - 60 >= -5 THEN 0 END AS DOUBLE) AS age, round(CASE WHEN k <= 10 THEN 300.0 WHEN k <= 50 THEN 300 + (k - 10) * 500.0 / 40 WHEN k <= 90 THEN 800 + (k - 50) * 1200.0 / 40 ELSE 2000.0 END, 6) AS zoom FROM @ev """)
def motion_scalars(spark, sf):
    k = F.col("k")
    ou = G.ou_transition(k, 2.5, 20.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return events(spark, sf).select("line_no", F.round(ou["decay"], 9).alias("decay"), F.round(ou["sigma_end"], 7).alias("sigma_end"), R.pin_sigma(F.when(k % 3 > 0, k * 20.0)).alias("pin_sigma"),
        F.round(R.network_temper(F.when(k % 4 > 0, k)), 9).alias("temper"), F.round(R.yaw_rate((0.1 * k, k % 5, zero), (one, k % 3, zero)), 8).alias("yaw"),
        R.prior_age((k - 60) * 1.0, (k - 60) * 1.0, k % 2 == 0).alias("age"), F.round(R.piecewise(k, [(10.0, 300.0), (50.0, 800.0), (90.0, 2000.0)]), 6).alias("zoom"))


@query("adapter_reply_decode", """
WITH r AS (SELECT line_no, k, CAST(least(floor(value), 255) AS INT) AS v, (ARRAY[4, 5, 12, 13, 15, 17, 47])[CAST(k % 7 + 1 AS INT)] AS pid FROM @ev )
SELECT line_no, CAST(pid AS BIGINT) AS pid, '41' || printf('%02X', pid) || printf('%02X', v) || CASE WHEN pid = 12 THEN printf('%02X', CAST(k AS INT)) ELSE '' END AS digits,
  round(CASE WHEN pid IN (4, 17, 47) THEN v * 100 / 255.0 WHEN pid IN (5, 15) THEN v - 40 WHEN pid = 12 THEN (v * 256 + k) / 4.0 ELSE v END, 6) AS measured,
  CASE WHEN pid IN (4, 17, 47) THEN '%' WHEN pid IN (5, 15) THEN 'degC' WHEN pid = 12 THEN 'rpm' ELSE 'km/h' END AS unit FROM r""")
def adapter_reply_decode(spark, sf):
    k, v = F.col("k"), F.col("v")
    h = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    e = events(spark, sf).withColumn("v", F.least(F.floor("value"), F.lit(255))).withColumn("pid", F.element_at(F.array(*map(F.lit, (4, 5, 12, 13, 15, 17, 47))), (k % 7 + 1).cast("int")))
    raw = F.concat(F.lit("SEARCHING...\r41 "), h(F.col("pid")), F.lit(" "), h(v), F.when(F.col("pid") == 12, F.concat(F.lit(" "), h(k))).otherwise(F.lit("")), F.lit("\r\r>"))
    e = e.withColumn("digits", T.frame_digits(raw))
    return e.select("line_no", F.col("pid").cast("long").alias("pid"), "digits", F.round(T.pid_value(F.col("pid"), F.substring("digits", 5, 8)), 6).alias("measured"), T.pid_unit(F.col("pid")).alias("unit"))


@query("multi_frame_reply", """
SELECT line_no, CASE WHEN k % 6 = 5 THEN NULL ELSE '410D' || printf('%02X', CAST(k AS INT)) || '0C' || printf('%02X', CAST(k AS INT)) || '10' || '05' || '50' END AS digits FROM @ev """)
def multi_frame_reply(spark, sf):
    """Frames out of order, put together by their index and cut to the declared length; too short is null."""
    h = F.lpad(F.hex(F.col("k")), 2, "0")
    length = F.when(F.col("k") % 6 == 5, "00F").otherwise("008")
    raw = F.concat(length, F.lit("\r1: 10 05 50 AA AA\r0: 41 0D "), h, F.lit(" 0C "), h, F.lit("\r>"))
    return events(spark, sf).select("line_no", T.frame_digits(raw).alias("digits"))


@query("multi_pid_walk", """
WITH w AS (SELECT line_no, k, CASE WHEN k % 5 = 0 THEN 'pid' WHEN k % 5 = 1 THEN 'truncated' END AS error FROM @ev )
SELECT line_no, CASE WHEN k % 5 = 0 THEN 1 WHEN k % 5 = 1 THEN 1 ELSE 3 END AS n, error, CAST(k AS DOUBLE) AS first_value, CASE WHEN k % 5 > 1 THEN (k * 256 + 4) / 4.0 END AS second_value FROM w""")
def multi_pid_walk(spark, sf):
    k = F.col("k")
    h = F.lpad(F.hex(k), 2, "0")
    tail = F.when(k % 5 == 0, "99FF").when(k % 5 == 1, "0C01").otherwise(F.concat(F.lit("0C"), h, F.lit("04"), F.lit("0555")))
    w = T.pid_walk(F.concat(F.lit("410D"), h, tail), [13, 12, 5])
    return events(spark, sf).withColumn("w", w).select("line_no", F.size("w.items").alias("n"), F.col("w.error").alias("error"), F.col("w.items")[0]["value"].alias("first_value"), F.when(k % 5 > 1, F.get("w.items", F.lit(1))["value"]).alias("second_value"))


@query("supported_pids", """
WITH m AS (SELECT line_no, k * 2654435761 % 4294967296 AS mask FROM @ev )
SELECT line_no, len(list_filter(generate_series(1, 32), lambda i: (mask >> (32 - i)) & 1 = 1)) AS n, list_sum(list_transform(list_filter(generate_series(1, 32), lambda i: (mask >> (32 - i)) & 1 = 1), lambda i: i + 32)) AS total FROM m WHERE mask > 0""")
def supported_pids(spark, sf):
    m = events(spark, sf).withColumn("mask", F.col("k") * 2654435761 % 4294967296).where("mask > 0")
    p = T.supported_pids(F.concat(F.lit("4120"), F.lpad(F.hex("mask"), 8, "0")))
    return m.withColumn("p", p).select("line_no", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).cast("decimal(38,0)").alias("total"))


@query("status_lines", """
WITH s AS (SELECT line_no, (ARRAY['NO DATA', 'unable to connect', 'STOPPED', '?', 'BUS INIT: ...ERROR', 'ERR94', '41 0D 20', 'CAN ERROR', 'BUFFER FULL', 'DATA ERROR', 'BUS ERROR', ' '])[CAST(k % 12 + 1 AS INT)] AS line FROM @ev )
SELECT line_no, line, CASE upper(replace(line, ' ', '')) WHEN 'NODATA' THEN 'noData' WHEN 'UNABLETOCONNECT' THEN 'unableToConnect' WHEN 'STOPPED' THEN 'stopped' WHEN 'BUSERROR' THEN 'busError' WHEN 'CANERROR' THEN 'canError'
  WHEN 'BUFFERFULL' THEN 'bufferFull' WHEN 'DATAERROR' THEN 'dataError' WHEN '?' THEN 'notRecognised' WHEN 'ERR94' THEN 'adapter' WHEN 'BUSINIT:...ERROR' THEN 'busInitFailed' END AS code FROM s""")
def status_lines(spark, sf):
    names = ["NO DATA", "unable to connect", "STOPPED", "?", "BUS INIT: ...ERROR", "ERR94", "41 0D 20", "CAN ERROR", "BUFFER FULL", "DATA ERROR", "BUS ERROR", " "]
    s = events(spark, sf).select("line_no", F.element_at(F.array(*map(F.lit, names)), (F.col("k") % 12 + 1).cast("int")).alias("line"))
    return s.select("line_no", "line", T.status_code(F.col("line")).alias("code"))


@query("command_guard", """
WITH c AS (SELECT line_no, (ARRAY['010D', '010D0C1', '01', '0104050C0D0F11', '0104050C0D0F1104', 'atz', 'ATMA', '03', 'AT RV', '010G', 'atrv', '010D0'])[CAST(k % 12 + 1 AS INT)] AS wire FROM @ev )
SELECT line_no, wire, wire IN ('010D', '010D0C1', '0104050C0D0F11', 'atz', 'atrv') AS session_ok, wire IN ('010D', '010D0C1', '0104050C0D0F11', 'atrv') AS manual_ok FROM c""")
def command_guard(spark, sf):
    names = ["010D", "010D0C1", "01", "0104050C0D0F11", "0104050C0D0F1104", "atz", "ATMA", "03", "AT RV", "010G", "atrv", "010D0"]
    c = events(spark, sf).select("line_no", F.element_at(F.array(*map(F.lit, names)), (F.col("k") % 12 + 1).cast("int")).alias("wire"))
    return c.select("line_no", "wire", T.allowed_command(F.col("wire")).alias("session_ok"), T.allowed_command(F.col("wire"), manual=True).alias("manual_ok"))


@query("pack_names", """
WITH p AS (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size % 5 = 0 THEN '_' ELSE '-' END) AS name, printf('%016x', p_partkey * 7919) AS hash FROM part)
SELECT p_partkey, CASE WHEN name NOT LIKE '%\\_%' ESCAPE '\\' THEN name || '-' || hash || '.roadpack' END AS file, CASE WHEN name NOT LIKE '%\\_%' ESCAPE '\\' THEN name END AS name, CASE WHEN name NOT LIKE '%\\_%' ESCAPE '\\' THEN hash END AS hash FROM p""")
def pack_names(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 5 == 0, "_").otherwise("-"))).withColumn("hash", F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919), 16, "0")))
    p = p.withColumn("file", T.pack_file(F.col("name"), F.col("hash"))).withColumn("parts", T.pack_file_parts(F.col("file")))
    return p.select("p_partkey", "file", F.col("parts.name").alias("name"), F.col("parts.hash").alias("hash"))


@query("http_fields", """
WITH h AS (SELECT line_no, k, k * 3 AS a, 150 AS b FROM @ev )
SELECT line_no, CASE WHEN a <= b THEN a END AS first_byte, CASE WHEN a <= b THEN b END AS last_byte, CASE WHEN a <= b AND k % 2 = 0 THEN 300 END AS total, k % 3 = 0 AS strong,
  CASE WHEN k = 0 THEN 'fresh' WHEN k = 60 THEN 'verifyOnly' WHEN k > 60 THEN 'discard' WHEN k % 2 = 0 THEN 'resume' ELSE 'discard' END AS plan,
  CASE k % 6 WHEN 0 THEN 'restart' WHEN 1 THEN CASE WHEN k % 4 = 1 THEN 'append' ELSE 'discard' END WHEN 2 THEN CASE WHEN k = 50 THEN 'verify' ELSE 'discard' END WHEN 3 THEN 'gone' WHEN 4 THEN 'retry' ELSE 'fail' END AS decision,
  k * 2 < 120 AS satisfiable, CASE WHEN k * 2 < 120 THEN least(k * 2 + 30, 119) END AS range_last FROM h""")
def http_fields(spark, sf):
    k = F.col("k")
    text = F.concat(F.lit("bytes "), (k * 3).cast("string"), F.lit("-150/"), F.when(k % 2 == 0, "300").otherwise("*"))
    etag = F.when(k % 3 == 0, F.lit('"abc"')).when(k % 3 == 1, F.lit('W/"abc"')).otherwise(F.lit("abc"))
    status = F.element_at(F.array(*map(F.lit, (200, 206, 416, 404, 503, 400))), (k % 6 + 1).cast("int"))
    e = events(spark, sf).withColumn("r", T.content_range(text)).withColumn("b", R.byte_range(k * 2, k * 2 + 30, F.lit(120).cast("long")))
    return e.select("line_no", F.col("r.first").alias("first_byte"), F.col("r.last").cast("int").alias("last_byte"), F.col("r.total").cast("int").alias("total"), T.strong_etag(etag).alias("strong"),
        R.download_plan(k, F.lit(60), F.when(k % 2 == 0, "x")).alias("plan"), R.status_decision(status, k, F.when(k % 4 == 1, k).otherwise(k + 1), F.lit(50), F.lit(50)).alias("decision"),
        F.col("b.ok").alias("satisfiable"), F.col("b.last").alias("range_last"))


@query("road_tag_rules", """
WITH o AS (SELECT o_orderkey, (ARRAY['motorway', 'primary_link', 'residential', 'footway', 'trunk', 'service'])[CAST(o_orderkey % 6 + 1 AS INT)] AS hw, (ARRAY['yes', '-1', NULL, 'no', '1'])[CAST(o_orderkey % 5 + 1 AS INT)] AS ow,
  (ARRAY['2', ' -7', 'x', NULL])[CAST(o_orderkey % 4 + 1 AS INT)] AS layer, (ARRAY['yes', 'no', NULL])[CAST(o_orderkey % 3 + 1 AS INT)] AS bridge, (ARRAY[NULL, 'yes'])[CAST(o_orderkey % 2 + 1 AS INT)] AS tunnel, (ARRAY['2', ' 3 ', '0', '999', 'a'])[CAST(o_orderkey % 5 + 1 AS INT)] AS lanes FROM orders)
SELECT o_orderkey, CASE replace(hw, '_link', '') WHEN 'motorway' THEN 1 WHEN 'trunk' THEN 2 WHEN 'primary' THEN 3 WHEN 'residential' THEN 7 WHEN 'service' THEN 9 END AS class, hw LIKE '%link' AS is_link,
  CASE WHEN ow IN ('yes', '1') THEN 'forward' WHEN ow = '-1' THEN 'reversed' WHEN ow IS NOT NULL THEN 'twoWay' WHEN hw = 'motorway' THEN 'implied' ELSE 'twoWay' END AS direction,
  CAST(CASE WHEN layer = '2' THEN 2 WHEN layer = ' -7' THEN -5 WHEN bridge = 'yes' THEN 1 WHEN tunnel = 'yes' THEN -1 ELSE 0 END AS BIGINT) AS level, CAST(CASE lanes WHEN '2' THEN 2 WHEN ' 3 ' THEN 3 WHEN '999' THEN 255 ELSE 0 END AS BIGINT) AS lanes,
  CAST(coalesce((bridge = 'yes')::INT, 0) + 2 * coalesce((tunnel = 'yes')::INT, 0) + 4 * (hw LIKE '%link')::INT AS BIGINT) AS flags FROM o""")
def road_tag_rules(spark, sf):
    k = F.col("o_orderkey")
    at = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    hw, ow = at(["motorway", "primary_link", "residential", "footway", "trunk", "service"]), at(["yes", "-1", None, "no", "1"])
    layer, bridge, tunnel, lanes = at(["2", " -7", "x", None]), at(["yes", "no", None]), at([None, "yes"]), at(["2", " 3 ", "0", "999", "a"])
    c = R.road_class(hw)
    return table(spark, sf, "orders").select("o_orderkey", c["class"].alias("class"), c["is_link"].alias("is_link"), R.direction(ow, F.lit(None).cast("string"), hw).alias("direction"),
        R.level(layer, bridge, tunnel).alias("level"), R.lanes(lanes).alias("lanes"), R.flags(bridge == "yes", tunnel == "yes", c["is_link"]).alias("flags"))


@query("small_rules", """
SELECT line_no, CASE WHEN k % 5 = 0 THEN 'offline' WHEN k % 7 = 0 THEN 'constrained' WHEN k % 2 = 0 OR k % 3 = 0 THEN 'metered' ELSE 'free' END AS connection,
  CASE WHEN k % 9 = 0 THEN 'noRoad' WHEN k > 25 THEN 'far' WHEN k > 15 THEN 'unmapped' END AS reason, least(greatest(k * 1e-1, 1e0), 8e0) AS clamped,
  CASE WHEN k > 90 THEN 'lat' WHEN k % 8 = 0 THEN 'covEE' WHEN k % 6 = 0 THEN 'heading' END AS invalid, nullif(trim(left(trim('  note ' || k || '   x '), 8)), '') AS note,
  CASE WHEN k % 2 = 0 THEN 'elm' END AS failed, k % 4 = 0 OR k % 3 = 0 OR k % 5 = 2 AS level_ok FROM @ev """)
def small_rules(spark, sf):
    k = F.col("k")
    return events(spark, sf).select("line_no", R.connection(k % 5 != 0, k % 2 == 0, k % 3 == 0, k % 7 == 0).alias("connection"), R.unmapped_reason(F.when(k % 9 != 0, k)).alias("reason"),
        R.clamped(k * 0.1, 1.0, 8.0, 2.0).alias("clamped"), R.first_invalid([("lat", k > 90), ("covEE", k % 8 == 0), ("heading", k % 6 == 0)]).alias("invalid"),
        T.note(F.concat(F.lit("  note "), k.cast("string"), F.lit("   x ")), 8).alias("note"), T.failed_kind(F.when(k % 2 == 0, "encodingFailed elm: why").otherwise("stop")).alias("failed"),
        R.level_allows(F.when(k % 4 != 0, k % 3), F.lit(0), k % 5 == 2).alias("level_ok"))
