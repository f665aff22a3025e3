"""Sidecars and truth files made of the event log, with every kind of damage, and comparisons of estimates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import compare as M
from ..sources import sidecar as S
from .base import events, query, table

#: Lines of each session: a header, then its events in order; a session's damage is its number modulo 12.
_LINES = """
e AS (SELECT session % 12 AS d, session, k, t, row_number() OVER (PARTITION BY session ORDER BY t, line_no) AS j, count(*) OVER (PARTITION BY session) AS m FROM @ev ),
h AS (SELECT DISTINCT session, d FROM e),
lines AS (
  SELECT CAST(session AS VARCHAR) AS file, 1 AS n, d, 0 AS k, 0 AS t, CASE d WHEN 1 THEN '{"kind":"note"}' WHEN 11 THEN '{"kind":"header"'
    ELSE '{"appBuild":"b","configHash":"c","configJSON":"{}","kind":"header","seed":18446744073709551615,"sessionID":"00000000-0000-4000-8000-' || lpad(session::VARCHAR, 12, '0') || '","sidecarVersion":' || CASE d WHEN 2 THEN 4 WHEN 7 THEN 2 ELSE 3 END || '}' END AS value FROM h
  UNION ALL SELECT CAST(session AS VARCHAR), j + 1, d, k, t, CASE WHEN d = 3 AND j = 5 THEN 'nonsense' WHEN d = 4 AND j = m THEN '{"kind":"estimate","t":'
    WHEN j % 7 = 0 THEN '{"afterInputs":' || CASE WHEN d = 6 AND j = 14 THEN 1 ELSE j END || ',"kind":"roads","roadSetHash":"x","roads":[' ||
      list_aggregate(list_transform(range(1, CASE WHEN d = 5 AND j = 14 THEN 2 ELSE j // 7 + 1 END), lambda i: '{"contentHash":"h' || i || '","formatVersion":1,"gridID":"g","osmTimestamp":' || i || '}'), 'string_agg', ',') || ']}'
    WHEN j % 7 = 3 THEN '{"kind":"pin","latitude":50.5,"longitude":30,"t":' || t || '}'
    WHEN j % 7 = 5 THEN '{"kind":"later","x":[' || k || ']}'
    ELSE '{"converged":' || CASE WHEN d = 8 AND j = 9 THEN 'null' ELSE 'true' END || ',"droppedInputs":' || k || ',"headingDeg":1,"headingStdDeg":2.5,"kind":"estimate","latitude":' || CASE WHEN d = 9 THEN '"nan"' WHEN d = 10 AND j = 2 THEN '"12"' ELSE '50.' || k END
      || ',"longitude":30.25,"orientationDeg":0,"semiMajorM":9.5,"semiMinorM":4,"speedScale":1,"t":' || t || CASE WHEN k % 2 = 0 THEN ',"onRoadShare":null' ELSE ',"onRoadShare":0.5' END || '}' END FROM e)"""


def _lines(spark, sf):
    w = Window.partitionBy("session")
    e = events(spark, sf).withColumns({"d": F.col("session") % 12, "j": F.row_number().over(w.orderBy("t", "line_no")), "m": F.count("*").over(w)})
    d, j, k, t = F.col("d"), F.col("j"), F.col("k"), F.col("t")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    head = F.when(d == 1, '{"kind":"note"}').when(d == 11, '{"kind":"header"').otherwise(text('{"appBuild":"b","configHash":"c","configJSON":"{}","kind":"header","seed":18446744073709551615,"sessionID":"00000000-0000-4000-8000-', F.lpad(F.col("session").cast("string"), 12, "0"), '","sidecarVersion":', F.when(d == 2, 4).when(d == 7, 2).otherwise(3), "}"))
    packs = F.array_join(F.transform(F.sequence(F.lit(1), F.when((d == 5) & (j == 14), 1).otherwise(F.floor(j / 7).cast("int"))), lambda i: text('{"contentHash":"h', i, '","formatVersion":1,"gridID":"g","osmTimestamp":', i, "}")), ",")
    estimate = text('{"converged":', F.when((d == 8) & (j == 9), "null").otherwise("true"), ',"droppedInputs":', k, ',"headingDeg":1,"headingStdDeg":2.5,"kind":"estimate","latitude":', F.when(d == 9, '"nan"').when((d == 10) & (j == 2), '"12"').otherwise(text("50.", k)),
        ',"longitude":30.25,"orientationDeg":0,"semiMajorM":9.5,"semiMinorM":4,"speedScale":1,"t":', t, F.when(k % 2 == 0, ',"onRoadShare":null').otherwise(',"onRoadShare":0.5'), "}")
    line = (
        F.when((d == 3) & (j == 5), "nonsense").when((d == 4) & (j == F.col("m")), '{"kind":"estimate","t":')
        .when(j % 7 == 0, text('{"afterInputs":', F.when((d == 6) & (j == 14), 1).otherwise(j), ',"kind":"roads","roadSetHash":"x","roads":[', packs, "]}"))
        .when(j % 7 == 3, text('{"kind":"pin","latitude":50.5,"longitude":30,"t":', t, "}")).when(j % 7 == 5, text('{"kind":"later","x":[', k, "]}")).otherwise(estimate)
    )
    file = F.col("session").cast("string").alias("file")
    return e.select("session", "d").distinct().select(file, F.lit(1).cast("long").alias("n"), head.alias("value")).unionByName(e.select(file, (j + 1).cast("long").alias("n"), line.alias("value")))


_CHECKED = """
j AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS v, max(n) OVER (PARTITION BY file) AS last FROM lines),
x AS (SELECT *, v->>'$.kind' AS kind, CAST(v->>'$.sidecarVersion' AS BIGINT) AS ver FROM j),
o AS (SELECT *, coalesce(v IS NOT NULL AND kind IS NOT NULL AND CASE WHEN kind = 'estimate' THEN json_type(v, '$.converged') = 'BOOLEAN' AND (json_type(v, '$.latitude') <> 'VARCHAR' OR v->>'$.latitude' = 'nan') ELSE true END, false) AS ok FROM x),
r AS (SELECT *, max(CASE WHEN n = 1 AND kind = 'header' AND ok THEN ver END) OVER (PARTITION BY file) AS version, CASE WHEN kind = 'roads' THEN json_array_length(v, '$.roads') END AS packs, CASE WHEN kind = 'roads' THEN CAST(v->>'$.afterInputs' AS BIGINT) END AS after FROM o),
p AS (SELECT *, lag(packs) OVER (PARTITION BY file, kind ORDER BY n) AS packs0, lag(after) OVER (PARTITION BY file, kind ORDER BY n) AS after0 FROM r),
q AS (SELECT *, CASE WHEN n = 1 AND (NOT ok OR kind <> 'header') THEN 'missingHeader' WHEN n = 1 AND version > 3 THEN 'unsupportedVersion' WHEN n > 1 AND NOT ok AND n < last THEN 'malformedLine' WHEN packs0 IS NOT NULL AND version < 3 THEN 'duplicateRoadsLine'
  WHEN after < after0 THEN 'roadsEarlier' WHEN packs <= packs0 THEN 'roadsNoSuperset' END AS problem FROM p)"""


@query("sidecar_reports", f"""
WITH {_LINES}, {_CHECKED},
g AS (SELECT file, max(version) AS version, first(problem ORDER BY n) FILTER (problem IS NOT NULL) AS error, min(n) FILTER (problem IS NOT NULL) AS error_line, count(*) FILTER (kind = 'estimate' AND ok) AS estimates, count(*) FILTER (kind = 'pin') AS pins,
  count(*) FILTER (kind = 'roads') AS roads, count(*) FILTER (kind = 'later') AS unrecognized, bool_or(NOT ok AND n > 1) AS truncated, max(CASE WHEN kind = 'estimate' AND ok THEN CAST(v->>'$.droppedInputs' AS BIGINT) ELSE 0 END) AS dropped FROM q GROUP BY file)
SELECT file, version, error, error_line, CASE WHEN error IS NULL THEN estimates END AS estimates, CASE WHEN error IS NULL THEN pins END AS pins, CASE WHEN error IS NULL THEN roads END AS roads, CASE WHEN error IS NULL THEN 0 END AS selections,
  CASE WHEN error IS NULL THEN unrecognized END AS unrecognized, CASE WHEN error IS NULL THEN truncated END AS truncated, CASE WHEN error IS NULL THEN dropped END AS dropped FROM g""")
def sidecar_reports(spark, sf):
    return S.report(S.checked(_lines(spark, sf)))


@query("sidecar_estimates", f"""
WITH {_LINES}, {_CHECKED}, f AS (SELECT file FROM q GROUP BY file HAVING count(problem) = 0)
SELECT file, n, t, CASE WHEN d = 9 THEN 'NaN' ELSE CAST(round(CAST('50.' || k AS DOUBLE), 3) AS VARCHAR) END AS latitude, k AS dropped, CASE WHEN k % 2 = 1 THEN 0.5::DOUBLE END AS share FROM q SEMI JOIN f USING (file) WHERE kind = 'estimate' AND ok""")
def sidecar_estimates(spark, sf):
    e = S.values(S.checked(_lines(spark, sf)), "estimate")
    return e.select("file", "n", "t", F.round("latitude", 3).cast("string").alias("latitude"), F.col("droppedInputs").alias("dropped"), F.col("onRoadShare").alias("share"))


@query("truth_files", """
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_custkey % 5 AS d FROM customer),
f AS (SELECT CAST(c_nationkey AS VARCHAR) AS file, bool_or(c_custkey % 97 = 3) AS bad, bool_or(c_custkey % 89 = 5) AS late FROM c GROUP BY c_nationkey)
SELECT file, CASE WHEN NOT bad AND NOT late THEN 'Drive_' || c_custkey || CASE WHEN d = 0 THEN '.jsonl' WHEN d = 1 THEN '' ELSE '.jsonl.gz' END END AS recording, CASE WHEN NOT bad AND NOT late AND d > 1 THEN c_custkey / 8 END AS until,
  CASE WHEN NOT bad AND NOT late AND d = 2 THEN 2 END AS points, CASE WHEN NOT bad AND NOT late AND d = 3 THEN c_custkey + 0.5::DOUBLE END AS from_t, CASE WHEN bad THEN 'malformed' WHEN late THEN 'range' END AS failure
FROM c JOIN f ON file = CAST(c_nationkey AS VARCHAR) WHERE NOT (bad OR late) UNION ALL SELECT file, NULL, NULL, NULL, NULL, CASE WHEN bad THEN 'malformed' ELSE 'range' END FROM f WHERE bad OR late""")
def truth_files(spark, sf):
    """A file for each nation, an entry for each customer; some entries lack a number, some ranges end before they begin."""
    k = F.col("c_custkey")
    d, s = k % 5, k.cast("string")
    name = F.concat(F.lit("Drive_"), s, F.when(d == 0, ".jsonl").when(d == 1, "").otherwise(".jsonl.gz"))
    entry = F.concat(
        F.lit('{"other":1'), F.when(d > 1, F.concat(F.lit(',"scoreUntilT":'), (k / 8).cast("string"))).otherwise(""),
        F.when(d == 2, ',"points":[{"t":1,"latitude":50,"longitude":30.5},{"t":2.5,"latitude":50,"longitude":30.5,"sigmaM":3,"source":"map"}],"end":{"latitude":1,"longitude":2}').otherwise(""),
        F.when(d == 3, F.concat(F.lit(',"excludeFixes":[{"fromT":'), (k + 0.5).cast("string"), F.lit(',"toT":'), (k + 0.5).cast("string"), F.lit("}]"))).otherwise(""),
        F.when(k % 97 == 3, ',"excludePins":[{"t":"5"}]').otherwise(""), F.lit("}"),
    )
    late = F.when(k % 89 == 5, F.concat(F.lit(',"late'), s, F.lit('":{"excludeFixes":[{"fromT":2,"toT":1}]}'))).otherwise("")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("file"), F.concat(F.lit('"'), name, F.lit('":'), entry, late).alias("x"))
    files = rows.groupBy("file").agg(F.concat(F.lit("{"), F.concat_ws(",", F.collect_list("x")), F.lit("}")).alias("value"))
    return S.truth(files).select("file", "recording", F.col("score_until").alias("until"), F.nullif(F.coalesce(F.size("points"), F.lit(-1)), F.lit(-1)).alias("points"), F.col("exclude_fixes")[0]["fromT"].alias("from_t"), "failure")


_RUNS = """
base AS (SELECT session, t, line_no AS n, k, session % 4 AS c FROM @ev ),
a AS (SELECT *, 50.0::DOUBLE AS latitude, k * 1.0::DOUBLE AS heading, CASE WHEN k % 3 = 0 THEN 0.5::DOUBLE END AS share, 0.0::DOUBLE AS scale FROM base WHERE session % 5 > 0 OR k % 50 <> 49),
b AS (SELECT session, t, n, c, k, CASE WHEN c = 1 THEN 50.0 + k * 1e-9 ELSE 50.0 END::DOUBLE AS latitude, CASE WHEN c = 2 AND k = 7 THEN 360.05 + k ELSE k END::DOUBLE AS heading, CASE WHEN k % 3 = 0 OR c = 1 AND k = 1 THEN 0.5::DOUBLE END AS share,
  CASE WHEN c = 3 AND k = 5 THEN '-0.0' ELSE '0.0' END::DOUBLE AS scale FROM base WHERE session % 5 > 1 OR k % 50 <> 48)"""


@query("estimate_comparison", f"""
WITH {_RUNS},
j AS (SELECT coalesce(a.session, b.session) AS session, coalesce(a.t, b.t) AS t, a.n AS an, b.n AS bn, radians(b.latitude - a.latitude) * 6378137.0 * (1 - 0.0066943799901413165) / pow(1 - 0.0066943799901413165 * pow(sin(radians(a.latitude)), 2), 1.5) AS north,
  abs(a.heading - b.heading) AS dh, CASE WHEN a.share IS NULL AND b.share IS NULL THEN 0 WHEN a.share IS NULL OR b.share IS NULL THEN 1 ELSE abs(a.share - b.share) END AS share,
  CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN a.latitude = b.latitude AND a.heading = b.heading AND a.share IS NOT DISTINCT FROM b.share AND CAST(a.scale AS VARCHAR) = CAST(b.scale AS VARCHAR) END AS equal FROM a FULL JOIN b ON a.session = b.session AND a.t = b.t),
e AS (SELECT *, max(CASE WHEN an IS NOT NULL THEN t END) OVER (PARTITION BY session) AS last FROM j),
g AS (SELECT session, count(*) FILTER (an IS NOT NULL AND bn IS NOT NULL) AS matched, coalesce(max(abs(north)), 0) AS m, coalesce(max(least(dh % 360, 360 - dh % 360)), 0) AS h, coalesce(max(CASE WHEN an IS NOT NULL AND bn IS NOT NULL THEN share END), 0) AS share,
  count(*) FILTER (NOT equal) AS unequal, min(CASE WHEN NOT equal THEN t END) AS first_difference, count(*) FILTER (bn IS NULL) AS left_only, count(*) FILTER (an IS NULL) AS right_only, count(*) FILTER (an IS NULL AND (last IS NULL OR t > last)) AS right_only_after_end FROM e GROUP BY session)
SELECT session, matched, round(m, 6) AS position_m, round(h, 6) AS heading_deg, CAST(share AS DOUBLE) AS share, unequal, first_difference, left_only, right_only, right_only_after_end,
  CASE WHEN left_only + right_only = 0 AND unequal = 0 THEN 'exact' WHEN left_only + right_only = 0 AND m <= 1 AND h <= 0.1 THEN 'within' ELSE 'different' END AS verdict FROM g""")
def estimate_comparison(spark, sf):
    """Runs that are equal, differ in position, in heading, in the sign of a zero, or lack rows, by session."""
    k, c, s = F.col("k"), F.col("session") % 4, F.col("session")
    one = lambda x: F.lit(float(x))
    same = {"longitude": one(30), "headingStdDeg": one(2), "semiMajorM": one(9), "semiMinorM": one(4), "orientationDeg": F.lit(float("nan")), "converged": F.lit(True)}
    e = events(spark, sf).withColumnRenamed("line_no", "n").withColumns(same)
    share = F.when(k % 3 == 0, 0.5)
    live = e.where((s % 5 > 0) | (k % 50 != 49)).withColumns({"latitude": one(50), "headingDeg": k * 1.0, "onRoadShare": share, "speedScale": one(0)})
    replay = e.where((s % 5 > 1) | (k % 50 != 48)).withColumns({
        "latitude": F.when(c == 1, 50 + k * 1e-9).otherwise(50.0), "headingDeg": F.when((c == 2) & (k == 7), 360.05 + k).otherwise(k * 1.0),
        "onRoadShare": F.when((c == 1) & (k == 1), 0.5).otherwise(share), "speedScale": F.when((c == 3) & (k == 5), (k - 5) * -1.0).otherwise(0.0)})
    out = M.compared(M.matched(live, replay, ["session"]), ["session"])
    return out.select("session", "matched", F.round("position_m", 6).alias("position_m"), F.round("heading_deg", 6).alias("heading_deg"), "share", "unequal", "first_difference", "left_only", "right_only", "right_only_after_end", "verdict")
