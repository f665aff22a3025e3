"""Adapter replies by sender, blocks without headers, text answers, outcomes. Every event gives one raw reply; its bytes hold the event's numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import replies as P
from .base import events, query

LONG = "".join(f"7E8 2{k % 16:X} {'AB' * 7}\r" for k in range(1, 21))
#: Replies with headers: whole, interleaved, cut, out of sequence, bad lengths, strays, unfinished, echoes, empty, long.
HEADED = [
    "7E8 03 41 0D {k}\r7E9 04 41 0D {k} 0C\r\r>",
    "7E8 10 0B 41 0D {k} 0C 1A F8\r7E9 10 0A 41 05 50 0F 3C 2F\r7E8 21 05 7B 0F 40 2F AA AA\r7E9 21 80 11 20 04 55 55 55\r>",
    "7E8 04 41 0D\r7E9 03 41 0D {k}\r>",
    "7E8 10 14 41 0D {k} 0C 1A F8\r7E9 03 41 0D {k}\r7E8 22 01 02 03 04 05 06 07\r7E8 21 01 02 03 04 05 06 07\r>",
    "7E8 09 41 0D {k}\r7E9 00 41\r7EA 03 41 0D {k}\r>",
    "7E9 03 41 0D {k}\rCAN ERROR\r>",
    "NO DATA\r>",
    "7E8 03 41 0D {k}\rHELLO\r7E\r>",
    "18DAF110 03 41 0D {k}\n18DAF111 03 41 0D {k} AA AA\r\n>",
    "7E8 10 14 41 0D {k} 0C 1A F8\r7E9 03 41 0D {k}\r>",
    "010D\rSEARCHING...\rATSH7E0\r7E8 03 41 0D {k}\r>",
    "7E8 34 41 0D {k}\r7E8 03 41 0D {k}\r7E9 03 41 0D {k}\r>",
    ">",
    "7E8 03 41 0D {k}\r7E8 10 09 41 0C 1A {k} 05 55\r7E8 21 0F 40 2F\r7E8 03 41 05 {k}\r7E9 21 41 0D\r>",
    "7E8 10 05 41 0D {k} 0C 1A F8\r7E9 10\rBUS INIT: ...OK\r>",
    "7E8 10 8C 41 0D {k} 0C 1A F8\r" + LONG + ">",
]
#: Replies without: blocks (out of order, two, short, without length, index begun anew), plain, bad hex.
BARE = [
    "00A\r0: 41 0D {k} 0C 1A F8\r1: 05 7B 0F 40 AA AA AA\r>",
    "008\r1: 10 05 50 AA\r0: 41 0D {k} 0C 10 11\r007\r0: 41 05 50 0F 3C 2F\r1: 80 00\r>",
    "014\r0: 41 0D {k}\r>",
    "41 0D {k}\r41 0D {k} 55\r>",
    "0: 41 0D\r1: {k} 0C\r>",
    "41 0D XX\r>",
    "G: 41\r>",
    "41 0D 4\r>",
    "NO DATA\r41 0D {k}\r>",
    "41 0D {k}\r0: 41 05\r1: 50\r>",
    "078\r" + "".join(f"{k % 16:X}: {' '.join([f'{k:02X}'] * (6 if k == 0 else 7))}\r" for k in range(18)) + ">",
    "000\r00F\r>",
]


def _sql_list(raws: list[str]) -> str:
    text = lambda s: "'" + s.replace("\r", "\\r").replace("\n", "\\n") + "'"
    return f"(ARRAY[{', '.join('e' + text(r) for r in raws)}])[CAST(k % {len(raws)} + 1 AS INT)]"


def _raw(raws: list[str]) -> Column:
    k = F.col("k")
    return F.replace(F.element_at(F.array(*map(F.lit, raws)), (k % len(raws) + 1).cast("int")), F.lit("{k}"), F.lpad(F.hex(k), 2, "0"))


_LINES = r"""
raw AS (SELECT line_no, string_split(replace(replace(%s, '{k}', printf('%%02X', k)), chr(10), chr(13)), chr(13)) AS l FROM @ev ),
l0 AS (SELECT line_no, trim(replace(unnest(l), '>', '')) AS line, generate_subscripts(l, 1) AS pos FROM raw),
l1 AS (SELECT line_no, pos, line, upper(replace(line, ' ', '')) AS u FROM l0
  WHERE line <> '' AND NOT starts_with(line, 'SEARCHING') AND NOT starts_with(line, 'BUS INIT') AND NOT regexp_full_match(line, '01([0-9A-F]{2}){1,6}[1-9]?|ATSH7E0')),
l2 AS (SELECT *, CASE u WHEN 'NODATA' THEN 'noData' WHEN 'CANERROR' THEN 'canError' END AS code, regexp_full_match(u, '[0-9A-F]*') AS hex FROM l1)"""

_ERRORS = "CASE coalesce(error, 'ok') WHEN 'malformedHex' THEN 'malformed' WHEN 'malformedFrame' THEN 'malformed' WHEN 'truncatedFrame' THEN 'malformed' WHEN 'emptyResponse' THEN 'malformed' ELSE coalesce(error, 'ok') END AS outcome"


def _summary(df):
    """replies and faults as text, the error of the whole, its outcome."""
    s = df.select("line_no", F.array_join(F.transform("s.replies", lambda r: F.concat(F.coalesce(r.header, F.lit("")), F.lit("="), r["bytes"])), ";").alias("replies"),
        F.array_join(F.transform("s.faults", lambda f: F.concat_ws(":", F.coalesce(f.header, F.lit("")), f.error, f.expected, f.actual)), ";").alias("faults"), P.reply_error(F.col("s")).alias("error"))
    return s.withColumn("outcome", P.outcome(F.col("error")))


@query("ecu_replies", f"""
WITH {_LINES % _sql_list(HEADED)},
g AS (SELECT *, CASE WHEN length(u) % 2 = 0 THEN 8 ELSE 3 END AS size FROM l2 WHERE code IS NULL),
f AS (SELECT *, left(u, size) AS header, substr(u, size + 1) AS fr FROM g WHERE hex AND length(u) >= size + 2),
h AS (SELECT *, ('0x' || substr(fr, 1, 1))::INT AS kind, ('0x' || substr(fr, 2, 1))::INT AS low, length(fr) // 2 AS n, ('0x' || substr(fr, 2, 3))::INT AS long FROM f),
m AS (SELECT *, sum(CASE WHEN kind <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY line_no, header ORDER BY pos) AS msg FROM h),
w AS (SELECT *, first_value(kind) OVER v AS k0, first_value(long) OVER v AS len0, row_number() OVER v - 2 AS j, CASE kind WHEN 1 THEN least(n - 2, long) WHEN 2 THEN n - 1 ELSE 0 END AS add FROM m WINDOW v AS (PARTITION BY line_no, header, msg ORDER BY pos)),
b AS (SELECT *, coalesce(sum(add) OVER (PARTITION BY line_no, header, msg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM w),
e AS (SELECT line_no, header, msg, min(pos) AS pos0, any_value(k0) AS k0, any_value(len0) AS len0, sum(add) AS total, count(*) FILTER (kind = 2) AS more,
  string_agg(CASE WHEN kind = 1 THEN substr(fr, 5) ELSE substr(fr, 3) END, '' ORDER BY pos) AS body, any_value(low) FILTER (pos = p0) AS low0 FROM (SELECT *, min(pos) OVER (PARTITION BY line_no, header, msg) AS p0 FROM b) GROUP BY ALL),
c AS (SELECT b.*, coalesce(e.k0 = 1 AND (e.more = 0 OR e.total < e.len0), false) AS before FROM b LEFT JOIN e ON e.line_no = b.line_no AND e.header = b.header AND e.msg = b.msg - 1),
x AS (SELECT *, CASE WHEN kind = 0 AND (low NOT BETWEEN 1 AND 7 OR before) THEN 'malformedFrame' WHEN kind = 0 AND n - 1 < low THEN 'truncatedFrame' WHEN kind = 1 AND (n < 2 OR before OR long <= 7) THEN 'malformedFrame'
  WHEN kind = 2 AND (msg = 0 OR k0 <> 1 OR (j > 0 AND got >= len0) OR low <> (j + 1) % 16) THEN 'malformedFrame' WHEN kind > 2 THEN 'malformedFrame' END AS bad FROM c),
y AS (SELECT *, min(CASE WHEN bad IS NOT NULL THEN pos END) OVER (PARTITION BY line_no, header) AS first_bad FROM x),
ends AS (SELECT e.* FROM e WHERE k0 = 1 AND (more = 0 OR total < len0) AND msg = (SELECT max(msg) FROM e e2 WHERE e2.line_no = e.line_no AND e2.header = e.header)
  AND NOT EXISTS (SELECT 1 FROM x WHERE x.line_no = e.line_no AND x.header = e.header AND bad IS NOT NULL)),
faults AS (
  SELECT line_no, 0 AS grp, pos, ':' || code AS t, code AS error FROM l2 WHERE code IS NOT NULL
  UNION ALL SELECT line_no, 1, pos, CASE WHEN hex THEN ':malformedFrame' ELSE ':malformedHex' END, CASE WHEN hex THEN 'malformedFrame' ELSE 'malformedHex' END FROM g WHERE NOT (hex AND length(u) >= size + 2)
  UNION ALL SELECT line_no, 1, pos, header || ':' || CASE WHEN pos = first_bad AND bad = 'truncatedFrame' THEN 'truncatedFrame:' || low || ':' || (n - 1) ELSE 'malformedFrame' END, CASE WHEN pos = first_bad THEN bad ELSE 'malformedFrame' END FROM y WHERE pos >= first_bad
  UNION ALL SELECT line_no, 2, pos0, header || ':truncatedFrame:' || len0 || ':' || least(total, len0), 'truncatedFrame' FROM ends),
ok AS (SELECT line_no, string_agg(header || '=' || CASE WHEN k0 = 1 THEN left(body, 2 * len0) ELSE left(body, 2 * low0) END, ';' ORDER BY pos0) AS replies FROM e
  WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.line_no = e.line_no AND y.header = e.header AND first_bad IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM ends n WHERE n.line_no = e.line_no AND n.header = e.header) GROUP BY line_no),
bad AS (SELECT line_no, string_agg(t, ';' ORDER BY grp, pos) AS faults, first(error ORDER BY grp, pos) AS error FROM faults GROUP BY line_no)
SELECT *, {_ERRORS} FROM (SELECT r.line_no, coalesce(replies, '') AS replies, coalesce(faults, '') AS faults, coalesce(error, CASE WHEN replies IS NULL THEN 'emptyResponse' END) AS error FROM raw r LEFT JOIN ok USING (line_no) LEFT JOIN bad USING (line_no))""")
def ecu_replies(spark, sf):
    return _summary(events(spark, sf).select("line_no", P.scan_replies(_raw(HEADED)).alias("s")))


@query("reply_blocks", f"""
WITH {_LINES % _sql_list(BARE)},
d AS (SELECT *, contains(line, ':') AS ix, sum(CASE WHEN contains(line, ':') THEN 0 ELSE 1 END) OVER (PARTITION BY line_no ORDER BY pos) AS seg FROM l2 WHERE code IS NULL),
p AS (SELECT *, CASE WHEN ix THEN split_part(u, ':', 1) END AS i, CASE WHEN ix THEN split_part(u, ':', 2) ELSE u END AS b, CASE WHEN NOT ix AND hex AND length(u) = 3 THEN ('0x' || u)::INT END AS len FROM d),
t AS (SELECT *, CASE WHEN ix AND (NOT regexp_full_match(i, '[0-9A-F]+') OR NOT regexp_full_match(b, '([0-9A-F]{{2}})*') ) OR NOT ix AND len IS NULL AND NOT regexp_full_match(b, '([0-9A-F]{{2}})*') THEN 1 ELSE 0 END AS bad FROM p),
o AS (SELECT *, CASE WHEN ix AND bad = 0 THEN ('0x' || i)::INT END AS n, count(*) OVER (PARTITION BY line_no, seg, i) AS same FROM t),
s AS (SELECT line_no, seg, max(bad) AS bad, max(len) AS len, max(CASE WHEN NOT ix AND len IS NULL THEN b END) AS single, count(*) FILTER (ix) AS frames,
  coalesce(CASE WHEN max(CASE WHEN ix THEN same END) > 1 THEN string_agg(CASE WHEN ix THEN b END, '' ORDER BY pos) ELSE string_agg(CASE WHEN ix THEN b END, '' ORDER BY n) END, '') AS body FROM o GROUP BY line_no, seg),
z AS (SELECT *, CASE WHEN bad = 1 THEN 'malformedHex' WHEN length(body) < 2 * len THEN 'truncatedFrame' END AS error FROM s),
one AS (SELECT line_no, first(error ORDER BY seg) FILTER (error IS NOT NULL) AS error, first(CASE WHEN error = 'truncatedFrame' THEN ':' || len || ':' || length(body) // 2 ELSE '' END ORDER BY seg) FILTER (error IS NOT NULL) AS more FROM z GROUP BY line_no),
ok AS (SELECT line_no, string_agg(r, ';' ORDER BY seg, k) AS replies FROM (SELECT line_no, seg, 0 AS k, '=' || single AS r FROM z WHERE single IS NOT NULL UNION ALL SELECT line_no, seg, 1, '=' || CASE WHEN len IS NULL THEN body ELSE left(body, 2 * len) END FROM z WHERE len IS NOT NULL OR frames > 0) GROUP BY line_no),
st AS (SELECT line_no, string_agg(':' || code, ';' ORDER BY pos) AS t, first(code ORDER BY pos) AS code FROM l2 WHERE code IS NOT NULL GROUP BY line_no)
SELECT *, {_ERRORS} FROM (SELECT raw.line_no, CASE WHEN one.error IS NULL THEN coalesce(replies, '') ELSE '' END AS replies, concat_ws(';', st.t, ':' || one.error || more) AS faults,
  coalesce(st.code, one.error, CASE WHEN replies IS NULL THEN 'emptyResponse' END) AS error FROM raw LEFT JOIN one USING (line_no) LEFT JOIN ok USING (line_no) LEFT JOIN st USING (line_no))""")
def reply_blocks(spark, sf):
    return _summary(events(spark, sf).select("line_no", P.scan_replies(_raw(BARE), headers=False).alias("s")))


ANSWERS = [("ATZ", "ATZ\r\rELM327 v2.1\r\r>"), ("ATDPN", "A6\r>"), ("ATRV", "12.{k}V\r>"), ("ATRV", "no volts\r>"), ("ATE0", "ATE0\rOK\r>"), ("ATH1", "?\r>"), ("ATI", ">"), ("ATDP", "AUTO, ISO 15765-4\r>"), ("ATSP0", "old\rok\r>"), ("ATRV", "BUS INIT: ...ERROR\r>")]


@query("text_replies", """
WITH a AS (SELECT line_no, k, CAST(k % 10 AS INT) AS c FROM @ev )
SELECT line_no, (ARRAY['banner', 'protocolNumber', 'voltage', 'other', 'ok', NULL, NULL, 'other', 'ok', NULL])[c + 1] AS kind,
  CASE c WHEN 0 THEN 'ELM327 v2.1' WHEN 1 THEN 'A6' WHEN 2 THEN '12.' || printf('%02X', k) || 'V' WHEN 3 THEN 'no volts' WHEN 7 THEN 'AUTO, ISO 15765-4' END AS value,
  CASE WHEN c = 2 THEN CAST('12.' || printf('%02X', k) AS DOUBLE) END AS volts, (ARRAY[NULL, NULL, NULL, NULL, NULL, 'notRecognised', 'emptyResponse', NULL, NULL, 'busInitFailed'])[c + 1] AS error,
  (ARRAY['ok', 'ok', 'ok', 'ok', 'ok', 'notRecognised', 'malformed', 'ok', 'ok', 'busInitError'])[c + 1] AS outcome FROM a WHERE regexp_full_match(printf('%02X', k), '[0-9]+')""")
def text_replies(spark, sf):
    at = lambda i: F.element_at(F.array(*(F.lit(a[i]) for a in ANSWERS)), (F.col("k") % len(ANSWERS) + 1).cast("int"))
    e = events(spark, sf).where(F.hex("k").rlike("^[0-9]+$")).select("line_no", at(0).alias("command"), F.replace(at(1), F.lit("{k}"), F.lpad(F.hex("k"), 2, "0")).alias("raw"))
    e = e.select("line_no", P.text_reply(F.col("command"), F.col("raw")).alias("a"), P.exchange_outcome(F.col("command"), F.col("raw")).alias("outcome"))
    return e.select("line_no", "a.kind", "a.value", "a.volts", "a.error", "outcome")
