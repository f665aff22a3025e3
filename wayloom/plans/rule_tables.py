"""Queries of the rules of live state, names, lists and sets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import rules as R, text as T
from ..operators import catalog as C
from .base import events, query, table


@query("live_state_rules", """
SELECT line_no, kind IN ('motion', 'location', 'obd', 'manualFix', 'gpsSwitch') AS tapped, coalesce(k % 4 = 0 AND k % 7 <> 3 AND k % 5 / 2e0 <= 2, false) AS stopped, k % 3 = 1 AND k % 2 = 1 AS update_,
  k % 6 = 0 OR (k - 20) < 0 OR (k - 20) * 3600 >= 86400 AS refresh, k * 1000 >= 50000 AS may_start,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 <> 0 THEN 'moving' WHEN k % 2 = 0 THEN 'parked' ELSE 'standingStop' END WHEN k % 4 <> 0 OR k % 7 = 0 THEN 'moving' WHEN k % 8 = 0 OR (k % 11 > 4 AND k % 3 = 0) THEN 'parked'
    WHEN k % 11 <= 4 AND (k % 13 = 0 OR k % 20 >= 10) THEN 'standingStop' ELSE 'moving' END AS restored FROM (SELECT line_no, k, (ARRAY['motion', 'poll', 'obd', 'gpsSwitch', 'marker'])[CAST(k % 5 + 1 AS INT)] AS kind FROM @ev )""")
def live_state_rules(spark, sf):
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("motion", "poll", "obd", "gpsSwitch", "marker"))), (k % 5 + 1).cast("int"))
    awaiting = k % 5 == 0
    off = F.when(awaiting, k % 2 == 0).otherwise(k % 8 == 0)
    return events(spark, sf).select(
        "line_no", R.tapped(kind).alias("tapped"), R.stopped(k % 4, F.when(k % 7 != 3, k * 1.0), k + k % 5 / 2).alias("stopped"),
        R.update_available(F.when(k % 3 == 1, k % 2), F.lit(0)).alias("update_"), R.needs_refresh(F.when(k % 6 != 0, F.lit(20 * 3600)), k * 3600).alias("refresh"), R.may_start(k * 1000, F.lit(50000)).alias("may_start"),
        R.restore_class(awaiting, k % 3 == 0, off, F.lit("standingStop"), k % 4, k % 7 == 0, k % 11, k % 20, k % 13 == 0, 4.0, 10.0).alias("restored"),
    )


@query("file_names_and_titles", """
WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'r' || p_partkey || '.jsonl.gz' WHEN p_size % 3 = 1 THEN 'r' || p_partkey || '.nav.jsonl' ELSE 'r' || p_partkey END AS file, CASE WHEN p_size % 5 = 0 THEN 'Bad ' ELSE 'a-' END || p_partkey AS name FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'r' || p_partkey || '.nav.jsonl' ELSE file || '.nav.jsonl' END AS sidecar, p_size % 3 = 1 AS is_sidecar, CASE WHEN p_size % 5 <> 0 THEN '.download-' || name || '-00000000deadbeef.part' END AS part_, CASE WHEN p_size % 5 <> 0 THEN '.download-' || name || '-00000000deadbeef.json' END AS meta,
  CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 7 = 0 THEN 'E' ELSE 'U' END WHEN 1 THEN CASE WHEN p_size % 7 = 0 THEN 'E' ELSE 'U' END WHEN 2 THEN CASE WHEN p_size % 7 = 0 AND p_size % 2 = 1 THEN name ELSE 'E' END ELSE 'E' END AS title,
  CASE p_size % 3 WHEN 0 THEN 'seed,gps' WHEN 1 THEN 'gps' ELSE '' END AS refused FROM p""")
def file_names_and_titles(spark, sf):
    n, key = F.col("p_size"), F.col("p_partkey").cast("string")
    file = F.concat(F.lit("r"), key, F.when(n % 3 == 0, ".jsonl.gz").when(n % 3 == 1, ".nav.jsonl").otherwise(""))
    name, code = F.concat(F.when(n % 5 == 0, "Bad ").otherwise("a-"), key), F.lit("00000000deadbeef")
    language = F.element_at(F.array(*(F.lit(x) for x in ("uk", "UK-ua", "ukx", None))), (n % 4 + 1).cast("int"))
    given = F.when(n % 3 == 0, F.array(*map(F.lit, ("seed", "out", "gps", "seed")))).when(n % 3 == 1, F.array(*map(F.lit, ("out", "gps")))).otherwise(F.array(F.lit("out")))
    return table(spark, sf, "part").select(
        "p_partkey", T.sidecar_name(file).alias("sidecar"), T.is_sidecar(file).alias("is_sidecar"), T.download_file(name, code, "part").alias("part_"), T.download_file(name, code, "json").alias("meta"),
        T.title(F.when(n % 7 == 0, " \n").otherwise("U"), F.lit("E"), name, language).alias("title"), F.array_join(R.refused_flags(given, ["gps", "seed"]), ",").alias("refused"),
    )


@query("pack_list_places", """
WITH packs AS (SELECT s_name AS name, s_suppkey % 9 = 0 AS national, 29.0e0 + s_suppkey % 8 * 2.5e-1 AS w, 29.0e0 + s_suppkey % 8 * 2.5e-1 + 4e-1 AS e, 49.8e0 + s_suppkey % 5 * 1e-1 AS s, 49.8e0 + s_suppkey % 5 * 1e-1 + 2e-1 AS n FROM supplier),
d AS (SELECT *, pow(29.6 - (w + e) / 2, 2) + pow(50.05 - (s + n) / 2, 2) AS d2, sqrt(pow(greatest(0, w - 29.6, 29.6 - e) * 111320 * cos(radians(50.05)), 2) + pow(greatest(0, s - 50.05, 50.05 - n) * 111320, 2)) AS d FROM packs),
r AS (SELECT arg_min(name, (round(d2, 12), name)) AS name FROM d WHERE d = 0),
p AS (SELECT name, row_number() OVER (ORDER BY round(d, 6), name) AS place FROM d WHERE d <= 20000)
SELECT name, CASE WHEN national THEN 0 WHEN name = (SELECT name FROM r) THEN 1 WHEN place IS NOT NULL THEN 2 ELSE 3 END AS rank, CASE WHEN NOT national AND name <> coalesce((SELECT name FROM r), '') AND place IS NOT NULL THEN place ELSE 0 END AS place FROM packs LEFT JOIN p USING (name)""")
def pack_list_places(spark, sf):
    k = F.col("s_suppkey")
    w, s = 29.0 + k % 8 * 0.25, 49.8 + k % 5 * 0.1
    packs = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(k % 9 == 0, "national").otherwise("region").alias("kind"), w.alias("w"), (w + 0.4).alias("e"), s.alias("s"), (s + 0.2).alias("n"))
    here = spark.range(1).select("id", F.lit(29.6).alias("lon"), F.lit(50.05).alias("lat"))
    return C.list_places(packs.select("name", "kind"), C.containing_region(here, packs, "id"), C.neighbours(here, packs, "id", 20000.0)).drop("kind")


@query("packs_by_hash", """
WITH h AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), w AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT l_orderkey, count(s_suppkey) AS found, coalesce(string_agg(l_suppkey, ',' ORDER BY l_suppkey) FILTER (s_suppkey IS NULL), '') AS missing FROM w LEFT JOIN h ON s_suppkey = l_suppkey GROUP BY l_orderkey""")
def packs_by_hash(spark, sf):
    wanted = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("hash"))
    have = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("hash"))
    c = C.chosen_packs(wanted, have, "l_orderkey", "hash")
    return c.select("l_orderkey", "found", F.concat_ws(",", F.col("missing").cast("array<string>")).alias("missing"))


@query("set_extension", """
WITH s AS (SELECT o_custkey, o_orderkey, list_sort(list_distinct(list(l_linenumber))) AS now_ FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT *, lag(now_) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM s)
SELECT o_orderkey, len(list_filter(before, lambda x: NOT list_contains(now_, x))) = 0 AND len(list_filter(now_, lambda x: NOT list_contains(before, x))) > 0 AS extends, array_to_string(list_filter(before, lambda x: NOT list_contains(now_, x)), ',') AS missing FROM p WHERE before IS NOT NULL""")
def set_extension(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = j.groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("now"))
    s = s.withColumn("before", F.lag("now").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("before is not null")
    return s.select("o_orderkey", R.strict_superset(F.col("now"), F.col("before")).alias("extends"), F.concat_ws(",", R.missing_of(F.col("before"), F.col("now")).cast("array<string>")).alias("missing"))
