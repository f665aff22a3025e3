"""Event-log views over the test tables, in Spark and in SQL, and the registry of query plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000_000


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL; ``@name`` in the SQL stands for a view of VIEWS."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = expand(sql)
        return f

    return add


VIEWS = {
    "ev": "(SELECT event_id AS line_no, user_id AS session, event_type AS kind, epoch_us(ts) * 1000 AS t, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events)",
    # speed rows: km/h of one kind, as whole numbers
    "speed": "(SELECT session, t, line_no, least(floor(value), 255) AS kmh FROM @ev WHERE kind = 'view')",
    # position fixes of another kind, in degrees
    "fix": "(SELECT session, t, line_no, CAST(50.0 + (session % 10) * 0.01 + k * 0.0001 AS DOUBLE) AS lat, CAST(30.0 + (k * 7 % 100) * 0.0001 AS DOUBLE) AS lon, CAST(k AS DOUBLE) AS accuracy, CASE WHEN k % 5 = 0 THEN -1.0 ELSE value / 10 END AS speed, CASE WHEN k % 7 = 0 THEN -1.0 ELSE CAST(k * 36 % 360 AS DOUBLE) END AS course FROM @ev WHERE kind = 'click')",
    "node": "(SELECT p_partkey AS node_id, CAST(500000000 + p_partkey % 45 * 9000 AS BIGINT) AS lat_e7, CAST(300000000 + p_partkey // 45 * 14000 AS BIGINT) AS lon_e7 FROM part)",
}


def expand(sql: str) -> str:
    for _ in range(4):
        for k, v in VIEWS.items():
            sql = sql.replace(f"@{k} ", v + " ").replace(f"@{k})", v + ")").replace(f"@{k}\n", v + "\n")
    return sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """line_no, session, kind, t (ns, exact), value, k, props."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000")
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("line_no"), F.col("user_id").alias("session"), F.col("event_type").alias("kind"), t.alias("t"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


def speeds(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("kind = 'view'").select("session", "t", "line_no", F.least(F.floor("value").cast("double"), F.lit(255.0)).alias("kmh"))


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf).where("kind = 'click'").select(
        "session", "t", "line_no",
        (50.0 + (F.col("session") % 10) * 0.01 + k * 0.0001).alias("lat"),
        (30.0 + (k * 7 % 100) * 0.0001).alias("lon"),
        (k * 1.0).alias("accuracy"),
        F.when(k % 5 == 0, -1.0).otherwise(F.col("value") / 10).alias("speed"),
        F.when(k % 7 == 0, -1.0).otherwise((k * 36 % 360).cast("double")).alias("course"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("node_id"), (500000000 + p % 45 * 9000).cast("long").alias("lat_e7"), (300000000 + F.floor(p / 45) * 14000).cast("long").alias("lon_e7"))
