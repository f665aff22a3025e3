"""The filter: it follows a drive, is the same for a stream and a batch, and doesn't look ahead."""

import numpy as np
from pyspark.sql import functions as F

from wayloom.streaming import filter as P


def test_follows_a_circle(spark):
    est = P.replay(P.synthetic_drive(spark, 2, 40)).toPandas()
    last = est[est.t == 40 * 10**9]
    a = 40 * 0.02
    lat, lon = 50 + np.sin(a) * 750 / P.DEGREE, 30 + (1 - np.cos(a)) * 750 / (P.DEGREE * 0.6427876)
    error = np.hypot((last.lat - lat) * P.DEGREE, (last.lon - lon) * P.DEGREE * 0.6427876)
    assert len(last) == 2 and (error < 40).all()


def test_causal(spark):
    rows = P.synthetic_drive(spark, 1, 20)
    whole = P.replay(rows).where("t <= 10000000000").toPandas()
    part = P.replay(rows.where(F.col("arrival") <= 10_000_000_000)).toPandas()
    assert np.allclose(whole[part.columns].to_numpy(), part.to_numpy())


def test_stream_equals_batch(spark, tmp_path):
    rows = P.synthetic_drive(spark, 3, 12).persist()
    for k, (a, b) in enumerate(((0, 4), (4, 9), (9, 13))):
        rows.where(f"arrival >= {a}000000000 and arrival < {b}000000000").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = P.stream(src).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(P.ESTIMATE).parquet(f"{tmp_path}/out").toPandas().sort_values(["session", "t"])
    want = P.replay(rows).toPandas().sort_values(["session", "t"])
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_tasks_are_not_merged_and_sessions_pass_batches(spark):
    rows = P.synthetic_drive(spark, 3, 6)
    want = rows.toPandas().sort_values(["session", "arrival", "line_no"])
    want = [x for s, g in want.groupby("session") for x in P._run(P.Cloud(s), s, g)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        est = P.replay(rows)
        assert est.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        got = est.toPandas().sort_values(["session", "t"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.array_equal(got.to_numpy(), np.array(want))
