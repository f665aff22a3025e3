"""Every query with SQL gives the same rows as DuckDB does; the others give rows."""

import pytest

from conftest import SF, rows_of
from wayloom import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = rows_of(QUERIES[name](spark, SF).toArrow())
    want = duck.sql(SQL[name]).arrow()
    want = rows_of(want.read_all() if hasattr(want, "read_all") else want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry_imports():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.queries())


def test_fnv_vectors(spark):
    from pyspark.sql import functions as F

    h = {r["line_no"]: r["hash"] for r in QUERIES["fnv1a64"](spark, SF).orderBy("line_no").limit(20).collect()}
    p = {r["event_id"]: r["props"] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props").where(F.col("event_id").isin(list(h))).collect()}
    for k, text in p.items():
        x = 0xCBF29CE484222325
        for b in text.encode():
            x = (x ^ b) * 0x100000001B3 & (2**64 - 1)
        assert h[k] == f"{x:016x}"
