"""Shared helpers: tables in the cluster's shared folder, size-checked semi joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Keys that may be broadcast (8-byte ids: at most about 16 MB with their hash table).
MAX_BROADCAST_KEYS = 400_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``. Where it is unset, a
    temporary one serves if driver and executor are one process (tests); on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wayloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wayloom/{uuid.uuid4().hex}/{label}"


#: The open scopes of this thread, innermost last: the tables that each has written, by path, with the DataFrames that read them.
_scopes: ContextVar[tuple[dict[str, DataFrame | None], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for those named to ``keep``: these go to the scope around it, or stay
    where there is none, until ``release``. What leaves the scope may read kept tables only. Threads have scopes of their own."""
    own: dict[str, DataFrame | None] = {}
    around = _scopes.get()
    _scopes.set((*around, own))
    try:
        yield
    finally:
        _scopes.set(around)
        for path in own:
            remove(spark, path)


def _innermost() -> dict[str, DataFrame | None]:
    return (_scopes.get() or ({},))[-1]


def keep(df: DataFrame) -> DataFrame:
    """Hands a stored table of the innermost scope to the scope around it."""
    scopes, own = _scopes.get(), _innermost()
    for path, one in list(own.items()):
        if one is df:
            del own[path]
            if len(scopes) > 1:
                scopes[-2][path] = df
    return df


def release(df: DataFrame) -> None:
    """Removes the kept tables that a result reads, once it isn't needed any more."""
    spark = df.sparkSession
    here = f"{shared_dir(spark)}/wayloom/".split("://")[-1].replace("//", "/")
    for name in df.inputFiles():
        at = name.split("://")[-1]
        if here in at:
            table = at.split(here, 1)[1].split("/")
            remove(spark, f"{shared_dir(spark)}/wayloom/{table[0]}/{table[1]}")


def owned(path: str) -> str:
    """A folder (of files that tasks write themselves) that ends with the innermost scope."""
    _innermost()[path] = None
    return path


def drop(*tables: DataFrame) -> None:
    """Removes stored tables of the innermost scope whose consumers are written."""
    own = _innermost()
    for df in tables:
        for path, one in list(own.items()):
            if one is df:
                del own[path]
                remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])  # the folder of its own around each table
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives executors."""
    path = table_path(df.sparkSession, label)
    _innermost()[path] = None
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _innermost()[path] = out
    return out


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what it freed goes back to the system at its end. Workers are used again and wait
    between tasks, so what their allocators keep would count against the executor's memory all the time."""

    def task(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Bound the rows (and bytes) of one Arrow batch, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def restrict(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi", limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Semi or anti join against stored distinct ``keys``; they are broadcast only when counted and few,
    and shuffled with ``df`` otherwise."""
    few = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if few else keys, on, how)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest id of each component, over long or string ids.

    Alternating large-star and small-star passes (Kiveris et al. 2014): each is a min per node and a
    join, so no neighbourhood is ever gathered. Nodes without an edge do not appear; null ids are
    dropped and self loops ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = stored(e, "cc")
    while not _stars(e):
        old = e
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct(), "cc")
        drop(old)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node points at one other at most, which points at none."""
    return e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()


def joined_components(part: DataFrame | None, links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``part`` (node, component; nodes that it lacks are their own) after more links: only components are linked anew."""
    if part is None:
        return stored(connected_components(links, u, v), "components")
    far = lambda x: part.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    pairs = links.select(F.col(u).alias("u"), F.col(v).alias("v")).join(far("u"), "u", "left").join(far("v"), "v", "left")
    pairs = stored(pairs.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct(), "pairs")
    if pairs.isEmpty():
        return part
    over = stored(connected_components(pairs, "u", "v"), "over").select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = part.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = over.select(F.col("component").alias("node"), F.col("top").alias("component")).join(part.select("node"), "node", "left_anti")
    return stored(old.unionByName(new), "components")
