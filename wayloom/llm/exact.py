"""Operator 5: exact deduplication with a binary-fuse filter per immutable snapshot.

Batches come one after another. The groups of earlier batches form an immutable snapshot: its digests are
split into buckets by their first bits, and each bucket gets a static binary-fuse filter. A new batch is
grouped by itself; its distinct digests meet the filters bucket by bucket. Those that a filter refuses are
new for certain; positives join the snapshot's exact buckets. Every group of more than one row is then
checked byte by byte (texts are grouped by digest *and* text, pre-aggregated in the map tasks), so equal
digests of different texts are told apart.

Buckets are as many as the larger side needs, and each digest stands once on either side, so no bucket is hot.

Results for odd input: a null text counts as empty; rows with a null id count in their group and stay only
if the group has no other id; rows that repeat an id with an equal text are the same document and are all
marked alike; a very long text is hashed and compared as a whole; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import fuse
from .common import drop, keep, lower_ascii, restrict, scratch, stored

#: Distinct digests of a snapshot bucket, about.
BUCKET_KEYS = 1 << 17
LEAST_BUCKETS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _bucket(buckets: int) -> Column:
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % buckets).cast("int")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """64-bit keys from bytes 4 to 12 of the digests (the bucket is taken from those before)."""
    return np.frombuffer(b"".join((x + bytes(12))[4:12] for x in column.to_pylist()), np.uint64)


def bucket_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter): one static filter for each bucket of a snapshot's distinct digests."""

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"].slice(0, 1), "filter": pa.array([fuse.build(_keys(table["digest"]))], pa.binary())})

    return groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's groups with ``maybe``: false where the snapshot's filter of their bucket excludes them."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, bool)
        for f in right["filter"].to_pylist():
            hit |= fuse.contains(f, _keys(left["digest"]))
        return left.select(["digest", "top_id", "n"]).append_column("maybe", pa.array(hit))

    left = groups.select("digest", "top_id", "n", _bucket(buckets).alias("bucket"))
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(look, "digest binary, top_id long, n long, maybe boolean")


def exact_groups(batches: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, late: Column | None = None) -> DataFrame:
    """One row for each row of the batches: id, digest, keep_id, group_size, kept.

    ``digest`` may be exchanged (tests use a weak one to force collisions). With ``late``, a column of the only DataFrame
    given, its rows are the snapshot where that is false and the batch where it is true.
    """
    texts = None
    for k, b in enumerate(batches):
        norm = lower_ascii(F.col(text_col))
        batch = F.lit(k) if late is None else late.cast("int")
        one = b.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), digest(norm).alias("digest"), batch.alias("batch"))
        texts = one if texts is None else texts.unionByName(one)
    with scratch(texts.sparkSession):
        return keep(stored(_grouped(texts, len(batches) if late is None else 2), "groups"))


def _grouped(texts: DataFrame, batches: int) -> DataFrame:
    rows = stored(texts.select("id", "digest", "batch"), "digests")
    group = lambda df: df.groupBy("digest").agg(F.max("id").alias("top_id"), F.count("*").alias("n"))
    groups = group(rows.where("batch = 0"))
    for k in range(1, batches):
        snapshot, batch = stored(groups, "snapshot"), stored(group(rows.where(F.col("batch") == k)), "batch")
        buckets = max(LEAST_BUCKETS, 1 << max(0, (max(snapshot.count(), batch.count()) // BUCKET_KEYS).bit_length()))
        filters = stored(bucket_filters(snapshot, buckets), "filters")
        new = stored(screen(batch, filters, buckets), "screened")
        drop(batch, filters)
        old = snapshot.select("digest", F.col("top_id").alias("old_id"), F.col("n").alias("old_n"))
        merged = old.join(new.where("maybe"), "digest", "full_outer").select("digest", F.greatest("top_id", "old_id").alias("top_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("n"))
        groups = merged.unionByName(new.where("not maybe").drop("maybe"))
    many = stored(groups.where("n > 1").select("digest"), "repeated")
    equal = restrict(texts, many, "digest").groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    equal = equal.select("digest", F.when(F.count("*").over(_per_digest()) > 1, F.col("norm")).alias("norm"), "keep_id", "group_size")
    equal = stored(equal, "equal")
    single = equal.where("norm is null").drop("norm")
    out = rows.select("id", "digest")
    clash = stored(equal.where("norm is not null"), "clash")
    bad = stored(clash.select("digest").distinct(), "clashing")
    if not bad.isEmpty():  # equal digests of different texts: joined by their bytes
        out = out.join(bad, "digest", "left_anti")
    out = out.join(single, "digest", "left").select("id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if not bad.isEmpty():
        out = out.unionByName(restrict(texts, bad, "digest").join(clash, ["digest", "norm"]).select("id", "digest", "keep_id", "group_size"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def _per_digest():
    from pyspark.sql import Window

    return Window.partitionBy("digest")


def second_half(id_col: str) -> Column:
    """The rows that arrive after the snapshot: ids with an odd crc32, and null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2, F.lit(1)) == 1


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in two batches: ids with an even crc32 are the snapshot, the others arrive later."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_groups([docs], late=second_half("doc_id"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose text a document of larger id repeats, as a snapshot and a batch. Rows with a null id stay."""
    with scratch(docs.sparkSession):
        found = exact_groups([docs], id_col, text_col, late=second_half(id_col))
        gone = keep(stored(found.where("not kept and id is not null").select(F.col("id").alias(id_col)).distinct(), "gone"))
    return restrict(docs, gone, id_col, "left_anti")
