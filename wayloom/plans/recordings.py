"""Recordings: written by tasks and read back, and their tails."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import lineage
from ..sources import recording as S, recording_writer as W
from .base import events, query


def _recorded(spark, sf) -> str:
    """All events, written as recordings of several parts to a folder of their own."""
    folder = lineage.folder(spark, "recordings")
    e = events(spark, sf).select("session", "t", "kind", "line_no", F.to_json(F.struct("k")).alias("data"))
    W.write_recordings(e, folder, "all", member_bytes=4096)
    return folder


@query("written_recordings", "SELECT CAST(session AS VARCHAR) AS session, row_number() OVER (PARTITION BY session ORDER BY t, line_no) AS place, t, kind, k FROM @ev ")
def written_recordings(spark, sf):
    """Read back from what was written: the order is that of parts and lines."""
    rows = W.written_events(spark, _recorded(spark, sf))
    place = F.row_number().over(Window.partitionBy("session").orderBy("part", "line_no"))
    return rows.select("session", place.cast("long").alias("place"), "t", "kind", F.get_json_object("data", "$.k").cast("long").alias("k"))


@query("recording_tails", "SELECT CAST(session AS VARCHAR) AS session, max(t) AS last_t, count(*) AS events FROM @ev GROUP BY session")
def recording_tails(spark, sf):
    """The last time of each session from its files' tails."""
    files = W.committed(spark, _recorded(spark, sf))
    tails = files.select("file", "session", "events").mapInArrow(S.tails_of, "session string, events bigint, last_t bigint, bytes_read bigint")
    return tails.groupBy("session").agg(F.max("last_t").alias("last_t"), F.sum("events").alias("events"))
