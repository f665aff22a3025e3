"""Recordings written by Spark: files of gzip members, named by a commit.

``write_recordings`` sorts events by ranges of (session, time), so that a session with a third of all rows is spread over tasks as
parts that follow each other. A task streams its rows into one file for each session it has; a member ends before it holds more than
``MEMBER_BYTES`` of JSON (a longer line is a member of its own) or more than ``span_ns`` of time. Files have names of their own for each attempt. Each
task lists its files in a small file, and the commit names these lists, one for each task: only what it names counts. So a
task that runs twice, or dies half way, leaves no row twice and no half file; a job that is run again under its name is dropped if
the first one was committed.

Results for odd input: null sessions are a session of their own; a null time, kind or line is an error (a
reader would skip it); a null payload is written as ``null``; rows of one time keep ``order``; an empty table commits no file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .recording import VERSION, member, read_file

#: JSON of one member, at most.
MEMBER_BYTES = 8 << 20
FILES = "file string, session string, part int, first_t bigint, last_t bigint, events bigint, members int, bytes bigint"
ROWS = "session string, part int, line_no bigint, t bigint, kind string, data string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    system, at = _open(uri)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at, compression=None) as out:
        out.write(data)


class _File:
    """A recording of one session that is being written."""

    def __init__(self, uri: str, session: str | None, part: int, member_bytes: int, span: int | None):
        self.uri, self.session, self.part, self.most, self.span = uri, session, part, member_bytes, span
        system, at = _open(uri)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(at, compression=None)
        self.held: list[bytes] = []
        self.size = self.members = self.events = self.bytes = 0
        self.first = self.last = self.since = None
        self.line(json.dumps({"formatVersion": VERSION, "part": part, "sessionID": session}).encode())
        self.flush()  # the header is a member of its own

    def line(self, text: bytes) -> None:
        self.held.append(text)
        self.size += len(text) + 1

    def add(self, t: int, text: bytes) -> None:
        if self.held and (self.size + len(text) + 1 > self.most or (self.span is not None and t - self.since > self.span)):
            self.flush()
        self.since = t if not self.held else self.since
        self.line(text)
        self.first, self.last, self.events = t if self.first is None else self.first, t, self.events + 1

    def flush(self) -> None:
        if self.held:
            data = member(b"\n".join(self.held) + b"\n")
            self.out.write(data)
            self.bytes, self.members = self.bytes + len(data), self.members + 1
            self.held, self.size = [], 0

    def close(self) -> dict:
        self.flush()
        self.out.close()
        return {"file": self.uri, "session": self.session, "part": self.part, "first_t": self.first, "last_t": self.last, "events": self.events, "members": self.members, "bytes": self.bytes}


@dataclass
class _Message(WriterCommitMessage):
    listed: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.job = options["path"].rstrip("/"), options["job"]
        self.member_bytes = int(options.get("memberBytes", MEMBER_BYTES))
        self.span = int(options["spanNs"]) if options.get("spanNs") else None

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, own = [], None
        for batch in batches:
            for session, t, line in zip(*(batch.column(c).to_pylist() for c in ("session", "t", "line"))):
                if t is None or line is None:
                    raise ValueError("an event without time or kind can't be written")
                if own is None or own.session != session:
                    files += [own.close()] if own else []
                    name = re.sub("[^A-Za-z0-9_-]", "_", session or "none")[:80]
                    own = _File(f"{self.folder}/data/Drive_{name}_{part:06d}_{len(files)}_{attempt}.jsonl.gz", session, part, self.member_bytes, self.span)
                own.add(t, line.encode())
        files += [own.close()] if own else []
        listed = f"{self.folder}/lists/{self.job}/{attempt}.jsonl"
        _put(listed, "".join(json.dumps(f) + "\n" for f in files).encode())
        return _Message(listed)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Names the tasks' lists; a job that was committed before stays as it was."""
        done = f"{self.folder}/commits/{self.job}.json"
        system, at = _open(done)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        new = f"{done}.{uuid.uuid4().hex}"
        _put(new, json.dumps([m.listed for m in messages if m]).encode())
        system.move(_open(new)[1], at)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                system, at = _open(m.listed)
                with system.open_input_stream(at) as listed:
                    for line in listed.read().splitlines():
                        system.delete_file(_open(json.loads(line)["file"])[1])
                system.delete_file(at)


class RecordingSink(DataSource):
    """The ``recording_files`` format (write only): options path, job, memberBytes, spanNs; columns session, t, line."""

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def event_line(t: Column, kind: Column, data: Column) -> Column:
    """An event as JSON with sorted keys; ``data`` is JSON itself."""
    rest = F.to_json(F.struct(kind.alias("kind"), t.alias("t")), {"ignoreNullFields": "false"})
    return F.when(t.isNotNull() & kind.isNotNull(), F.concat(F.lit('{"data":'), F.coalesce(data, F.lit("null")), F.lit(","), F.substring(rest, 2, 1 << 30)))


def write_recordings(events: DataFrame, folder: str, job: str, order: str = "line_no", parts: int | None = None, member_bytes: int = MEMBER_BYTES, span_ns: int | None = None) -> None:
    """Writes events (session, t, kind, data and ``order`` for equal times) as recordings under ``folder``."""
    spark = events.sparkSession
    spark.dataSource.register(RecordingSink)
    keys = ["session", "t", "__order"]
    rows = events.select(F.col("session").cast("string").alias("session"), F.col("t").cast("long").alias("t"), F.col(order).alias("__order"), event_line(F.col("t").cast("long"), F.col("kind"), F.col("data")).alias("line"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("session", "t", "line")
    out = rows.write.format("recording_files").mode("append").option("path", folder).option("job", job).option("memberBytes", str(member_bytes))
    (out.option("spanNs", str(span_ns)) if span_ns is not None else out).save()


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """FILES of all committed jobs; the driver reads one name for each task that wrote."""
    system, at = _open(f"{folder.rstrip('/')}/commits")
    names: list[str] = []
    for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                names += json.loads(f.read())
    return spark.read.schema(FILES).json(names) if names else spark.createDataFrame([], FILES)


def written_events(spark: SparkSession, folder: str) -> DataFrame:
    """ROWS of all committed recordings: a file is read by one task, line by line; parts of a session follow each other by ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for file, session, part in zip(*(b.column(c).to_pylist() for c in ("file", "session", "part"))):
                rows, report = read_file(file, strict=True)
                held = []
                for _, number, t, kind, data, _ in rows:
                    if number:
                        held.append((session, part, number, t, kind, data))
                    if len(held) == 1000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    files = committed(spark, folder).select("file", "session", "part")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(run, ROWS)
