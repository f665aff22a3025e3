"""Recordings: one JSON object per line, plain or in gzip members that carry their length, read past damage.

``spark.read.format("recording")`` gives (file, line_no, t, kind, data, raw, problem). Files are spread over
tasks by path; a task streams a file member by member and keeps one in memory. With ``recovery=strict`` the first
damage is an error; else damaged members and lines are skipped and reported by ``report``, a row per file.

A member is ``1f 8b 08 04``, an extra field with subfield ``DL`` (its compressed length, 32 bits little-endian), raw
deflate data, CRC-32 and size. A bad checksum drops that member only: the next one is found by its length.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The newest version of the format that is read.
VERSION = 5
EVENTS = "file string, line_no bigint, t bigint, kind string, data string, raw string"
REPORT = "file string, members int, truncated_tail boolean, damaged_members array<int>, skipped_lines array<bigint>, failure string"
TAIL = "file string, last_t bigint, members int, size bigint, bytes_read bigint"


class Member(NamedTuple):
    payload: bytes | None  # None: damaged
    soft: bytes | None  # what could be inflated in spite of a bad checksum
    tail: bool  # the file ends within it


def member(payload: bytes) -> bytes:
    """A gzip member with its length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(payload) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + b"DL" + struct.pack("<HI", 4, len(body))
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload) & 0xFFFFFFFF)


def deflate_length(extra: bytes) -> int | None:
    """The compressed length that an extra field holds."""
    length, at = None, 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"DL" and n == 4 and at + 8 <= len(extra):
            length = struct.unpack_from("<I", extra, at + 4)[0]
        at += 4 + n
    return length


def members(read) -> Iterator[Member]:
    """Members of a stream; ``read(n)`` returns up to n bytes."""
    while head := read(12):
        if len(head) < 12 or not any(head):
            yield Member(None, None, True)
            return
        if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
            raise ValueError("a gzip file without member lengths")
        length = deflate_length(read(struct.unpack_from("<H", head, 10)[0]))
        if length is None:
            raise ValueError("a gzip file without member lengths")
        body = read(length + 8)
        if len(body) < length + 8:
            yield Member(None, None, True)
            return
        crc, size = struct.unpack_from("<II", body, length)
        try:
            payload = zlib.decompress(body[:length], -15)
        except zlib.error:
            yield Member(None, None, False)
            continue
        ok = zlib.crc32(payload) == crc and len(payload) & 0xFFFFFFFF == size
        yield Member(payload if ok else None, payload, False)


def read_file(path: str, strict: bool) -> tuple[Iterator[tuple], dict]:
    """Rows of a file, and a report that is complete once they are read."""
    report = {"file": path, "members": 0, "truncated_tail": False, "damaged_members": [], "skipped_lines": [], "failure": None}

    def lines(stream) -> Iterator[bytes]:
        first = stream.read(2)
        if first != b"\x1f\x8b":
            rest = first
            while chunk := stream.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                yield from whole
            yield rest
            return
        held = [first]

        def read(n: int) -> bytes:
            out = held.pop() if held else b""
            while len(out) < n and (more := stream.read(n - len(out))):
                out += more
            return out

        rest = b""
        for k, m in enumerate(members(read)):
            report["members"] += 1
            if m.tail:
                report["truncated_tail"] = True
                report["members"] -= 1
                break
            payload = m.payload
            if payload is None:
                report["damaged_members"].append(k)
                if strict:
                    raise ValueError(f"damaged member {k}")
                payload = m.soft if k == 0 else b""
                if k == 0 and payload is None:
                    raise ValueError("damaged member 0")
            *whole, rest = (rest + payload).split(b"\n")
            yield from whole
        yield rest

    def rows() -> Iterator[tuple]:
        from pyarrow import fs

        number = -1
        try:
            system, at = fs.FileSystem.from_uri(path)
            with system.open_input_stream(at, compression=None) as stream:
                for raw in lines(stream):
                    raw = raw.rstrip(b"\r ")
                    if not raw:
                        continue
                    number += 1
                    try:
                        text = raw.decode("utf-8")
                        x = json.loads(text)
                        if number == 0:
                            version = x["formatVersion"]
                            if version > VERSION:
                                raise ValueError(f"format version {version} is newer than {VERSION}")
                            yield path, 0, None, "header", text, text
                        else:
                            if isinstance(x["t"], bool) or not isinstance(x["t"], int) or not isinstance(x["kind"], str):
                                raise TypeError("no event")
                            data = x.get("data")
                            yield path, number, x["t"], x["kind"], None if data is None else json.dumps(data, separators=(",", ":"), ensure_ascii=False), text
                    except (KeyError, TypeError, UnicodeDecodeError, json.JSONDecodeError):
                        if strict or number == 0:
                            raise ValueError("no header" if number == 0 else f"malformed line {number}") from None
                        report["skipped_lines"].append(number)
        except (OSError, ValueError) as problem:
            report["failure"] = str(problem)
            if strict:
                raise

    return rows(), report


def _last_t(lines: list[bytes]) -> int | None:
    for raw in reversed(lines):
        try:
            x = json.loads(raw)
            if isinstance(x["t"], int) and not isinstance(x["t"], bool) and isinstance(x["kind"], str):
                return x["t"]
        except (KeyError, TypeError, ValueError):
            continue
    return None


def read_tail(path: str) -> tuple:
    """A row of TAIL. Of a file of members only their heads and the last one are read (the ones before it, if that holds no
    event or is damaged); of a plain file, its end. Events are whole lines of one member, as they are written."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        size, used = f.size(), 0

        def read(start: int, n: int) -> bytes:
            nonlocal used
            f.seek(start)
            out = f.read(min(n, size - start))
            used += len(out)
            return out

        found: list[tuple[int, int]] = []  # where a whole member's data begins, and its length
        if read(0, 2) == b"\x1f\x8b":
            offset = 0
            while offset + 12 <= size:
                head = read(offset, 20)  # extra fields of other tools may be longer
                more = struct.unpack_from("<H", head, 10)[0]
                length = deflate_length(head[12 : 12 + more] if more <= 8 else read(offset + 12, more)) if head[:3] == b"\x1f\x8b\x08" and head[3] & 4 else None
                if length is None or offset + 12 + more + length + 8 > size:
                    break
                found.append((offset + 12 + more, length))
                offset += 12 + more + length + 8
            for k in reversed(range(len(found))):
                body = read(found[k][0], found[k][1] + 8)
                try:
                    payload = zlib.decompress(body[:-8], -15)
                except zlib.error:
                    continue
                if struct.unpack("<II", body[-8:]) != (zlib.crc32(payload), len(payload) & 0xFFFFFFFF):
                    continue
                last = _last_t([x for x in payload.split(b"\n") if x.strip()][k == 0 :])  # the first line is the header
                if last is not None:
                    return path, last, len(found), size, used
            return path, None, len(found), size, used
        block, start, held = 1 << 16, size, b""
        while start > 0:
            n = min(block, start)
            start, block = start - n, 2 * block
            held = read(start, n) + held
            last = _last_t([x for x in held.split(b"\n") if x.strip()][1:])  # a part of a line, or the header
            if last is not None:
                return path, last, 0, size, used
        return path, None, 0, size, used


class _Partition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        paths = self.options["paths"].split("\n")
        n = min(len(paths), int(self.options.get("partitions", 64)))
        return [_Partition(paths[k::n]) for k in range(n)]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        strict = self.options.get("recovery") == "strict"
        for p in partition.paths:
            if self.options.get("mode") == "tail":
                yield read_tail(p)
                continue
            rows, report = read_file(p, strict)
            if self.options.get("mode") == "report":
                for _ in rows:
                    pass
                yield tuple(report.values())
            else:
                yield from rows


class RecordingSource(DataSource):
    """The ``recording`` format: options paths (one a line), recovery, mode (events, report or tail)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return {"report": REPORT, "tail": TAIL}.get(self.options.get("mode"), EVENTS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _read(spark: SparkSession, paths: list[str], mode: str, recovery: str) -> DataFrame:
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recording").option("paths", "\n".join(paths)).option("mode", mode).option("recovery", recovery).load()


def recordings(spark: SparkSession, paths: list[str], recovery: str = "skip") -> DataFrame:
    """Events of recordings, the header as line 0; unknown kinds are kept as they are."""
    return _read(spark, paths, "events", recovery)


def read_report(spark: SparkSession, paths: list[str], recovery: str = "skip") -> DataFrame:
    """One row per file: members, truncated tail, damaged members, skipped lines, failure."""
    return _read(spark, paths, "report", recovery)


def tails(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: the time of its last event, its whole members, its size and how many bytes were read for that."""
    return _read(spark, paths, "tail", "skip")


def tails_of(batches: Iterator) -> Iterator:
    """For ``mapInArrow`` over files (file, session, events): (session, events, last_t, bytes_read), for more files than a list of paths should name."""
    import pyarrow as pa

    for b in batches:
        rows = [read_tail(p) for p in b.column("file").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("session"), b.column("events"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["session", "events", "last_t", "bytes_read"])


def catalogue(events: DataFrame) -> DataFrame:
    """Header fields, first and last time of each file, the newest start first."""
    h = F.col("line_no") == 0
    c = events.groupBy("file").agg(F.max(F.when(h, F.get_json_object("data", "$.sessionID"))).alias("session_id"), F.max(F.when(h, F.get_json_object("data", "$.startedAt"))).alias("started_at"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(~h).alias("events"))
    return c.orderBy(F.desc_nulls_last("started_at"), "file")
