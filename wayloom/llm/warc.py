"""Operator 2: WARC archives with segmented records, written and read back.

Writing: every page becomes one record, an HTTP response whose body is in chunked transfer framing. Pages of
equal payloads are found first (a digest per row, grouped with map-side combining): the one with the
largest id is a ``response``, the others are ``revisit`` records that refer to it. A block longer than
``segment`` bytes is cut: the first part is segment 1, the others are ``continuation`` records in another archive
of the same task. Each task streams its records into gzip members; archives roll over at a size.

Reading: tasks stream the archives that the manifest names (a task that was run twice leaves files that no
manifest names). Continuation records are grouped by their origin's identifier, ordered by segment number and
checked against the total length; then chunked framing is decoded and the payload's digest verified.
Revisits take their length from the record they refer to, by a join on the record identifier.

Results for odd input: a null payload is empty; rows that repeat an id with an equal payload are each a record
of the same type, and with other payloads records of their own (record identifiers are made of id and payload); a very
long payload is cut into segments; a row with a null id is a response only if no equal payload has an id; a null url is empty;
an empty table writes no archive and gives no rows; other columns are ignored. A missing segment, a wrong
total length, broken framing or a wrong digest is an error in strict reading and else marked in ``problem``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MAX_BROADCAST_KEYS, keep, owned, scratch, small_batches, stored, table_path

SEGMENT = 32 << 10
CHUNK = 8 << 10
ARCHIVE = 64 << 20

_SPACE = uuid.UUID("6d2b4a7e-3c7e-5f0e-9d8e-2f6f0a51c001")
_DATE = "2024-01-01T00:00:00Z"


def record_id(page: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {page} {payload_digest}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, p = [], 0
    while True:
        e = body.index(b"\r\n", p)
        n = int(body[p:e].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        piece = body[e + 2 : e + 2 + n]
        if len(piece) != n or body[e + 2 + n : e + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(piece)
        p = e + 4 + n


def record(kind: str, rid: str, block: bytes, fields: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": _DATE, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page: int | None, url: str, payload: bytes, refers_to: int | None, is_revisit: bool, segment: int = SEGMENT) -> list[bytes]:
    """The record of a page: one, or the first segment and its continuations."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    said = digest(payload)
    own = record_id(page, said)
    fields = {"WARC-Target-URI": " ".join(url.split()), "WARC-Payload-Digest": "sha1:" + said, "WARC-Page": "" if page is None else str(page)}
    if is_revisit:
        fields |= {"WARC-Refers-To": record_id(refers_to, said), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [record("revisit", own, http + b"\r\n", fields | {"Content-Type": "application/http; msgtype=response"})]
    fields["Content-Type"] = "application/http; msgtype=response"
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record("response", own, block, fields)]
    origin = f"<urn:uuid:{uuid.uuid4()}>"  # of this row's segments, also where rows repeat an id
    out, parts = [], [block[k : k + segment] for k in range(0, len(block), segment)]
    for k, part in enumerate(parts):
        if k == 0:
            out.append(record("response", origin, part, fields | {"WARC-Segment-Number": "1", "WARC-Refers-Page-ID": own}))
        else:
            more = {"WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": str(k + 1)}
            if k + 1 == len(parts):
                more["WARC-Segment-Total-Length"] = str(len(block))
            out.append(record("continuation", f"<urn:uuid:{uuid.uuid4()}>", part, more))
    return out


class _Archive:
    """A gzip file of one member per record, in any file system that Arrow knows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, at = fs.FileSystem.from_uri(self.path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out, self.bytes, self.records = system.open_output_stream(at, compression=None), 0, 0

    def add(self, data: bytes) -> None:
        member = gzip.compress(data, 1)
        self.out.write(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Writes all pages into archives under ``folder``; the manifest (path, records, bytes) is stored and returned."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = rows.withColumn("d", F.unhex(F.sha2("payload", 256)))
    groups = keyed.groupBy("d").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("d", "keep")
    groups = stored(groups, "equal")
    few = groups.count() <= MAX_BROADCAST_KEYS // 4
    joined = keyed.join(F.broadcast(groups) if few else groups, "d", "left")
    joined = joined.select("id", "url", "payload", "keep", (F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))).alias("again"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = rest = None
        done = []
        for b in batches:
            for i, u, p, k, again in zip(*(b.column(c) for c in ("id", "url", "payload", "keep", "again"))):
                parts = page_records(i.as_py(), u.as_py(), p.as_py().encode(), k.as_py(), bool(again.as_py()), segment)
                first = first or _Archive(folder)
                first.add(parts[0])
                for part in parts[1:]:
                    rest = rest or _Archive(folder)
                    rest.add(part)
                if first.bytes >= archive:
                    done.append(first.close())
                    first = None
                if rest and rest.bytes >= archive:
                    done.append(rest.close())
                    rest = None
        done += [x.close() for x in (first, rest) if x]
        columns = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    small_batches(pages.sparkSession, 500)
    return stored(joined.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def stream_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, one in memory at a time."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"no record where one should begin in {path}")
            head = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            yield head, f.read(int(head["content-length"]))


PARTS = "kind string, record string, origin string, segment long, total long, page string, refers string, digest string, payload_bytes long, payload binary, block binary, problem string"


def _decode(block: bytes, said: str | None) -> tuple[bytes | None, str | None]:
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        lines = [x.split(b":", 1) for x in head.split(b"\r\n")[1:]]
        fields = {x[0].strip().lower(): x[1].strip().lower() for x in lines if len(x) == 2}
        payload = unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body
    except ValueError:
        return None, "broken framing"
    return payload, None if said is None or said.rpartition(":")[2] == digest(payload) else "wrong digest"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, segments put together: kind, record, page, refers, digest,
    payload_bytes, payload (null if not asked for, and of revisits) and problem."""
    spark = manifest.sparkSession
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in PARTS.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                for h, block in stream_records(path):
                    kind, rid, segment = h["warc-type"], h["warc-record-id"], h.get("warc-segment-number")
                    said = h.get("warc-payload-digest")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    total = h.get("warc-segment-total-length")
                    base = (kind, h.get("warc-refers-page-id", rid), h.get("warc-segment-origin-id", rid if segment else None), int(segment) if segment else None, int(total) if total else None, h.get("warc-page"), h.get("warc-refers-to"), said and said.rpartition(":")[2])
                    if segment:
                        rows.append((*base, None, None, block, None))
                    elif kind == "revisit":
                        rows.append((*base, None, None, None, None))
                    else:
                        payload, problem = _decode(block, said)
                        rows.append((*base, len(payload or b""), payload if payloads else None, None, problem))
                    size += len(block)
                    if size >= 1 << 22 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    def join(table: pa.Table) -> pa.Table:
        """One origin's segments in order; its first record has the page and the digest."""
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        head, block = rows[0], b"".join(r["block"] for r in rows)
        payload, problem = None, None
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or head["kind"] != "response":
            problem = "missing segment"
        elif rows[-1]["total"] != len(block):
            problem = "wrong total length"
        else:
            payload, problem = _decode(block, head["digest"] and "sha1:" + head["digest"])
        head |= {"payload_bytes": len(payload or b""), "payload": payload if payloads else None, "block": None, "problem": problem}
        return pa.Table.from_pylist([head], schema)

    size = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    files = max(1, min(size["n"], 4096), size["b"] >> 28)  # 256 MB of archives a task at most
    parts = stored(manifest.select("path").repartition(files, "path").mapInArrow(read, PARTS), "records", "zstd")
    whole = parts.where("segment is null")
    joined = parts.where("segment is not null").groupBy("origin").applyInArrow(join, PARTS.replace("origin string, ", "origin string, "))
    return whole.unionByName(joined).drop("block", "segment", "total", "origin")


def resolve(records: DataFrame, strict: bool = True) -> DataFrame:
    """One row per page: page, record_type, payload_bytes, digest, refers_page; a revisit has its response's."""
    if strict:
        ok = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.col("record")))).otherwise(F.col("kind"))
        records = records.withColumn("kind", ok.cast("string"))
    targets = records.where("kind = 'response'").groupBy(F.col("record").alias("refers")).agg(F.max("page").alias("refers_page"), F.max("payload_bytes").alias("far_bytes"), F.max("digest").alias("far_digest"))
    again = records.where("kind = 'revisit'").select("page", "refers", "digest").join(targets, "refers", "left")
    if strict:
        same = F.when(F.col("digest").eqNullSafe(F.col("far_digest")), F.col("far_bytes")).otherwise(F.raise_error(F.lit("a revisit has another digest than its response")).cast("long"))
    else:
        same = F.col("far_bytes")
    plain = records.where("kind = 'response'").select("page", F.lit("response").alias("record_type"), "payload_bytes", "digest", F.lit(None).cast("string").alias("refers_page"))
    return plain.unionByName(again.select("page", F.lit("revisit").alias("record_type"), same.alias("payload_bytes"), "digest", "refers_page"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written into archives in the shared folder and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with scratch(spark):
        manifest = write_archives(pages, owned(table_path(spark, "archives")))
        records = keep(stored(read_archives(manifest, payloads=False), "read"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return resolve(records).select(number("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_page").alias("refers_to"))
