"""Operator 7: media columns, with types found by their signatures.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob. At each hit the
format's validator walks the structure (chunks, checksums, declared sizes) and tells the true length, or that
it is none. The outermost valid hits are carved; the first one at offset 0 that spans the blob is its type,
whatever was declared.

``as_media`` stores a payload losslessly as 8-bit samples in PNG, BMP, PGM or WAV, ``samples`` reads it back.

Results for odd input: a null or empty blob has no type and carves nothing; signatures inside a valid medium
belong to it; of two hits at one offset the longer valid one counts; truncated media are not valid; a very long blob is
walked whole; rows that repeat are sniffed each by itself and alike; an empty table gives no rows; other columns are
ignored. ``features`` skips nothing: a blob that isn't one whole medium has null for what is read from its samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, stored

#: Samples in a row of an image; payloads are padded to a multiple of it.
ROW = 192
PAD = b"\x20"


# fixed values: signatures of the formats
PNG, BMP, PGM, RIFF = b"\x89PNG\r\n\x1a\n", b"BM", b"P5\n", b"RIFF"
GIFS, JPEG, GZIP, AU = (b"GIF87a", b"GIF89a"), b"\xff\xd8\xff", b"\x1f\x8b\x08", b".snd"


def _png(b: bytes, at: int) -> int:
    p, seen = at + 8, False
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind = b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        if not seen and kind != b"IHDR":
            return 0
        seen = True
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, pixels, head, w, h, planes, bits, packing, _ = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if zero or planes != 1 or packing or bits not in (8, 24) or head != 40 or w <= 0 or size > len(b) - at:
        return 0
    row = (w * bits // 8 + 3) // 4 * 4
    return size if size == pixels + row * abs(h) else 0


def _pgm(b: bytes, at: int) -> int:
    head = b[at : at + 40].split(b"\n", 3)
    try:
        w, h = map(int, head[1].split())
        most = int(head[2])
    except (ValueError, IndexError):
        return 0
    n = 3 + len(head[1]) + 1 + len(head[2]) + 1 + w * h
    return n if len(head) == 4 and most == 255 and w > 0 and h > 0 and at + n <= len(b) else 0


def _wav(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    n = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    p, kinds = at + 12, []
    while p + 8 <= min(at + n, len(b)):
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        kinds.append(b[p : p + 4])
        p += 8 + size + (size & 1)
    return n if at + n <= len(b) and p == at + n and b"fmt " in kinds and b"data" in kinds else 0


def _gif(b: bytes, at: int) -> int:
    p = at + 13
    if p > len(b):
        return 0
    if b[at + 10] & 0x80:
        p += 3 << ((b[at + 10] & 7) + 1)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 10 + ((3 << ((b[p + 9] & 7) + 1)) if b[p + 9] & 0x80 else 0) + 1
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        if kind == 0xDA:
            while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7):
                q = b.find(b"\xff", p + 1)
                p = len(b) if q < 0 else q
    return p + 2 - at if p + 2 <= len(b) and b[p : p + 2] == b"\xff\xd9" else 0


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        p = at
        while not d.eof and p < len(b):
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


def _au(b: bytes, at: int) -> int:
    if at + 24 > len(b):
        return 0
    head, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return head + size if head >= 24 and 1 <= coding <= 27 and 0 < channels <= 64 and 0 < rate <= 1 << 20 and head + size <= len(b) - at else 0


#: format: its signatures and its validator (the true length at an offset, 0 if it isn't one).
FORMATS: dict[str, tuple[tuple[bytes, ...], Callable[[bytes, int], int]]] = {
    "png": ((PNG,), _png),
    "bmp": ((BMP,), _bmp),
    "pgm": ((PGM,), _pgm),
    "wav": ((RIFF,), _wav),
    "gif": (GIFS, _gif),
    "jpeg": ((JPEG,), _jpeg),
    "gzip": ((GZIP,), _gzip),
    "au": ((AU,), _au),
}


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for name, (signs, _) in FORMATS.items():
        for s in signs:
            a.add_word(s.decode("latin-1"), (name, len(s)))
    a.make_automaton()
    return a


def carve(blob: bytes | None) -> list[tuple[int, int, str]]:
    """(offset, length, format) of the outermost valid media of a blob, in order."""
    found, until = [], 0
    if not blob:
        return found
    hits = sorted(((end - n + 1, name) for end, (name, n) in automaton().iter(blob.decode("latin-1"))))
    k = 0
    while k < len(hits):
        at = hits[k][0]
        best = (0, "")
        while k < len(hits) and hits[k][0] == at:
            if at >= until:
                best = max(best, (FORMATS[hits[k][1]][1](blob, at), hits[k][1]))
            k += 1
        if best[0]:
            found.append((at, best[0], best[1]))
            until = at + best[0]
    return found


SNIFFED = "type string, declared string, corrected boolean, media array<struct<offset: long, length: long, type: string>>"


def sniff(blobs: DataFrame, blob_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` with the true type of each blob (null: none), what was declared, whether that is corrected, and the media carved from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            declared = b.column("declared").to_pylist()
            found, types = [], []
            for x in b.column("blob"):
                x = x.as_py()
                media = carve(x)
                types.append(media[0][2] if media and media[0][:2] == (0, len(x)) else None)
                found.append([{"offset": o, "length": n, "type": t} for o, n, t in media])
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
            corrected = [t is not None and t != d for t, d in zip(types, declared)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(types, pa.string()), b.column("declared"), pa.array(corrected), pa.array(found, kind)], [*keep, "type", "declared", "corrected", "media"])

    rows = blobs.select(*keep, F.col(blob_col).alias("blob"), F.col(declared_col).cast("string").alias("declared"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name not in ("blob", "declared"))
    return rows.mapInArrow(run, fields + SNIFFED)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def as_media(payload: bytes, kind: str) -> bytes:
    """The payload (a positive multiple of ROW bytes) as 8-bit samples of a medium."""
    rows = len(payload) // ROW
    if kind == "png":
        lines = np.zeros((rows, ROW + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
        return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")
    if kind == "bmp":
        palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", BMP, 54 + 1024 + len(payload), 0, 54 + 1024, 40, ROW, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (ROW, rows) + payload
    return struct.pack("<4sI4s4sIHHIIHH4sI", RIFF, 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes, kind: str) -> bytes:
    """The 8-bit samples of a valid medium, in order."""
    if kind == "png":
        p, data = 8, b""
        while p < len(media):
            n = int.from_bytes(media[p : p + 4], "big")
            if media[p + 4 : p + 8] == b"IDAT":
                data += media[p + 8 : p + 8 + n]
            p += 12 + n
        w, h = struct.unpack_from(">II", media, 16)
        lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w + 1)
        if lines[:, 0].any():
            raise ValueError("filtered PNG lines are not read here")
        return lines[:, 1:].tobytes()
    if kind == "bmp":
        pixels, = struct.unpack_from("<I", media, 10)
        w, h = struct.unpack_from("<ii", media, 18)
        lines = np.frombuffer(media, np.uint8, offset=pixels).reshape(abs(h), -1)[:, :w]
        return (lines if h < 0 else lines[::-1]).tobytes()
    if kind == "pgm":
        return media.split(b"\n", 3)[3]
    p = 12
    while media[p : p + 4] != b"data":
        p += 8 + int.from_bytes(media[p + 4 : p + 8], "little")
    return media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column for texts: id, n_bytes, declared (wrong for a third of the payloads) and the stored bytes, written as a table."""
    kinds = ("png", "bmp", "pgm", "wav")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "declared", "media"]
        for b in batches:
            done, total, rows = 0, 0, []
            for k, t in enumerate(b.column("text")):
                raw = (t.as_py() or "").encode()
                payload = raw + PAD * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))
                pick = zlib.crc32(payload)
                kind = kinds[pick % 4]
                rows.append((len(raw), kinds[(pick + 1) % 4] if pick // 4 % 3 == 0 else kind, as_media(payload, kind)))
                total += len(payload)
                if total >= 1 << 23 or k + 1 == b.num_rows:
                    sizes, declared, media = zip(*rows)
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(done, len(rows)), pa.array(sizes, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], names)
                    done, total, rows = k + 1, 0, []

    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(build, "id long, n_bytes long, declared string, media binary"), "media", "zstd")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, declared_type string, corrected boolean"


def features(table: DataFrame) -> DataFrame:
    """Reads the stored bytes back: each medium is sniffed and carved, then decoded to its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, declared, x in zip(b.column("id"), b.column("n_bytes"), b.column("declared"), b.column("media")):
                blob = x.as_py()
                at, size, kind = next(iter(carve(blob)), (0, 0, None))
                if at or size != len(blob):  # broken, or something else around it
                    rows.append((i.as_py(), n.as_py(), None, None, None, len(blob), hashlib.sha256(blob).hexdigest(), "no whole medium", None, declared.as_py(), True))
                    continue
                medium = blob
                data = samples(medium, kind)
                s = np.frombuffer(data, np.uint8)
                p = np.bincount(s, minlength=256) / max(1, len(s))
                entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
                values = p @ np.arange(256)
                spread = float(np.sqrt(max(0.0, p @ (np.arange(256) ** 2) - values**2)))
                rows.append((i.as_py(), n.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), size, hashlib.sha256(medium).hexdigest(), f"{kind} 8-bit n={len(data)} mean={values:.4f} std={spread:.4f} entropy={entropy:.4f}", kind, declared.as_py(), kind != declared.as_py()))
            names = [f.split()[0] for f in FEATURES.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            types = [kinds[f.split()[1]] for f in FEATURES.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return table.mapInArrow(run, FEATURES)


def op7_media_sniffing(spark, sf_dir: str) -> DataFrame:
    """All documents' texts stored as media under partly wrong types, read back by their signatures."""
    return features(stored_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
