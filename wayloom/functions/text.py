"""String expressions: adapter replies, hex, command guards, names, HTTP fields, CSV. Column functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def csv_field(c: Column) -> Column:
    """RFC 4180: quoted where it must be; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[",\r\n]'), quoted).otherwise(c), F.lit(""))


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def hex_bytes(c: Column) -> Column:
    """Clean upper-case hex digits, null where they aren't whole bytes."""
    bare = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.when(bare.rlike("^([0-9A-F]{2})*$"), bare)


def byte_at(digits: Column, k: int) -> Column:
    """Byte ``k`` of hex digits as a number; null beyond the end."""
    pair = F.substring(digits, 2 * k + 1, 2)
    return F.when(F.length(pair) == 2, F.conv(pair, 16, 10).cast("long"))


def reply_lines(raw: Column) -> Column:
    """Lines of a reply without prompts, blanks and progress messages."""
    trimmed = F.transform(F.split(raw, r"[\r\n]"), lambda x: F.btrim(F.replace(x, F.lit(">"), F.lit("")), F.lit(" \t\r\n")))

    def wanted(x: Column) -> Column:
        u = F.upper(x)
        return (x != "") & ~u.startswith("SEARCHING") & (~u.startswith("BUS INIT") | F.contains(u, F.lit("ERROR")))

    return F.filter(trimmed, wanted)


# fixed values: status lines of the adapter, without white space
STATUS = {
    "NODATA": "noData", "UNABLETOCONNECT": "unableToConnect", "STOPPED": "stopped", "BUSERROR": "busError",
    "CANERROR": "canError", "BUFFERFULL": "bufferFull", "DATAERROR": "dataError", "?": "notRecognised",
}


def status_code(line: Column) -> Column:
    """The error that a status line means, or null."""
    u = F.upper(F.regexp_replace(line, r"\s", ""))
    table = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, u), F.when(u.startswith("BUSINIT") & F.contains(u, F.lit("ERROR")), "busInitFailed").when(u.startswith("ERR"), "adapter"))


def frame_digits(raw: Column) -> Column:
    """Hex digits of a reply. Lines with an index are put in its order and cut to the declared length."""
    lines = reply_lines(raw)
    indexed = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    frames = F.transform(indexed, lambda x: F.struct(F.conv(F.substring_index(x, ":", 1), 16, 10).cast("int").alias("i"), hex_bytes(F.substring_index(x, ":", -1)).alias("d")))
    joined = F.concat_ws("", F.transform(F.array_sort(frames), lambda f: f.d))
    declared = F.conv(F.regexp_replace(F.element_at(F.filter(lines, lambda x: ~F.contains(x, F.lit(":"))), 1), r"\s", ""), 16, 10).cast("int")
    cut = F.when(F.length(joined) >= 2 * declared, F.substr(joined, F.lit(1), 2 * declared))
    plain = hex_bytes(F.concat_ws("", lines))
    return F.when(F.size(indexed) == 0, plain).otherwise(F.when(F.size(indexed) == F.size(lines), joined).otherwise(cut))


# fixed values: parameter ids with payload bytes and unit
PIDS = {4: (1, "%"), 5: (1, "degC"), 12: (2, "rpm"), 13: (1, "km/h"), 15: (1, "degC"), 17: (1, "%"), 47: (1, "%")}


def pid_bytes(pid: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (n, _) in PIDS.items() for x in (k, n))), pid.cast("int"))


def pid_unit(pid: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (_, u) in PIDS.items() for x in (k, u))), pid.cast("int"))


def pid_value(pid: Column, digits: Column) -> Column:
    """The measurement in a payload's hex digits; null for other ids or too few bytes."""
    a, b = byte_at(digits, 0).cast("double"), byte_at(digits, 1).cast("double")
    return F.when(pid.isin(4, 17, 47), a * 100 / 255).when(pid.isin(5, 15), a - 40).when(pid == 12, (a * 256 + b) / 4).when(pid == 13, a)


def supported_pids(digits: Column) -> Column:
    """Parameter ids set in a support reply (41, base, four mask bytes)."""
    base = byte_at(digits, 1)
    mask = F.conv(F.substring(digits, 5, 8), 16, 10).cast("long")
    ok = (byte_at(digits, 0) == 0x41) & (base % 32 == 0) & (base <= 0xE0) & (F.length(digits) >= 12)
    bits = F.filter(F.sequence(F.lit(1), F.lit(32)), lambda k: F.expr("1") == F.pmod(F.floor(mask / F.pow(F.lit(2.0), 32 - k)), F.lit(2)))
    return F.when(ok, F.transform(bits, lambda k: (base + k).cast("int")))


def pid_walk(digits: Column, requested: list[int]) -> Column:
    """Measurements of a reply to several ids: array of struct(pid, value), and what stopped the walk, as struct(items, error).

    A fold over at most as many steps as ids were requested."""
    n = F.length(digits) / 2
    items = F.array().cast("array<struct<pid:int,value:double>>")
    start = F.struct(F.lit(1).alias("at"), items.alias("items"), F.when(byte_at(digits, 0) != 0x41, "mode").alias("error"))

    def byte(at: Column, k: int = 0) -> Column:
        pair = F.substr(digits, 2 * (at + k) + 1, F.lit(2))
        return F.when(F.length(pair) == 2, F.conv(pair, 16, 10).cast("int"))

    def step(s: Column, _: Column) -> Column:
        pid = byte(s.at)
        need = pid_bytes(pid)
        done = s.error.isNotNull() | (s.at >= n)
        bad = ~pid.isin(requested) | F.exists(s["items"], lambda i: i.pid == pid)
        short = s.at + 1 + need > n
        value = pid_value(pid, F.substr(digits, 2 * (s.at + 1) + 1, F.lit(4)))
        error = F.when(done, s.error).when(bad, F.lit("pid")).when(short, F.lit("truncated"))
        go = ~done & ~bad & ~short
        return F.struct(
            F.when(go, s.at + 1 + need).otherwise(s.at).cast("int").alias("at"),
            F.when(go, F.concat(s["items"], F.array(F.struct(pid.alias("pid"), value.alias("value"))))).otherwise(s["items"]).cast("array<struct<pid:int,value:double>>").alias("items"),
            error.alias("error"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(requested))), start, step)


# fixed values: commands a session may send (the last ones set the request header) and a person may send
SESSION_COMMANDS = ["ATZ", "ATI", "AT@1", "ATE0", "ATE1", "ATL0", "ATL1", "ATS0", "ATS1", "ATH0", "ATH1", "ATSP0", "ATDP", "ATDPN", "ATRV", "ATAT0", "ATAT1", "ATAT2",
    "ATSH7DF", "ATSH7E0", "ATSH7E1", "ATSH7E2", "ATSH7E3", "ATSH7E4", "ATSH7E5", "ATSH7E6", "ATSH7E7"]
MANUAL_COMMANDS = ["ATI", "AT@1", "ATDP", "ATDPN", "ATRV"]


def allowed_command(wire: Column, manual: bool = False) -> Column:
    """The read-only guard: printable, and a listed command or mode 01 with one to six ids and perhaps a count digit."""
    u = F.upper(wire)
    listed = u.isin(MANUAL_COMMANDS if manual else SESSION_COMMANDS)
    return wire.rlike(r"^[!-~]+\z") & (listed | u.rlike(r"^01([0-9A-F]{2}){1,6}[1-9]?\z"))


def pack_file(name: Column, content_hash: Column) -> Column:
    ok = name.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?\z") & content_hash.rlike(r"^[0-9a-f]{16}\z")
    return F.when(ok, F.concat(name, F.lit("-"), content_hash, F.lit(".roadpack")))


def pack_file_parts(file: Column) -> Column:
    """struct(name, hash) of a pack's file name, null fields where it is none."""
    at = lambda k: F.nullif(F.regexp_extract(file, r"^([a-z0-9][a-z0-9-]*)-([0-9a-f]{16})\.roadpack\z", k), F.lit(""))
    return F.struct(at(1).alias("name"), at(2).alias("hash"))


def lower_hex(c: Column, digits: int) -> Column:
    return c.rlike(rf"^[0-9a-f]{{{digits}}}\z")


def note(c: Column, most: int) -> Column:
    """Trimmed, capped, trimmed again; empty is null."""
    return F.nullif(F.trim(F.substring(F.trim(c), 1, most)), F.lit(""))


def content_range(c: Column) -> Column:
    """struct(first, last, total) of ``bytes a-b/n`` (n may be *); nulls where it isn't one or its ends are out of order."""
    at = lambda k: F.nullif(F.regexp_extract(c, r"^bytes (\d+)-(\d+)/(\d+|\*)\z", k), F.lit(""))
    first, last, total = (at(k).try_cast("long") for k in (1, 2, 3))
    ok = (first <= last) & (total.isNull() | (last < total))
    return F.struct(F.when(ok, first).alias("first"), F.when(ok, last).alias("last"), F.when(ok, total).alias("total"))


def strong_etag(c: Column) -> Column:
    return c.rlike(r'^"[^"]*"\z')


def failed_kind(detail: Column) -> Column:
    """The kind named by an encoding failure's detail."""
    return F.nullif(F.regexp_extract(detail, "^encodingFailed ([^:]*)", 1), F.lit(""))


# fixed values: suffixes of recordings and their sidecars, names of unfinished downloads
RECORDING_SUFFIX, SIDECAR_SUFFIX, DOWNLOAD_PREFIX = ".jsonl.gz", ".nav.jsonl", ".download-"


def sidecar_name(recording: Column) -> Column:
    base = F.when(recording.endswith(RECORDING_SUFFIX), F.substr(recording, F.lit(1), F.length(recording) - len(RECORDING_SUFFIX))).otherwise(recording)
    return F.concat(base, F.lit(SIDECAR_SUFFIX))


def is_sidecar(name: Column) -> Column:
    return name.endswith(SIDECAR_SUFFIX)


def download_file(name: Column, content_hash: Column, extension: str) -> Column:
    """Name of an unfinished download (``part``) or of its metadata (``json``); null for a bad name or hash."""
    file = F.regexp_replace(pack_file(name, content_hash), r"\.roadpack\z", "." + extension)
    return F.concat(F.lit(DOWNLOAD_PREFIX), file)


def download_parts(file: Column) -> Column:
    """struct(kind, name, hash) of an unfinished download's file name (partial or metadata); null fields where it is none."""
    at = lambda k: F.nullif(F.regexp_extract(file, r"^\.download-([a-z0-9](?:[a-z0-9-]*[a-z0-9])?)-([0-9a-f]{16})\.(part|json)\z", k), F.lit(""))
    return F.struct(F.when(at(3) == "part", "partial").when(at(3) == "json", "metadata").alias("kind"), at(1).alias("name"), at(2).alias("hash"))


def title(uk: Column, en: Column, name: Column, language: Column) -> Column:
    """The title in the preferred language, else the other, else the name; titles of white space (of any script) don't count."""
    first = F.lower(F.coalesce(language, F.lit("")))
    given = lambda c: F.when(c.rlike(r"[^\s\p{Z}\x85]"), c)
    wants = (first == "uk") | first.startswith("uk-") | first.startswith("uk_")
    return F.when(wants, F.coalesce(given(uk), given(en), name)).otherwise(F.coalesce(given(en), given(uk), name))
