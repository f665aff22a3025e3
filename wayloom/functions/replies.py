"""Adapter replies by sender: framed lines with headers, blocks without, text answers, outcomes. Column functions, no UDF.

Each reply is one value; its lines are an array of structs, folded by sender with ``aggregate``. Nothing is shuffled. Byte strings
are upper-case hex. Results for odd input: a null reply is null; an empty one has neither replies nor faults; lines that
look like an echo of a command and progress messages don't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import text as T

_FAULT = "struct<header:string,line:string,error:string,expected:int,actual:int>"
_REPLY = "struct<header:string,bytes:string>"
_STATE = "struct<broken:boolean,open:boolean,declared:int,have:int,next:int,first:int,line:string,parts:array<struct<at:int,text:string>>,faults:array<struct<pos:int,line:string,error:string,expected:int,actual:int>>>"

#: Place of a fault that shows only at the end of a reply, behind all lines.
_END = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s", "")


def _is_hex(digits: Column) -> Column:
    return digits.rlike(r"^[0-9A-Fa-f]*\z")


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


def data_lines(raw: Column) -> Column:
    """Lines of a reply without echoes of commands."""
    return F.filter(T.reply_lines(raw), lambda x: ~T.allowed_command(x))


def _frame(line: Column, pos: Column) -> Column:
    """A line's header (null where it can't be told) and frame: its kind, low digit, bytes, declared length and rest."""
    def parts(x: Column) -> Column:  # x: the digits, whether they are hex
        size = F.when(F.length(x.d) % 2 == 0, 8).otherwise(3)
        known = x.hex & (F.length(x.d) >= size + 2)
        head, f = F.when(known, F.substr(x.d, F.lit(1), size)), F.when(known, F.upper(F.substr(x.d, size + 1)))
        return F.struct(x.hex.alias("hex"), head.alias("header"), f.alias("f"))

    def frame(x: Column) -> Column:
        return F.struct(
            pos.cast("int").alias("pos"), line.alias("line"), x.hex.alias("hex"), x.header.alias("header"), _number(F.substring(x.f, 1, 1)).alias("kind"), _number(F.substring(x.f, 2, 1)).alias("low"),
            (F.length(x.f) / 2).cast("int").alias("n"), _number(F.substring(x.f, 2, 3)).alias("long"), x.f.alias("f"),
        )

    digits = let(_bare(line), lambda d: F.struct(d.alias("d"), _is_hex(d).alias("hex")))
    return let(let(digits, parts), frame)


def _none(what: str) -> Column:
    return F.array().cast(f"array<{what}>")


def _step(s: Column, x: Column) -> Column:
    """One line of a sender: a whole message (0), a first (1) or a following part (2) of a long one, else a fault."""
    malformed = F.when(s.broken, True).when(x.kind == 0, ~x.low.between(1, 7) | s.open).when(x.kind == 1, (x.n < 2) | s.open | (x.long <= 7)).when(x.kind == 2, ~s.open | (x.low != s.next)).otherwise(True)
    verdict = F.when(malformed, "malformedFrame").when((x.kind == 0) & (x.n - 1 < x.low), "truncatedFrame")

    def good() -> Column:
        # bytes that the line adds to its message, which begins at ``at``
        most = F.when(x.kind == 0, x.low).when(x.kind == 1, x.long).otherwise(s.declared - s.have)
        part = F.substr(x.f, F.when(x.kind == 1, 5).otherwise(3), 2 * F.greatest(most, F.lit(0)))
        at = F.when(x.kind == 2, s.first).otherwise(x.pos)
        have = F.when(x.kind == 2, s.have).otherwise(0) + F.least(most, x.n - F.when(x.kind == 1, 2).otherwise(1))
        opened, long = x.kind == 1, x.kind > 0
        return F.struct(
            F.lit(False).alias("broken"), (opened | ((x.kind == 2) & (have < s.declared))).alias("open"), F.when(opened, x.long).otherwise(s.declared).alias("declared"),
            F.when(long, have).otherwise(s.have).alias("have"), F.when(opened, 1).when(long, (s.next + 1) % 16).otherwise(s.next).alias("next"),
            F.when(opened, x.pos).otherwise(s.first).alias("first"), F.when(opened, x.line).otherwise(s.line).alias("line"),
            F.concat(s.parts, F.array(F.struct(at.alias("at"), part.alias("text")))).alias("parts"), s.faults.alias("faults"),
        ).cast(_STATE)

    def bad(why: Column) -> Column:
        short = why == "truncatedFrame"
        fault = F.struct(x.pos.alias("pos"), x.line.alias("line"), why.alias("error"), F.when(short, x.low).alias("expected"), F.when(short, x.n - 1).alias("actual"))
        return F.struct(F.lit(True).alias("broken"), F.lit(False).alias("open"), *(s[c].alias(c) for c in ("declared", "have", "next", "first", "line", "parts")), F.concat(s.faults, F.array(fault)).alias("faults")).cast(_STATE)

    return let(verdict, lambda why: F.when(why.isNull(), good()).otherwise(bad(why)))


def _sender(header: Column, lines: Column) -> Column:
    """struct(replies with the place of their first line, faults) of one sender's lines."""
    start = F.struct(F.lit(False).alias("broken"), F.lit(False).alias("open"), *(F.lit(0).alias(c) for c in ("declared", "have", "next", "first")), F.lit("").alias("line"), _none("struct<at:int,text:string>").alias("parts"), _none("struct<pos:int,line:string,error:string,expected:int,actual:int>").alias("faults")).cast(_STATE)

    def done(s: Column) -> Column:
        broken = s.broken | s.open
        left = F.struct((s.first + _END).alias("pos"), s.line.alias("line"), F.lit("truncatedFrame").alias("error"), s.declared.alias("expected"), s.have.alias("actual"))
        faults = F.concat(s.faults, F.when(s.open, F.array(left)).otherwise(_none("struct<pos:int,line:string,error:string,expected:int,actual:int>")))
        whole = F.transform(F.array_distinct(F.transform(s.parts, lambda p: p["at"])), lambda a: F.struct(a.alias("at"), header.alias("header"), F.concat_ws("", F.transform(F.filter(s.parts, lambda p: p["at"] == a), lambda p: p.text)).alias("bytes")))
        return F.struct(F.when(broken, _none("struct<at:int,header:string,bytes:string>")).otherwise(whole).alias("replies"), F.transform(faults, lambda f: F.struct(f.pos.alias("pos"), header.alias("header"), f.line.alias("line"), f.error.alias("error"), f.expected.alias("expected"), f.actual.alias("actual"))).alias("faults"))

    return F.aggregate(lines, start, _step, done)


def _scan(replies: Column, faults: Column) -> Column:
    return F.struct(replies.cast(f"array<{_REPLY}>").alias("replies"), faults.cast(f"array<{_FAULT}>").alias("faults"))


def _headed(lines: Column, status: Column) -> Column:
    """Lines with headers, by sender: a fault drops all replies of its sender and of no other."""

    def of(frames: Column) -> Column:
        senders = F.array_distinct(F.transform(F.filter(frames, lambda x: x.header.isNotNull()), lambda x: x.header))
        stray = F.transform(F.filter(frames, lambda x: x.header.isNull()), lambda x: F.struct(x.pos.alias("pos"), F.lit(None).cast("string").alias("header"), x.line.alias("line"), F.when(x.hex, "malformedFrame").otherwise("malformedHex").alias("error"), F.lit(None).cast("int").alias("expected"), F.lit(None).cast("int").alias("actual")))
        each = F.transform(senders, lambda h: _sender(h, F.filter(frames, lambda x: x.header == h)))

        def joined(found: Column) -> Column:
            replies = F.array_sort(F.flatten(F.transform(found, lambda e: e.replies)))
            faults = F.array_sort(F.concat(stray, F.flatten(F.transform(found, lambda e: e.faults))))
            return _scan(F.transform(replies, lambda r: F.struct(r.header.alias("header"), r["bytes"].alias("bytes"))), F.concat(status, F.transform(faults, lambda f: F.struct(f.header.alias("header"), f.line.alias("line"), f.error.alias("error"), f.expected.alias("expected"), f.actual.alias("actual")))))

        return let(each, joined)

    return let(F.transform(lines, _frame), of)


def _ordered(frames: Column) -> Column:
    """The bytes of indexed lines (i, d) in their order."""
    twice = F.size(F.array_distinct(F.transform(frames, lambda f: f.i))) < F.size(frames)
    index = lambda k: F.get(frames, k).i

    def turns(k: Column) -> Column:  # how often the index has begun anew before a line
        steps = F.filter(F.sequence(F.lit(0), k), lambda j: (j > 0) & (F.abs(index(j) - index(j - 1)) >= 8))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, j: a + F.when(index(j) < index(j - 1), 1).otherwise(-1))

    placed = let(twice, lambda again: F.transform(frames, lambda f, k: F.struct(F.when(again, turns(k)).otherwise(0).alias("turn"), f.i.alias("i"), k.alias("k"), f.d.alias("d"))))
    return F.concat_ws("", F.transform(F.array_sort(placed), lambda f: f.d))


def _segment(lines: Column, start: Column, end: Column) -> Column:
    """The line at ``start`` (none at -1) and the indexed ones after it: struct(replies, error, expected, actual)."""
    head = F.when(start >= 0, F.get(lines, start))
    head = let(_bare(head), lambda d: F.struct(d.alias("digits"), F.when((F.length(d) == 3) & _is_hex(d), _number(d)).alias("length"), (~_is_hex(d) | (F.length(d) % 2 == 1)).alias("odd")))

    def indexed(x: Column) -> Column:
        i, d = _bare(F.substring_index(x, ":", 1)), _bare(F.substr(x, F.instr(x, ":") + 1))
        return F.struct(F.conv(i, 16, 10).cast("long").alias("i"), F.upper(d).alias("d"), ((i == "") | ~_is_hex(i) | ~_is_hex(d) | (F.length(d) % 2 == 1)).alias("odd"))

    frames = F.transform(F.slice(lines, start + 2, end - start - 1), indexed)

    def of(x: Column) -> Column:
        h, p = x.head, x.payload
        single = F.when(h.digits.isNotNull() & h.length.isNull(), F.array(F.upper(h.digits))).otherwise(_none("string"))
        block = F.when(h.length.isNotNull(), F.array(F.substr(p, F.lit(1), 2 * h.length))).when(end - start > 1, F.array(p)).otherwise(_none("string"))
        error = F.when((h.length.isNull() & h.odd) | x.odd, "malformedHex").when(F.length(p) < 2 * h.length, "truncatedFrame")
        return F.struct(F.concat(single, block).alias("replies"), error.alias("error"), F.when(error == "truncatedFrame", h.length).alias("expected"), F.when(error == "truncatedFrame", (F.length(p) / 2).cast("int")).alias("actual"))

    return let(let(frames, lambda fs: F.struct(head.alias("head"), _ordered(fs).alias("payload"), F.exists(fs, lambda f: f.odd).alias("odd"))), of)


def _bare_blocks(lines: Column, status: Column) -> Column:
    """Lines without headers: a length of three digits opens a block of indexed lines, put in their order; any other line
    is a reply. Nothing can be told apart, so one fault drops all. Where an index of a block comes twice, it is one digit that
    begins anew after F, and lines are in the order of these turns."""
    starts = F.filter(F.transform(lines, lambda x, k: F.when(~F.contains(x, F.lit(":")), k)), lambda k: k.isNotNull())

    def of(at: Column) -> Column:
        all_ = F.when(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)) == 0, at).otherwise(F.concat(F.array(F.lit(-1)), at))
        segments = F.transform(all_, lambda s, k: _segment(lines, s, F.coalesce(F.get(all_, k + 1), F.size(lines))))

        def joined(found: Column) -> Column:
            bad = F.get(F.filter(found, lambda s: s.error.isNotNull()), F.lit(0))
            replies = F.transform(F.flatten(F.transform(found, lambda s: s.replies)), lambda b: F.struct(F.lit(None).cast("string").alias("header"), b.alias("bytes")))
            fault = F.struct(F.lit(None).cast("string").alias("header"), F.array_join(lines, "\r").alias("line"), bad.error.alias("error"), bad.expected.alias("expected"), bad.actual.alias("actual"))
            return F.when(F.size(lines) == 0, _scan(_none(_REPLY), status)).when(bad.isNull(), _scan(replies, status)).otherwise(_scan(_none(_REPLY), F.concat(status, F.array(fault))))

        return let(segments, joined)

    return let(starts, of)


def scan_replies(raw: Column, headers: bool = True) -> Column:
    """struct(replies: array of (header, bytes), faults: array of (header, line, error, expected, actual)).

    Replies of senders whose lines are all right, in the order of their first lines; then what was wrong: status lines
    first (their error; they drop nothing), then lines in order, then transfers that never ended."""

    def of(lines: Column) -> Column:
        marked = F.filter(lines, lambda x: x.code.isNotNull())
        status = F.transform(marked, lambda x: F.struct(F.lit(None).cast("string").alias("header"), x.line.alias("line"), x.code.alias("error"), F.lit(None).cast("int").alias("expected"), F.lit(None).cast("int").alias("actual")).cast(_FAULT))
        data = F.transform(F.filter(lines, lambda x: x.code.isNull()), lambda x: x.line)
        return let(data, lambda d: _headed(d, status) if headers else _bare_blocks(d, status))

    coded = F.transform(data_lines(raw), lambda x: F.struct(x.alias("line"), T.status_code(x).alias("code")))
    return F.when(raw.isNotNull(), let(coded, of))


def reply_error(scan: Column) -> Column:
    """What a reply failed with as a whole: its first fault, or that it was empty; null if nothing did."""
    return F.coalesce(F.get(scan["faults"], F.lit(0))["error"], F.when(F.size(scan["replies"]) == 0, "emptyResponse"))


def strict_replies(scan: Column) -> Column:
    """The replies if nothing failed, else null (``reply_error`` says why)."""
    return F.when(reply_error(scan).isNull(), scan["replies"])


def text_reply(command: Column, raw: Column) -> Column:
    """struct(kind, value, volts, error) of the answer to an ``AT`` command: its last line but for the echo."""
    wire = F.upper(command)

    def of(lines: Column) -> Column:
        error = F.get(F.filter(F.transform(lines, T.status_code), lambda e: e.isNotNull()), F.lit(0))
        line = F.try_element_at(lines, F.lit(-1))
        volts = F.regexp_replace(_bare(line), r"[Vv]\z", "")
        volts = F.when(volts.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), volts.try_cast("double"))
        kind = F.when(wire.isin("ATZ", "ATI"), "banner").when(wire == "ATDPN", "protocolNumber").when((wire == "ATRV") & volts.isNotNull() & (F.abs(volts) < float("inf")), "voltage").when((wire != "ATRV") & (F.upper(line) == "OK"), "ok").otherwise("other")
        error = F.coalesce(error, F.when(F.size(lines) == 0, "emptyResponse"))
        fine = error.isNull()
        return F.struct(F.when(fine, kind).alias("kind"), F.when(fine & (kind != "ok"), line).alias("value"), F.when(fine & (kind == "voltage"), volts).alias("volts"), error.alias("error"))

    return let(F.filter(T.reply_lines(raw), lambda x: F.upper(x) != wire), of)


# fixed values: outcomes of an exchange that are named otherwise than its error; all that is no status is malformed
_OUTCOMES = {"busInitFailed": "busInitError", "adapter": "adapterError", "malformedHex": "malformed", "malformedFrame": "malformed", "truncatedFrame": "malformed", "emptyResponse": "malformed"}


def outcome(error: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in _OUTCOMES.items() for x in kv))
    return F.when(error.isNull(), "ok").otherwise(F.coalesce(F.try_element_at(table, error), error))


def exchange_outcome(command: Column, raw: Column, headers: bool = True) -> Column:
    """Outcome of a reply of which nothing more is expected: text for ``AT`` commands, frames for others."""
    error = F.when(command.startswith("AT"), text_reply(command, raw)["error"]).otherwise(reply_error(scan_replies(raw, headers)))
    return outcome(error)


# fixed values: the sender whose speed counts, by its short and its long header
PRIMARY = ("7E8", "18DAF110")


def decoded(scan: Column, requested: list[int]) -> Column:
    """array of (ecu, pid, value): measurements of the replies that decode in full."""

    def one(r: Column) -> Column:
        return let(T.pid_walk(r["bytes"], requested), lambda w: F.when(w.error.isNull() & (F.size(w["items"]) > 0), F.transform(w["items"], lambda i: F.struct(r["header"].alias("ecu"), i.pid.alias("pid"), i.value.alias("value")))))

    return F.flatten(F.filter(F.transform(scan["replies"], one), lambda x: x.isNotNull()))


def poll_outcome(scan: Column, found: Column) -> Column:
    """Outcome of a poll with its ``decoded`` measurements: faults count only if the primary sender's answer didn't decode."""
    primary = F.exists(found, lambda d: d.ecu.isNull() | d.ecu.isin(*PRIMARY))
    faulty = F.size(scan["faults"]) > 0
    return F.when(faulty & ~primary, outcome(reply_error(scan))).when(~faulty & (F.size(found) == 0), "malformed").otherwise("ok")
