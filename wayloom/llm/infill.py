"""Operator 12: fill-in-middle transformation over ropes.

A text is a rope: a balanced tree whose leaves hold up to ``LEAF`` units of it, each node with the units and the code points
below it. A unit is a code point or a match of a pattern (words, lines), found left to right over the whole text; what stands
between matches belongs to the unit before it (at the start: to the first). The rope is split at two unit ranks into prefix, middle and suffix;
these subtrees are joined again with sentinels between them, and the tree is written out leaf by leaf. The inverse is a rope
of the output, split by code points at the places of the sentinels, with the subtrees joined in the text's order. Splits and joins follow
one path of the tree, so they cost the logarithm of the text's leaves.

The plan of a document (form and ranks) comes from a hash of a seed and its id: it doesn't depend on partitions, retries or other
documents. A text that is empty, holds a sentinel, or is left out by rate stays as it is (``plain``), so the inverse is exact.

Results for odd input: a null text is empty, thus plain, and so is one without a unit; a null id hashes as an empty one; rows that repeat an id
are cut by the same hashes; very long texts are ropes of many leaves, and a task holds one batch of ``BATCH`` rows; an empty
table gives no rows; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, tidy

#: Units of a leaf, at most.
LEAF = 2048
#: Rows of an Arrow batch.
BATCH = 200
#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and of these, that have the suffix first.
RATE, SPM_RATE = 90, 20


class Rope(NamedTuple):
    """A node: ``text`` and its ``units`` (where each begins; None: each code point is one) at a leaf, else two children."""

    units: int
    chars: int
    height: int
    left: Rope | None
    right: Rope | None
    text: str
    starts: tuple[int, ...] | None


def leaf(text: str, starts: tuple[int, ...] | None = None) -> Rope:
    return Rope(len(text) if starts is None else len(starts), len(text), 0, None, None, text, starts)


EMPTY = leaf("")


def node(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height), left, right, "", None)


def join(a: Rope, b: Rope) -> Rope:
    """Balanced concatenation: the lower tree is hung in where the higher one's edge has its height."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return balanced(join(a, b.left), b.right)
    return node(a, b)


def balanced(a: Rope, b: Rope) -> Rope:
    """A node of two trees whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return node(a.left, node(a.right, b))
        return node(node(a.left, a.right.left), node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return node(node(a, b.left), b.right)
        return node(node(a, b.left.left), node(b.left.right, b.right))
    return node(a, b)


def split(r: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points, ``by="chars"``) and the rest. A rank of all units has whatever follows the last.

    Code points split leaves of code points only (such ropes are made to be written out or inverted)."""
    if rank <= 0:
        return EMPTY, r
    if rank >= getattr(r, by):
        return r, EMPTY
    if r.left is None:
        if r.starts is None:
            return leaf(r.text[:rank]), leaf(r.text[rank:])
        at = r.starts[rank]
        return leaf(r.text[:at], r.starts[:rank]), leaf(r.text[at:], tuple(x - at for x in r.starts[rank:]))
    here = getattr(r.left, by)
    if rank < here:
        a, b = split(r.left, rank, by)
        return a, join(b, r.right)
    a, b = split(r.right, rank - here, by)
    return join(r.left, a), b


def rope(text: str, unit: re.Pattern | None = None) -> Rope:
    """A balanced tree of leaves of ``LEAF`` units."""
    if unit is None:
        row = [leaf(text[i : i + LEAF]) for i in range(0, len(text), LEAF)]
    else:
        at = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
        if not at:
            return Rope(0, len(text), 0, None, None, text, ())
        at[0] = 0
        row = []
        for i in range(0, len(at), LEAF):
            end = at[i + LEAF] if i + LEAF < len(at) else len(text)
            row.append(leaf(text[at[i] : end], tuple(x - at[i] for x in at[i : i + LEAF])))
    return paired(row) if row else EMPTY


def paired(row: list[Rope]) -> Rope:
    half = len(row) // 2
    return node(paired(row[:half]), paired(row[half:])) if half else row[0]


def leaves(r: Rope) -> Iterator[str]:
    stack = [r]
    while stack:
        x = stack.pop()
        if x.left is None:
            yield x.text
        else:
            stack += [x.right, x.left]


def written(r: Rope) -> str:
    return "".join(leaves(r))


def numbers(seed: str, key: object) -> list[int]:
    """The first four 32-bit numbers of the hash of seed and key."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


class Cut(NamedTuple):
    form: str
    units: int
    prefix: int | None
    middle: int | None
    output: str


def transformed(key: object, text: str, seed: str = "1", unit: re.Pattern | None = None, rate: int = RATE, spm_rate: int = SPM_RATE) -> Cut:
    """The text in its form. ``prefix`` and ``middle`` are their code points; None where it is plain."""
    whole = rope(text, unit)
    n = whole.units
    h1, h2, h3, h4 = numbers(seed, key)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return Cut("plain", n, None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, tail = split(whole, high)
    prefix, middle = split(head, low)
    if h4 % 100 < spm_rate:
        parts, form = [leaf(SUFFIX), tail, leaf(PREFIX), prefix, leaf(MIDDLE), middle], "spm"
    else:
        parts, form = [leaf(PREFIX), prefix, leaf(SUFFIX), tail, leaf(MIDDLE), middle], "psm"
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return Cut(form, n, prefix.chars, middle.chars, written(out))


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, b = output.index(second, len(first)), output.index(MIDDLE, len(first))
    rest, middle = split(rope(output), b, "chars")
    middle = split(middle, len(MIDDLE), "chars")[1]
    one, two = split(rest, a, "chars")
    one, two = split(one, len(first), "chars")[1], split(two, len(second), "chars")[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return written(join(join(prefix, middle), suffix))


SCHEMA = "id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str | None = None, rate: int = RATE, spm_rate: int = SPM_RATE, restore: bool = False) -> DataFrame:
    """(id, text, n units, form, prefix_chars, middle_chars, output) of every document; ``unit`` is a pattern (None: code points).
    ``text`` is the restored one, from output and form alone, with ``restore``; else the one given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                c = transformed(key, text or "", seed, pattern, rate, spm_rate)
                back = restored(c.output, c.form) if restore else text or ""
                for column, value in zip(columns, (key, back, c.units, c.form, c.prefix, c.middle, c.output)):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    small_batches(docs.sparkSession, BATCH)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCHEMA)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by code points; the digests are of what the operator wrote and of what its inverse gave back."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), restore=True)
    return out.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


OP12_SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
k AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::bigint % (n + 1) AS a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR ('0x' || substr(h, 17, 8))::bigint % 100 >= {RATE} THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::bigint % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, least(a, b) AS i, greatest(a, b) AS j, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
