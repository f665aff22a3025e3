"""Manifests of map packs (JSON): strict at the top, entry by entry below, each entry that is dropped with its reason. VARIANT expressions only.

Results for odd input: a null or malformed text fails as no JSON; a null field has the wrong type; a number may have a fraction of
zero where a whole one is asked for; entries of an empty list give no rows; fields that aren't known are ignored; relative URLs are on the
manifest's host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: schema, largest file, newest format, kinds, and fields that the top must have
SCHEMA, MAX_SIZE, NEWEST, KINDS, TOP = 2, 150_000_000, 1, ("national", "region"), ("generated", "license", "licenseUrl", "attribution")


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    t = F.schema_of_variant(v)
    if kind == "number":
        return t.rlike("^(BIGINT|DECIMAL.*|DOUBLE)$")
    if kind == "integer":
        return t.rlike("^(BIGINT|DECIMAL.*|DOUBLE)$") & F.coalesce(F.try_variant_get(v, "$", "double") % 1 == 0, F.lit(False))
    return t.startswith({"string": "STRING", "object": "OBJECT", "array": "ARRAY"}[kind])


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _blank(c: Column) -> Column:
    return ~c.rlike(r"[^\s\p{Z}\x85]")


def _reason(e: Column, host: Column) -> Column:
    """The first thing wrong with an entry as ``code`` or ``code:detail``, or null."""
    checks: list[tuple[Column, Column]] = [(~_is(e, "object"), F.lit("notAnObject"))]

    def need(path: str, kind: str) -> None:
        v = _get(e, f"$.{path}")
        checks.append((v.isNull(), F.lit(f"missingField:{path}")))
        checks.append((~_is(v, kind), F.lit(f"mistypedField:{path}")))

    said = lambda code, path: F.concat(F.lit(code + ":"), _text(e, f"$.{path}"))
    need("name", "string")
    checks.append((~_text(e, "$.name").rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?\z"), said("invalidName", "name")))
    need("kind", "string")
    checks.append((~_text(e, "$.kind").isin(*KINDS), said("unknownKind", "kind")))
    for path, kind in (("title", "object"), ("title.uk", "string"), ("title.en", "string"), ("bbox", "array")):
        need(path, kind)
    box = F.try_variant_get(e, "$.bbox", "array<variant>")
    n = F.transform(box, lambda x: F.try_variant_get(x, "$", "double"))
    checks.append((F.exists(box, lambda x: ~_is(x, "number")), F.lit("mistypedField:bbox")))
    checks.append((F.size(box) != 4, F.lit("invalidBBox")))
    west, south, east, north = (F.get(n, F.lit(k)) for k in range(4))
    sound = west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90) & (west <= east) & (south <= north)
    checks.append((~F.coalesce(sound, F.lit(False)), F.lit("invalidBBox")))
    need("url", "string")
    url = _text(e, "$.url")
    absolute, scheme = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    named = absolute | url.startswith("//")
    of = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    checks.append((_blank(url) | (named & (of == "")), F.concat(F.lit("invalidURL:"), url)))
    checks.append((absolute & (scheme != "https"), F.concat(F.lit("notHTTPS:"), url)))
    checks.append((named & (of != F.lower(host)), F.concat(F.lit("otherHost:"), url)))
    need("size", "integer")
    checks.append((~F.try_variant_get(e, "$.size", "long").between(1, MAX_SIZE), said("invalidSize", "size")))
    need("sha256", "string")
    checks.append((~_text(e, "$.sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit("invalidSHA256")))
    need("contentHash", "string")
    checks.append((~_text(e, "$.contentHash").rlike(r"^[0-9a-f]{16}\z"), F.lit("invalidContentHash")))
    need("formatVersion", "integer")
    checks.append((~F.try_variant_get(e, "$.formatVersion", "long").between(1, NEWEST), said("unsupportedFormatVersion", "formatVersion")))
    date = _get(e, "$.osmDate")
    checks.append((date.isNotNull() & ~_is(date, "string"), F.lit("mistypedField:osmDate")))
    need("osmTimestamp", "integer")
    checks.append((_blank(_text(e, "$.title.uk")) & _blank(_text(e, "$.title.en")), F.lit("emptyTitles")))
    return F.coalesce(*(F.when(bad, what) for bad, what in checks))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (file, host, value): a row per file (file, failure: null if its top is sound), and a row per entry of sound ones (file, idx,
    name, reason: null if it is kept, entry as a variant). Of entries of one name only the first that is sound is kept."""
    f = files.select("file", "host", F.try_parse_json("value").alias("v"))
    v = F.col("v")
    checks = [(v.isNull() | ~_is(v, "object"), "notJSON")]
    for name, kind in (("schema", "integer"), *((x, "string") for x in TOP), ("packs", "array")):
        x = _get(v, f"$.{name}")
        checks += [(x.isNull(), f"missingField:{name}"), (~_is(x, kind), f"mistypedField:{name}")]
        if name == "schema":
            checks.append((F.try_variant_get(v, "$.schema", "long") != SCHEMA, "unsupportedSchema"))
    f = f.withColumn("failure", F.coalesce(*(F.when(bad, what) for bad, what in checks)))
    rows = f.where("failure is null").select("file", "host", F.posexplode(F.try_variant_get("v", "$.packs", "array<variant>")).alias("idx", "entry"))
    named = F.when(_is(_get(F.col("entry"), "$.name"), "string"), _text(F.col("entry"), "$.name"))
    rows = rows.select("file", "idx", named.alias("name"), _reason(F.col("entry"), F.col("host")).alias("reason"), "entry")
    w = Window.partitionBy("file", "name", F.col("reason").isNull()).orderBy("idx")
    again = F.col("reason").isNull() & (F.row_number().over(w) > 1)
    return f.select("file", "failure"), rows.withColumn("reason", F.when(again, "duplicateName").otherwise(F.col("reason")))
