"""Estimate sidecars (JSON lines beside a recording) and truth files, read and refused by their rules. VARIANT expressions and windows by file.

A sidecar's lines are rows (file, n, value), n from 1. The first line is a header; estimates, pins, roads and road selections follow,
and lines of other kinds are kept apart. Only the last line may be cut short. ``roads`` lines after the first one
(version 3 on) name a strict superset of the packs before, at no earlier place. The first line against the rules refuses the file.

Results for odd input: a file of one empty line lacks its header; numbers may be the strings inf, -inf and nan; whole numbers may have a
fraction of zero; an optional field may be null; fields that a kind doesn't have are ignored; text that isn't JSON, or isn't an object with a
string ``kind``, is a bad line; a line number that comes twice is two lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The newest version that is read.
VERSION = 3

# fixed values: fields of each kind of line and their types; optional ones end with ?
ESTIMATE = {
    "t": "int", "latitude": "double", "longitude": "double", "headingDeg": "double", "headingStdDeg": "double", "semiMajorM": "double",
    "semiMinorM": "double", "orientationDeg": "double", "converged": "boolean", "speedScale": "double", "droppedInputs": "int",
    "msPerStep": "double?", "maxStepMs": "double?", "onRoadShare": "double?",
}
KINDS = {
    "header": {"sidecarVersion": "int", "sessionID": "uuid", "seed": "unsigned", "configHash": "string", "configJSON": "string", "appBuild": "string", "buildConfiguration": "string?"},
    "estimate": ESTIMATE,
    "pin": {"t": "int", "latitude": "double", "longitude": "double", "mapSpanM": "double?", "prior": "estimate?"},
    "roads": {"t": "int?", "afterInputs": "int", "roads": "packs", "roadSetHash": "string"},
    "roadsSelection": {"t": "int", "afterInputs": "int", "recordedAfterInputs": "int", "request": "request", "outcome": "string", "reason": "string?", "repeats": "int?", "firstT": "int?", "trigger": "string?"},
}
PACK = {"contentHash": "string", "formatVersion": "int", "osmTimestamp": "int", "gridID": "string"}


def _kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def _number(v: Column) -> Column:
    """A JSON number, or one of the strings that stand for what JSON lacks."""
    text = F.try_variant_get(v, "$", "string")
    named = F.when(text == "inf", float("inf")).when(text == "-inf", float("-inf")).when(text == "nan", float("nan"))
    return F.when(_kind_of(v).rlike("^(BIGINT|DECIMAL.*|DOUBLE)$"), F.try_variant_get(v, "$", "double")).when(_kind_of(v) == "STRING", named)


def field(v: Column, path: str) -> Column:
    """A field as a variant; null where it is missing or null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(x), x)


def _ok(v: Column, kind: str) -> Column:
    """Whether a field that is there has its type."""
    whole = _kind_of(v).rlike("^(BIGINT|DECIMAL.*|DOUBLE)$") & (F.try_variant_get(v, "$", "double") % 1 == 0)
    if kind == "int":
        return whole & F.try_variant_get(v, "$", "long").isNotNull()
    if kind == "unsigned":
        return whole & F.try_variant_get(v, "$", "decimal(20,0)").between(0, F.lit("18446744073709551615").cast("decimal(20,0)"))
    if kind == "double":
        return _number(v).isNotNull()
    if kind == "boolean":
        return _kind_of(v) == "BOOLEAN"
    if kind == "uuid":
        return (_kind_of(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z")
    if kind == "estimate":
        return F.coalesce(fits(v, ESTIMATE), F.lit(False))
    if kind == "request":
        return F.coalesce(fits(v, {"radiusM": "double"}), F.lit(False))
    if kind == "packs":
        packs = F.try_variant_get(v, "$", "array<variant>")
        return packs.isNotNull() & F.forall(packs, lambda p: F.coalesce(fits(p, PACK), F.lit(False)))
    return _kind_of(v) == "STRING"


def fits(v: Column, fields: dict[str, str]) -> Column:
    """Whether an object has its fields."""
    out = F.lit(True)
    for name, kind in fields.items():
        x = field(v, f"$.{name}")
        out &= F.when(x.isNull(), kind.endswith("?")).otherwise(F.coalesce(_ok(x, kind.rstrip("?")), F.lit(False)))
    return out


def file_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, n, value) of text files, each read whole. A file without any byte has no row, as Spark passes over it."""
    text = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("content").cast("string").alias("value"))
    lines = F.split(text["value"], "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return text.select("file", F.posexplode_outer(lines).alias("n", "value")).select("file", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("n"), "value")


def checked(lines: DataFrame) -> DataFrame:
    """(file, n, kind, ok, v, version, problem, refused): each line with its kind (null where it can't be told), whether it
    decodes, its value, the file's version, what it does against the rules, and whether its file is refused."""
    v = F.try_parse_json("value")
    rows = lines.select("file", "n", v.alias("v"))
    kind = F.when(_kind_of(field(F.col("v"), "$.kind")) == "STRING", F.try_variant_get("v", "$.kind", "string"))
    rows = rows.withColumn("kind", kind)
    ok = F.col("kind").isNotNull()
    for name, fields in KINDS.items():
        ok &= (F.col("kind") != name) | fits(F.col("v"), fields)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    hashes = F.array_distinct(F.transform(F.try_variant_get("v", "$.roads", "array<variant>"), lambda p: F.try_variant_get(p, "$.contentHash", "string")))
    road = (F.col("kind") == "roads") & F.col("ok")
    rows = rows.withColumns({"__packs": F.when(road, hashes), "__after": F.when(road, F.try_variant_get("v", "$.afterInputs", "long"))})
    whole = Window.partitionBy("file")
    rows = rows.withColumns({"__last": F.max("n").over(whole), "version": F.max(F.when((F.col("n") == 1) & (F.col("kind") == "header") & F.col("ok"), F.try_variant_get("v", "$.sidecarVersion", "long"))).over(whole)})
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in ("__packs", "__after")} | {"packs": F.col("__packs"), "after": F.col("__after")})
    later = F.col("packs").isNotNull() & F.col("__packs").isNotNull()
    grows = (F.size(F.array_except("__packs", "packs")) == 0) & (F.size("packs") > F.size("__packs"))
    n = F.col("n")
    problem = (
        F.when((n == 1) & (~F.col("ok") | (F.col("kind") != "header")), "missingHeader").when((n == 1) & (F.col("version") > VERSION), "unsupportedVersion")
        .when((n > 1) & ~F.col("ok") & (n < F.col("__last")), "malformedLine").when(later & (F.col("version") < 3), "duplicateRoadsLine")
        .when(later & (F.col("after") < F.col("__after")), "roadsEarlier").when(later & ~grows, "roadsNoSuperset")
    )
    rows = rows.withColumn("problem", problem)
    return rows.select("file", "n", "kind", "ok", "v", "version", "problem", F.max(F.col("problem").isNotNull()).over(whole).alias("refused"))


def report(rows: DataFrame) -> DataFrame:
    """A row per file from ``checked``: its first problem and line, else counts by kind, whether the last line was cut, and the most
    dropped inputs of an estimate."""
    known = lambda k: F.count_if((F.col("kind") == k) & F.col("ok"))
    dropped = F.max(F.when((F.col("kind") == "estimate") & F.col("ok"), F.try_variant_get("v", "$.droppedInputs", "long")))
    counts = {"estimates": known("estimate"), "pins": known("pin"), "roads": known("roads"), "selections": known("roadsSelection")}
    other = F.count_if(F.col("ok") & (F.col("n") > 1) & ~F.col("kind").isin("estimate", "pin", "roads", "roadsSelection"))
    out = rows.groupBy("file").agg(
        F.max("version").alias("version"), F.min(F.when(F.col("problem").isNotNull(), F.struct("n", "problem"))).alias("bad"),
        *(c.alias(k) for k, c in counts.items()), other.alias("unrecognized"), F.max(~F.col("ok") & (F.col("n") > 1)).alias("truncated"), F.coalesce(dropped, F.lit(0)).alias("dropped"),
    )
    fine = F.col("bad").isNull()
    return out.select("file", "version", F.col("bad.problem").alias("error"), F.col("bad.n").alias("error_line"), *(F.when(fine, F.col(c)).alias(c) for c in (*counts, "unrecognized", "truncated", "dropped")))


def values(rows: DataFrame, kind: str) -> DataFrame:
    """(file, n, field ...) of one kind's lines in files that aren't refused."""
    own = rows.where((F.col("kind") == kind) & F.col("ok") & ~F.col("refused"))
    return own.select("file", "n", *typed(F.col("v"), KINDS[kind]))


def typed(v: Column, fields: dict[str, str]) -> list[Column]:
    out = []
    for name, kind in fields.items():
        x, kind = field(v, f"$.{name}"), kind.rstrip("?")
        if kind == "double":
            c = _number(x)
        elif kind == "estimate":
            c = F.when(x.isNotNull(), F.struct(*typed(x, ESTIMATE)))
        elif kind == "packs":
            c = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda p: F.struct(*typed(p, PACK)))
        elif kind == "request":
            c = F.struct(*typed(x, {"radiusM": "double"}))
        else:
            c = F.try_variant_get(x, "$", {"int": "long", "unsigned": "decimal(20,0)", "boolean": "boolean"}.get(kind, "string"))
        out.append(c.alias(name))
    return out


# fixed values: fields of a truth file's entry
POSITION = {"latitude": "double", "longitude": "double", "sigmaM": "double?", "source": "string?"}
TRUTH = {"end": POSITION, "points": {"t": "double", **POSITION}, "excludePins": {"t": "double", "reason": "string?"}, "excludeFixes": {"fromT": "double", "toT": "double", "reason": "string?"}}


def _plain(v: Column, fields: dict[str, str]) -> Column:
    """As ``fits``, with JSON numbers only."""
    out = F.coalesce(_kind_of(v).startswith("OBJECT"), F.lit(False))
    for name, kind in fields.items():
        x = field(v, f"$.{name}")
        good = _kind_of(x).rlike("^(BIGINT|DECIMAL.*|DOUBLE)$") if kind.startswith("double") else _kind_of(x) == "STRING"
        out &= F.coalesce(good, F.lit(kind.endswith("?")))
    return out


def _fitting(fields: dict[str, str]) -> Callable[[Column], Column]:
    return lambda x: _plain(x, fields)


def truth(files: DataFrame) -> DataFrame:
    """(file, recording, end, points, exclude_pins, score_until, exclude_fixes, failure) of truth files (file, value), one row
    for each recording named. A file with any entry that doesn't decode, or a range whose start is after its end, fails whole:
    one row with its reason. Unknown fields are ignored."""
    v = F.try_parse_json("value")
    rows = files.select("file", v.alias("v")).withColumn("entries", F.try_variant_get("v", "$", "map<string,variant>"))

    def each(x: Column) -> Column:
        lists = F.lit(True)
        for name in ("points", "excludePins", "excludeFixes"):
            y = field(x, f"$.{name}")
            items = F.try_variant_get(y, "$", "array<variant>")
            fields = TRUTH[name]
            lists &= y.isNull() | (items.isNotNull() & F.forall(items, _fitting(fields)))
        end, until = field(x, "$.end"), field(x, "$.scoreUntilT")
        sound = _kind_of(x).startswith("OBJECT") & (end.isNull() | _plain(end, POSITION)) & (until.isNull() | _kind_of(until).rlike("^(BIGINT|DECIMAL.*|DOUBLE)$")) & lists
        ranges = F.try_variant_get(x, "$.excludeFixes", "array<struct<fromT:double,toT:double>>")
        late = F.coalesce(F.exists(ranges, lambda r: r.fromT > r.toT), F.lit(False))
        return F.when(~F.coalesce(sound, F.lit(False)), "malformed").when(late, "range")

    problems = F.filter(F.transform(F.map_values("entries"), each), lambda p: p.isNotNull())
    failure = F.when(F.col("v").isNull() | F.col("entries").isNull(), "malformed").otherwise(F.array_min(problems))
    rows = rows.withColumn("failure", failure)
    good = rows.where("failure is null").select("file", F.explode("entries").alias("recording", "e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    fine = good.select(
        "file", "recording", get("$.end", "struct<latitude:double,longitude:double,sigmaM:double,source:string>").alias("end"),
        get("$.points", "array<struct<t:double,latitude:double,longitude:double,sigmaM:double,source:string>>").alias("points"),
        get("$.excludePins", "array<struct<t:double,reason:string>>").alias("exclude_pins"), get("$.scoreUntilT", "double").alias("score_until"),
        get("$.excludeFixes", "array<struct<fromT:double,toT:double,reason:string>>").alias("exclude_fixes"), F.lit(None).cast("string").alias("failure"),
    )
    return fine.unionByName(rows.where("failure is not null").select("file", "failure"), allowMissingColumns=True)


def truth_entry(entries: DataFrame, recordings: DataFrame, name: str = "recording") -> DataFrame:
    """Each of ``recordings`` with its entry: of the same name, else the first (by name) of the same name without its suffix."""
    stem = lambda c: F.regexp_replace(c, r"\.jsonl(\.gz)?\z", "")
    e = entries.where("failure is null").withColumnRenamed("recording", "__of").withColumn("__stem", stem(F.col("__of")))
    j = recordings.withColumn("__stem", stem(F.col(name))).join(e, "__stem", "left")
    best = Window.partitionBy(name).orderBy(F.desc(F.col("__of").eqNullSafe(F.col(name))), F.asc("__of"))
    return j.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__stem").withColumnRenamed("__of", "entry")
