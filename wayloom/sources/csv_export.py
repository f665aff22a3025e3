"""CSV of recordings: one table for each kind of event, with fixed columns, RFC 4180 quoting.

Values are read from an event's JSON by path, as they are written there: numbers keep their text, flags are true or false, what is absent or
null is empty. Kinds that aren't known have their JSON in one column. Results for odd input: a malformed payload has empty fields (a marker's
is its text); a null payload too; unsafe characters of a kind become ``_`` in its file's name, an empty kind is ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# fixed values: columns of each kind after t; a path where it isn't the column's name
XYZ = ("X", "Y", "Z")
COLUMNS: dict[str, tuple[str, ...]] = {
    "motion": ("userAccelerationX", "userAccelerationY", "userAccelerationZ", "gravityX", "gravityY", "gravityZ", "rotationRateX", "rotationRateY", "rotationRateZ", "attitudeX", "attitudeY", "attitudeZ", "attitudeW", "magneticFieldX", "magneticFieldY", "magneticFieldZ", "magneticAccuracy"),
    "location": ("latitude", "longitude", "altitude", "horizontalAccuracy", "verticalAccuracy", "speed", "speedAccuracy", "course", "courseAccuracy", "receivedT", "fixTime", "ageS", "ellipsoidalAltitude", "simulated", "accessory"),
    "obd": ("pid", "value", "unit", "raw", "requestT", "command", "ecu", "seq"),
    "accelerometer": ("x", "y", "z"), "gyroscope": ("x", "y", "z"), "magnetometer": ("x", "y", "z"),
    "barometer": ("pressureKPa", "relativeAltitude"), "elm": ("seq", "phase", "tx", "requestT", "rx", "outcome"), "link": ("layer", "from", "to", "reason"), "lifecycle": ("event", "detail"),
    "stats": ("windowS", "obdHz", "motionHz", "timeouts", "queueDepthMax", "dropped", "bytesWritten", "gapsMotion", "gapsAccel", "gapsGyro", "maxGapMsMotion", "maxGapMsAccel", "maxGapMsGyro", "counts"),
    "manualFix": ("latitude", "longitude", "pressedT", "mapSpanM", "obdSpeedKmh", "obdSpeedT", "gpsSpeedKmh", "speedSource", "gateSpeedKmh", "note"),
    "gpsSwitch": ("on", "source"),
    "navPrior": ("estimateT", "latitude", "longitude", "covEE", "covEN", "covNN", "headingDeg", "headingStdDeg", "converged", "speedMps", "obdSpeedKmh", "restoreClass", "source"),
    "adapter": ("name", "identifier", "elmVersion", "protocol", "voltage", "gattService", "gattNotify", "gattWrite", "gattWriteType", "gattMaxWriteLength", "command", "pids", "multiPID", "responseCount", "adaptiveTiming", "rpmEvery", "timeoutMs", "requestHeader"),
}
_VECTORS = ("userAcceleration", "gravity", "rotationRate", "attitude", "magneticField")
_POLLING = COLUMNS["adapter"][10:]


def path(kind: str, column: str) -> str:
    """Where a column's value is in the payload."""
    if column[:-1] in _VECTORS:
        return f"$.{column[:-1]}.{column[-1].lower()}"
    if kind == "stats" and column.startswith(("gaps", "maxGapMs")):
        base = "maxGapMs" if column.startswith("max") else "gaps"
        return f"$.{base}.{column[len(base):].lower()}"
    if kind == "adapter" and column.startswith("gatt"):
        return f"$.gatt.{column[4].lower()}{column[5:]}"
    return f"$.polling.{column}" if kind == "adapter" and column in _POLLING else f"$.{column}"


def header(kind: Column) -> Column:
    """The first line of a kind's table."""
    lines = {k: ",".join(("t", *c)) for k, c in COLUMNS.items()} | {"marker": "t,text"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in lines.items() for x in kv)), kind), F.lit("t,data"))


def line(t: Column, kind: Column, data: Column) -> Column:
    """An event's line in its kind's table. ``data`` is JSON text."""
    text = F.coalesce(F.get_json_object(data, "$"), F.lit(""))
    out = F.when(kind == "marker", T.csv_field(F.coalesce(F.try_variant_get(F.try_parse_json(data), "$", "string"), text)))
    for k, columns in COLUMNS.items():
        values = [F.get_json_object(data, path(k, c)) for c in columns]
        if k == "adapter":
            values[columns.index("pids")] = F.array_join(F.from_json(values[columns.index("pids")], "array<string>"), ";")
        out = out.when(kind == k, F.concat_ws(",", *(T.csv_field(v) for v in values)))
    return F.concat_ws(",", t.cast("string"), out.otherwise(T.csv_field(text)))


def rows(events: DataFrame) -> DataFrame:
    """(file, header, t, line) of events (t, kind, data)."""
    kind = F.col("kind")
    name = F.concat(F.coalesce(F.nullif(T.file_name(kind), F.lit("")), F.lit("_")), F.lit(".csv"))
    return events.select(name.alias("file"), header(kind).alias("header"), "t", line(F.col("t"), kind, F.col("data")).alias("line"))


def write(events: DataFrame, folder: str) -> None:
    """Writes a folder for each kind (``file=...``) of CSV parts; each part begins with its header. A kind with many rows is many
    parts, in the order of ranges of t."""
    r = rows(events).repartitionByRange("file", "t").sortWithinPartitions("file", "t")
    part = F.spark_partition_id()
    heads = r.groupBy("file", "header", part.alias("part")).agg(F.min("t").alias("t")).select("file", "part", F.lit(0).alias("k"), "t", F.col("header").alias("line"))
    all_ = r.select("file", part.alias("part"), F.lit(1).alias("k"), "t", "line").unionByName(heads)
    all_.repartition("file", "part").sortWithinPartitions("file", "part", "k", "t").select("file", "line").write.partitionBy("file").mode("overwrite").text(folder)
