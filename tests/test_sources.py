"""Recordings with damage, OPL ways, GeoJSON rings, framed replies."""

import json

import pytest

from wayloom.sources import osm, recording as R

HEADER = json.dumps({"formatVersion": 2, "sessionID": "s1", "startedAt": "2024-01-01T00:00:00Z"})


def event(t, kind="obd", data=None):
    return json.dumps({"t": t, "kind": kind, "data": data if data is not None else {"pid": 13}})


def write(tmp_path, name, parts):
    p = tmp_path / name
    p.write_bytes(b"".join(parts))
    return f"file://{p}"


def test_recording_members(spark, tmp_path):
    a, b, c = (R.member((x + "\n").encode()) for x in (HEADER + "\n" + event(-5), event(9007199254740993, "new", {"a": [1, None]}), event(7, "marker", "hi")))
    bad = bytearray(b)
    bad[-6] ^= 1
    paths = [write(tmp_path, "good", [a, b, c]), write(tmp_path, "bad", [a, bytes(bad), c]), write(tmp_path, "cut", [a, b, c[:-9]]), write(tmp_path, "zeros", [a, bytes(64)]), write(tmp_path, "plain", [f"{HEADER}\r\n\n{event(3)}\nnonsense\n{event(4)}".encode()])]
    rows = R.recordings(spark, paths).collect()
    by = {}
    for r in rows:
        by.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["t"], r["kind"], r["data"]))
    assert sorted(by["good"])[1:] == [(1, -5, "obd", '{"pid":13}'), (2, 9007199254740993, "new", '{"a":[1,null]}'), (3, 7, "marker", '"hi"')]
    assert [x[1] for x in sorted(by["bad"])[1:]] == [-5, 7]
    assert [x[1] for x in sorted(by["cut"])[1:]] == [-5, 9007199254740993]
    assert [(x[0], x[1]) for x in sorted(by["plain"])[1:]] == [(1, 3), (3, 4)]
    report = {r["file"].rsplit("/", 1)[1]: r for r in R.read_report(spark, paths).collect()}
    assert report["bad"]["damaged_members"] == [1] and not report["bad"]["truncated_tail"]
    assert report["cut"]["truncated_tail"] and report["zeros"]["truncated_tail"]
    assert report["plain"]["skipped_lines"] == [2] and report["good"]["failure"] is None
    c = R.catalogue(R.recordings(spark, paths[:1])).collect()[0]
    assert (c["session_id"], c["events"], c["first_t"]) == ("s1", 3, -5)


def test_recording_refusals(spark, tmp_path):
    import gzip

    newer = write(tmp_path, "newer", [json.dumps({"formatVersion": 99}).encode()])
    foreign = write(tmp_path, "foreign", [gzip.compress(HEADER.encode())])
    none = write(tmp_path, "none", [b""])
    report = {r["file"].rsplit("/", 1)[1]: r["failure"] for r in R.read_report(spark, [newer, foreign, none]).collect()}
    assert "newer" in report["newer"] and "lengths" in report["foreign"] and report["none"] is None
    bad = write(tmp_path, "line", [f"{HEADER}\nnonsense\n".encode()])
    with pytest.raises(Exception, match="malformed line 1"):
        R.recordings(spark, [bad], "strict").collect()


def test_opl(spark):
    lines = ["n5 v1 x1 y2", "w7 v1 dV c0 t i0 u Thighway=primary,name=A%20%B%2c%C Nn1x30.1234567y50.1,n2x-0.5y7,n3,n4x1.12345678y2", "w8 v1 T N"]
    df = osm.opl_ways(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = {x["way_id"]: x for x in df.collect()}
    assert r[7]["tags"] == {"highway": "primary", "name": "A B,C"} and r[8]["nodes"] == []
    assert [tuple(n) for n in r[7]["nodes"]] == [(1, 501000000, 301234567), (2, 70000000, -5000000), (3, None, None), (4, 20000000, None)]
    assert osm.way_nodes(df).count() == 4


def test_geojson(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    docs = [("p", json.dumps({"type": "Polygon", "coordinates": [square, [[1, 1], [2, 1]]]})), ("f", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]}))]
    out = osm.geojson_rings(spark.createDataFrame(docs, "area string, value string")).groupBy("area", "ring").count().collect()
    assert sorted((r["area"], r["count"]) for r in out) == [("f", 4), ("f", 4), ("p", 4)]


def test_framer(spark):
    df = spark.createDataFrame([(1, 0, "41 0"), (1, 1, "D 20\r>NO\0 DA"), (1, 2, "TA>rest")], "s int, n int, x string")
    assert [r["reply"] for r in osm.framed_replies(df, ["s"], "n", "x").orderBy("place").collect()] == ["41 0D 20\r", "NO DATA"]


def test_trailing_line_breaks(spark):
    """A pattern's end is the text's end, not the place before a last line break."""
    from pyspark.sql import functions as F

    from wayloom.functions import text as T

    rows = spark.createDataFrame([("010D", "ab"), ("010D\n", "ab\n")], "wire string, hash string")
    got = rows.select(T.allowed_command(F.col("wire")).alias("a"), T.lower_hex(F.col("hash"), 2).alias("h")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_rings_of_many_parts_keep_apart(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = json.dumps({"type": "MultiPolygon", "coordinates": [[square] * 1001, [square] * 2]})
    rings = osm.geojson_rings(spark.createDataFrame([("a", doc)], "area string, value string"))
    assert rings.select("ring").distinct().count() == 1003
