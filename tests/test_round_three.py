"""Replies, recordings written and their tails, sidecars, graph rules, circles, offset scans and the pin survey against plain Python."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import replies as P
from wayloom.operators import compare as M, offsets as O, road_rules as V, roads as R, survey as S
from wayloom.sources import recording as A, recording_writer as W, sidecar as C


def scan(lines):
    """(replies, faults) of lines with headers, one after the other."""
    replies, faults, open_, broken = [], [], {}, set()

    def fault(header, line, error, expected=None, actual=None):
        faults.append((header, line, error, expected, actual))
        if header:
            broken.add(header)
            open_.pop(header, None)

    for line in lines:
        d = line.replace(" ", "")
        size = 3 if len(d) % 2 else 8
        is_hex = all(c in "0123456789ABCDEFabcdef" for c in d)
        if not is_hex or len(d) < size + 2:
            fault(None, line, "malformedFrame" if is_hex else "malformedHex")
            continue
        h, f = d[:size], bytes.fromhex(d[size:])
        kind, low = f[0] >> 4, f[0] & 15
        if h in broken:
            fault(h, line, "malformedFrame")
        elif kind == 0 and 1 <= low <= 7 and h not in open_:
            if len(f) - 1 < low:
                fault(h, line, "truncatedFrame", low, len(f) - 1)
            else:
                replies.append([h, f[1 : 1 + low]])
        elif kind == 1 and len(f) >= 2 and h not in open_ and low * 256 + f[1] > 7:
            replies.append([h, f[2:][: low * 256 + f[1]]])
            open_[h] = [replies[-1], low * 256 + f[1], 1, line]
        elif kind == 2 and h in open_ and low == open_[h][2]:
            reply, size, _, _ = open_[h]
            reply[1] += f[1:][: size - len(reply[1])]
            open_[h][2] = (low + 1) & 15
            if len(reply[1]) >= size:
                del open_[h]
        else:
            fault(h, line, "malformedFrame")
    for h, (reply, size, _, line) in list(open_.items()):
        broken.add(h)
        faults.append((h, line, "truncatedFrame", size, len(reply[1])))
    return [(h, b.hex().upper()) for h, b in replies if h not in broken], faults


def test_random_replies(spark):
    rng = random.Random(9)
    cases = []
    for _ in range(400):
        lines, left = [], {}
        for _ in range(rng.randrange(1, 9)):
            h = rng.choice(["7E8", "7E9", "18DAF110"])
            kind = rng.choice(["single", "first", "next", "next", "junk"] if rng.random() < 0.3 else ["single", "first", "next", "next"])
            if kind == "next" and h in left:
                body = f"2{left[h]:X}" + "".join(f"{rng.randrange(256):02X}" for _ in range(7))
                left[h] = (left[h] + 1) % 16 if rng.random() < 0.9 else rng.randrange(16)
            elif kind == "first":
                body = f"10{rng.randrange(6, 30):02X}" + "".join(f"{rng.randrange(256):02X}" for _ in range(6))
                left[h] = 1
            elif kind == "junk":
                body = rng.choice(["", "3", "0", "ZZ", "10", "09410D", "00", "3F00"])
            else:
                n = rng.randrange(1, 8)
                body = f"0{n}" + "".join(f"{rng.randrange(256):02X}" for _ in range(n - (rng.random() < 0.1)))
            lines.append(h + body)
        cases.append(lines)
    df = spark.createDataFrame([(i, "\r".join(c) + "\r>") for i, c in enumerate(cases)], "i int, raw string").select("i", P.scan_replies(F.col("raw")).alias("s"))
    for r in df.collect():
        replies, faults = scan(cases[r["i"]])
        assert [tuple(x) for x in r["s"]["replies"]] == replies, cases[r["i"]]
        assert [tuple(x) for x in r["s"]["faults"]] == faults, cases[r["i"]]


def test_poll_outcomes(spark):
    raws = ["7E8 03 41 0D 40\r7E9 FF\r>", "7E9 03 41 0D 40\r7E8 FF\r>", "7E9 03 7F 01 12\r>", "NO DATA\r>", None, ">"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").withColumn("s", P.scan_replies(F.col("raw"))).withColumn("d", P.decoded(F.col("s"), [13]))
    got = [(r["o"], r["d"] and [tuple(x) for x in r["d"]]) for r in df.select("d", P.poll_outcome(F.col("s"), F.col("d")).alias("o")).collect()]
    assert got[:4] == [("ok", [("7E8", 13, 64.0)]), ("malformed", [("7E9", 13, 64.0)]), ("malformed", []), ("noData", [])]
    assert got[5] == ("malformed", [])


def test_recordings_survive_repeated_tasks(spark, tmp_path):
    where = f"file://{tmp_path}/rec"
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("session"), (F.col("id") % 500).alias("t"), F.lit("obd").alias("kind"), F.to_json(F.struct("id")).alias("data"), F.col("id").alias("line_no"))
    W.write_recordings(df, where, "job", parts=6, member_bytes=2000)
    W.write_recordings(df, where, "job", parts=6)  # the same job again: dropped as a whole
    W.write_recordings(df.limit(0), where, "empty", parts=2)
    stray = tmp_path / "rec" / "data" / "Drive_x_000000_0_lost.jsonl.gz"  # of a task that died
    stray.write_bytes(b"half")
    files = W.committed(spark, where).collect()
    assert sum(f["events"] for f in files) == 2000 and len({f["part"] for f in files if f["session"] == "hot"}) > 1
    rows = W.written_events(spark, where).collect()
    assert sorted(json.loads(r["data"])["id"] for r in rows) == list(range(2000))
    hot = [r for r in sorted((r for r in rows if r["session"] == "hot"), key=lambda r: (r["part"], r["line_no"]))]
    assert [(r["t"], json.loads(r["data"])["id"]) for r in hot] == sorted((k % 500, k) for k in range(0, 2000, 3))
    plain = spark.read.format("binaryFile").load([f["file"] for f in files]).count()
    assert plain == len(files) and {f["file"] for f in files} == {"file://" + str(p) for p in (tmp_path / "rec" / "data").iterdir() if "lost" not in p.name}
    with pytest.raises(Exception, match="time or kind"):
        W.write_recordings(df.withColumn("kind", F.lit(None).cast("string")), where, "bad", parts=1)


def test_tails_read_little(spark, tmp_path):
    def members(n, cut=b""):
        head = json.dumps({"formatVersion": 2, "sessionID": "s"}).encode() + b"\n"
        body = [b"".join(json.dumps({"t": 100 * k + j, "kind": "obd", "data": {"x": "y" * 50, "j": j}}).encode() + b"\n" for j in range(50)) for k in range(n)]
        return b"".join(A.member(x) for x in (head, *body)) + cut

    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return f"file://{tmp_path}/{name}"

    good = members(40)
    bad = bytearray(good)
    bad[-5] ^= 1  # the last member's checksum
    text = json.dumps({"formatVersion": 2}) + "\n" + "".join(json.dumps({"t": k, "kind": "obd"}) + "\n" for k in range(9000)) + "nonsense\n"
    paths = [put("few", members(4)), put("many", good), put("cut", good[:-30]), put("zeros", good + bytes(500)), put("bad", bytes(bad)), put("plain", text.encode()), put("header", A.member(b'{"formatVersion": 2}\n')), put("none", b"")]
    got = {r["file"].rsplit("/", 1)[1]: r for r in A.tails(spark, paths).collect()}
    whole = {r["file"].rsplit("/", 1)[1]: r["t"] for r in A.recordings(spark, paths).where("line_no > 0").groupBy("file").agg(F.max_by("t", "line_no").alias("t")).collect()}
    assert {k: r["last_t"] for k, r in got.items()} == {**{k: None for k in got}, **whole}
    assert got["many"]["bytes_read"] - got["few"]["bytes_read"] <= 36 * 20 + 8 and got["plain"]["bytes_read"] <= 1 << 17 and got["plain"]["size"] > 1 << 17


def test_comparison_by_bits(spark):
    one = {"latitude": 50.0, "longitude": 30.0, "headingDeg": 1.0, "headingStdDeg": 1.0, "semiMajorM": 9.0, "semiMinorM": 4.0, "orientationDeg": 0.0, "converged": True, "speedScale": 1.0, "onRoadShare": None}
    schema = "k string, t long, n int, " + ", ".join(f"{c} {'boolean' if c == 'converged' else 'double'}" for c in one)
    rows = lambda changes: spark.createDataFrame([tuple(({"k": k, "t": t, "n": 0} | one | c)[x.split()[0]] for x in schema.split(", ")) for k, t, c in changes], schema)
    nan = float("nan")
    live = rows([("same", 1, {}), ("nan", 1, {"headingDeg": nan}), ("zero", 1, {"speedScale": 0.0}), ("far", 1, {}), ("early", 1, {}), ("flag", 1, {}), ("null", 1, {})])
    replay = rows([("same", 1, {}), ("nan", 1, {"headingDeg": nan}), ("zero", 1, {"speedScale": -0.0}), ("far", 1, {"latitude": 50.1}), ("early", 1, {}), ("early", 2, {}), ("flag", 1, {"converged": False}), ("null", 1, {"onRoadShare": 0.0})])
    got = {r["k"]: r for r in M.compared(M.matched(live, replay, ["k"]), ["k"]).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"same": "exact", "nan": "exact", "zero": "within", "far": "different", "early": "different", "flag": "different", "null": "within"}
    assert got["early"]["right_only_after_end"] == 1 and got["null"]["share"] == 1.0 and got["far"]["first_difference"] == 1


def test_sidecar_of_odd_files(spark, tmp_path):
    head = {"kind": "header", "sidecarVersion": 3, "sessionID": "00000000-0000-4000-8000-000000000001", "seed": 5.0, "configHash": "c", "configJSON": "{}", "appBuild": "b", "x": 1}
    pin = {"kind": "pin", "t": 4, "latitude": "inf", "longitude": 2, "prior": None}
    files = {"blank": "\n", "fine": json.dumps(head) + "\n" + json.dumps(pin) + "\n", "cut": json.dumps(head) + "\n" + json.dumps(pin)[:-4], "gap": json.dumps(head) + "\n\n" + json.dumps(pin), "uuid": json.dumps(head | {"sessionID": "x"}) + "\n", "seed": json.dumps(head | {"seed": -1}) + "\n", "list": json.dumps(head) + "\n[1]\n7\n", "prior": json.dumps(head) + "\n" + json.dumps(pin | {"prior": {"t": 1}}) + "\n" + json.dumps(pin)}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = C.checked(C.file_lines(spark, [f"file://{tmp_path}/{n}" for n in files]))
    got = {r["file"].rsplit("/", 1)[1]: (r["error"], r["error_line"], r["pins"], r["truncated"]) for r in C.report(rows).collect()}
    assert got == {"blank": ("missingHeader", 1, None, None), "fine": (None, None, 1, False), "cut": (None, None, 0, True), "gap": ("malformedLine", 2, None, None), "uuid": ("missingHeader", 1, None, None), "seed": ("missingHeader", 1, None, None), "list": ("malformedLine", 2, None, None), "prior": ("malformedLine", 2, None, None)}
    assert [(r["latitude"], r["prior"]) for r in C.values(rows, "pin").collect()] == [(math.inf, None)]


def test_truth_entries(spark):
    files = spark.createDataFrame([("a", json.dumps({"Drive_1.jsonl": {}, "Drive_1": {"scoreUntilT": 3}, "Drive_2.jsonl.gz": {"end": {"latitude": 1, "longitude": 2}}})), ("b", "nonsense"), ("c", "[]"), ("d", json.dumps({"x": {"points": {}}})), ("e", None)], "file string, value string")
    t = C.truth(files)
    assert sorted((r["file"], r["failure"]) for r in t.where("failure is not null").collect()) == [("b", "malformed"), ("c", "malformed"), ("d", "malformed"), ("e", "malformed")]
    names = spark.createDataFrame([("Drive_1",), ("Drive_1.jsonl.gz",), ("Drive_2",), ("Drive_3",)], "recording string")
    assert {r["recording"]: r["entry"] for r in C.truth_entry(t, names).collect()} == {"Drive_1": "Drive_1", "Drive_1.jsonl.gz": "Drive_1", "Drive_2": "Drive_2.jsonl.gz", "Drive_3": None}


def test_rules_of_a_built_graph(spark):
    """What the library builds breaks no rule; the query's planted faults are found by SQL."""
    rng = random.Random(3)
    rows = [(w, i, rng.randrange(30)) for w in range(12) for i in range(6)]
    n = R.without_repeats(spark.createDataFrame([(w, i, v, 500_000_000 + v * 977, 300_000_000 + v * v * 31) for w, i, v in rows], "way_id long, pos long, node_id long, lat_e7 long, lon_e7 long"))
    e = R.split_edges(n).orderBy("way_id", "offset").collect()
    number = {r["node_id"]: r["number"] for r in R.numbered_nodes(spark.createDataFrame(e)).collect()}
    at = {(r["way_id"], r["pos"]): r for r in n.collect()}
    edges, points, first = [], [], 0
    for k, r in enumerate(e):
        edges.append((k, r["way_id"], r["offset"], number[r["from_node"]], number[r["to_node"]], first, r["points"], 1, 0, 0))
        points += [(first + j, k, at[r["way_id"], r["offset"] + j]["lat_e7"], at[r["way_id"], r["offset"] + j]["lon_e7"]) for j in range(r["points"])]
        first += r["points"]
    places = {number[r["node_id"]]: (r["lat_e7"], r["lon_e7"]) for r in at.values() if r["node_id"] in number}
    E = spark.createDataFrame(edges, "edge long, way_id long, offset long, from_node long, to_node long, first_point long, points long, class int, level int, flags int")
    Pt = spark.createDataFrame(points, "point long, edge long, lat_e7 long, lon_e7 long")
    N = spark.createDataFrame([(k, *v) for k, v in places.items()], "node long, lat_e7 long, lon_e7 long")
    adj = R.adjacency(E.withColumn("edge_id", F.col("edge"))).select(F.col("node_id").alias("node"), F.posexplode("edges").alias("place", "edge"))
    cells = Pt.join(Pt.groupBy("edge").agg(F.max("point").alias("last")), "edge").where("point < last").select((F.col("point") % 4).alias("cell"), F.col("point").alias("place"), "point")
    assert V.violations(N, E, Pt, adj, cells).collect() == []
    bad = V.violations(N.where("node > 0"), E, Pt, adj, cells).collect()
    assert {r["rule"] for r in bad} == {"node"}


def test_circles_at_the_edge(spark):
    square = [(0, 0), (0, 2000), (2000, 2000), (2000, 0)]
    hole = [(500, 500), (500, 1500), (1500, 1500), (1500, 500)]
    step = 1e-5  # about 1.11 m; corners in hundredths of that
    rings = spark.createDataFrame([("a", r, i, int(y * step * 1e7), int(x * step * 1e7)) for r, ring in enumerate((square, hole)) for i, (y, x) in enumerate(ring)], "area string, ring int, i int, lat_e7 long, lon_e7 long")
    m = 110_574.2757  # metres of a degree of latitude at the equator
    cases = {"inside": (250, 250, 0.0), "in_hole": (1000, 1000, 100.0), "reaches_hole": (1000, 1000, 600.0), "outside": (-300, 1000, 300 * step * m - 1), "touching": (-300, 1000, 300 * step * m + 0.1), "around": (1000, 1000, 9000.0), "negative": (250, 250, -1.0), "nan": (250, 250, float("nan"))}
    c = spark.createDataFrame([(k, y * step, x * step, r) for k, (y, x, r) in cases.items()], "key string, lat double, lon double, radius_m double")
    assert {r["key"] for r in O.circles_covering(c, rings, "key", 5000.0).collect()} == {"inside", "reaches_hole", "touching", "around"}


def test_scan_equals_one_fine_grid(spark):
    """81 x 81 shifts of 10 m, then 21 x 21 of 1 m, on a straight track beside its road."""
    import numpy as np

    segs = [(1, 0, -2000.0, 0.0, 2000.0, 0.0), (2, 0, 40.0, -900.0, 40.0, 900.0), (3, 0, -900.0, 333.0, 900.0, 350.0)]
    pts = [("w", i, 25.0 * i - 100, -37.0) for i in range(9)]
    index = R.grid_index(spark.createDataFrame(segs, "way_id int, seg int, ax double, ay double, bx double, by double"), 100.0, 100.0)
    p = spark.createDataFrame(pts, "key string, i int, px double, py double").unionByName(spark.createDataFrame([("few", 0, 0.0, 0.0)], "key string, i int, px double, py double"))
    (r,) = O.two_level_scan(p, index, "key", 100.0, 400.0, 10.0, 1.0).collect()

    def score(dx, dy):
        x, y = np.array([q[2] for q in pts]) + dx, np.array([q[3] for q in pts]) + dy
        d = np.full(len(pts), 100.0)
        for _, _, ax, ay, bx, by in segs:
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
            d = np.minimum(d, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return round(float(d.mean()), 6)

    coarse = {(dx, dy): score(dx, dy) for dx in range(-400, 401, 10) for dy in range(-400, 401, 10)}
    order = lambda s: (s[1], round(math.hypot(*s[0]), 6), *s[0])
    top = min(coarse.items(), key=order)[0]
    fine = {(top[0] + a, top[1] + b): score(top[0] + a, top[1] + b) for a in range(-10, 11) for b in range(-10, 11)}
    best = min(fine.items(), key=order)
    far = {s: v for s, v in coarse.items() if math.hypot(s[0] - best[0][0], s[1] - best[0][1]) >= 100}
    second = min(far.items(), key=order)
    assert ((r["best_dx"], r["best_dy"]), r["best"]) == best and ((r["runner_dx"], r["runner_dy"]), r["runner"]) == second
    assert r["recorded"] == score(0, 0) and r["rank"] == sum(v <= score(0, 0) for v in coarse.values()) / 81**2


def test_picks_against_loops(spark):
    rng = random.Random(6)
    o = S.Options(picks=5, apart=60.0)
    for trial in range(4):
        cands = sorted({rng.randrange(0, 900) for _ in range(50)})
        rows = [(t * S.SECOND, rng.choice(S.CONTEXTS[: trial + 1])) for t in cands]
        got = [(r["t"], r["context"]) for r in S.spread_picks(spark.createDataFrame([("s", t, -7 * S.SECOND, c) for t, c in rows], "session string, t long, first long, context string"), o).orderBy("place").collect()]
        picked, done = [], set()
        while len(picked) < 5 and len(done) < 3:
            for c in S.CONTEXTS:
                if len(picked) < 5 and c not in done:
                    pool = [(min((abs(p - t) for p, _ in picked), default=t + 7 * S.SECOND), -t) for t, k in rows if k == c and all(abs(p - t) >= 60 * S.SECOND for p, _ in picked)]
                    picked.append((-max(pool)[1], c)) if pool else done.add(c)
        assert got == sorted(picked)


def test_running_sums_across_blocks(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(0, 400), i, float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, n int, v double")
    for block in (7, 100, 10_000):
        got = {r["n"]: r["total"] for r in S.cumulative(df, ["k"], "t", "v", "n", block, 1.0, hold=5).collect()}
        for k in "ab":
            total, last = 0.0, None
            for _, t, n, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                total += last[1] * min(5, t - last[0]) if last else 0
                last = (t, v)
                assert abs(got[n] - total) < 1e-9


def test_means_latches_and_thinning_across_blocks(spark):
    from wayloom.operators import sequence as Q

    rng = random.Random(12)
    rows = [(rng.choice("ab"), rng.randrange(0, 6000) if rng.random() < 0.9 else rng.randrange(0, 200_000), i, float(rng.randrange(100))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, n int, v double")
    mean = {r["n"]: r["mean"] for r in Q.smoothed(df, ["k"], "t", "n", "v", 37).collect()}
    latch = {dwell: {r["n"]: (r["on"], r["rises"]) for r in Q.latched(df, ["k"], "t", "n", "v", 30, 70, 100, dwell).collect()} for dwell in (0, 40)}
    kept = {(r["k"], r["n"]) for r in Q.thinned(df, ["k"], "t", "n", 90).collect()}
    want = set()
    for k in "ab":
        m, last, at = None, None, None
        state, since = {0: False, 40: False}, None
        for _, t, n, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            m = v if m is None else m + (1 - math.exp(-(t - last) / 37)) * (v - m)
            last = t
            assert abs(mean[n] - m) < 1e-6
            since = None if v >= 30 else t if since is None else since
            for dwell, was in list(state.items()):
                now = True if v > 70 else False if v < 30 and t - since >= dwell else was
                assert latch[dwell][n] == (now, now and not was)
                state[dwell] = now
            if at is None or t - at >= 90:
                want.add((k, n))
                at = t
    assert kept == want


def test_csv_parts_have_headers(spark, tmp_path):
    import csv
    import io

    from wayloom.sources import csv_export as X

    rows = [(k, "obd", json.dumps({"pid": 13, "value": k, "raw": 'a"b,\nc'})) for k in range(40)] + [(5, "marker", '"hi, you"'), (6, "we/ird", '{"b":1}'), (7, "", None), (8, "motion", "nonsense"), (9, "adapter", json.dumps({"name": "n", "gatt": {"writeType": "w", "maxWriteLength": 20}, "polling": {"pids": [12, 13], "multiPID": True}}))]
    X.write(spark.createDataFrame(rows, "t long, kind string, data string"), f"file://{tmp_path}/csv")
    found = {}
    for folder in (tmp_path / "csv").iterdir():
        if folder.name.startswith("file="):
            for part in sorted(folder.glob("part-*")):
                lines = list(csv.reader(io.StringIO(part.read_text())))
                found.setdefault(folder.name[5:], []).append(lines)
    obd = [r for part in found["obd.csv"] for r in part if r[0] != "t"]
    assert sorted(int(r[0]) for r in obd) == list(range(40)) and all(r[4] == 'a"b,\nc' and len(r) == 9 for r in obd)
    assert found["obd.csv"][0][0][:3] == ["t", "pid", "value"]
    assert found["marker.csv"] == [[["t", "text"], ["5", "hi, you"]]] and found["we_ird.csv"] == [[["t", "data"], ["6", '{"b":1}']]] and found["_.csv"] == [[["t", "data"], ["7", ""]]]
    (head, row), = found["adapter.csv"]
    got = dict(zip(head, row))
    assert (got["name"], got["gattWriteType"], got["gattMaxWriteLength"], got["pids"], got["multiPID"], got["rpmEvery"]) == ("n", "w", "20", "12;13", "true", "")


def test_manifests_of_odd_text(spark):
    from wayloom.sources import manifest as M

    top = {"schema": 2, "generated": "g", "license": "l", "licenseUrl": "u", "attribution": "a"}
    files = [("null", None), ("empty", ""), ("none", json.dumps(top | {"packs": []})), ("mixed", json.dumps(top | {"schema": 2.0, "packs": [None, [], {"name": "x"}]})), ("float", json.dumps(top | {"schema": 2.5, "packs": []}))]
    f, e = M.read(spark.createDataFrame([(n, "h", v) for n, v in files], "file string, host string, value string"))
    assert {r["file"]: r["failure"] for r in f.collect()} == {"null": "notJSON", "empty": "notJSON", "none": None, "mixed": None, "float": "mistypedField:schema"}
    assert [(r["idx"], r["name"], r["reason"]) for r in e.orderBy("idx").collect()] == [(0, None, "notAnObject"), (1, None, "notAnObject"), (2, "x", "missingField:kind")]


def test_opl_lines_with_problems(spark):
    from wayloom.sources import osm as Q

    lines = ["w1 Nn1", "w2 N", "w Nn1", "w3 T Nn1x1.5y2,n2xy,n3", "w4 Nn1x400000y2", "w5 Ta=%61% Nn1", "w6 Ta=%% Nn1", "n7 bad", "w8 Nn1x1y2\r"]
    got = {r["n"]: r["message"] for r in Q.opl_problems(spark.createDataFrame(list(enumerate(lines)), "n int, value string"), "n").collect()}
    assert got == {2: "bad way id", 4: "node 1: bad location", 6: "bad % escape"}
