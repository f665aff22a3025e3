"""The training-data operators on odd rows and against brute force."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF, rows_of
from wayloom.llm import chat, exact, fuse, knn, langid, media, mixing, ngram_join, pack, passages, registry, tokens, warc
from wayloom.llm import words as W
from wayloom.llm.common import connected_components, joined_components, table_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, block string, lead long, score double, rejected boolean, lang_pred string, tokens long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, rows):
    """Documents of (doc_id, text, lang, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, "x", 1, "y", 2, 0.5, True, "z", 3) for r in rows], SCHEMA).withColumn("__text", F.lit("t"))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    long = prose(rng, 30_000, 5000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, "one", "en", "a"), (5, "One", "de", "b"), (6, "one two three", None, "b"), (7, long, "en", "a"), (8, long, "en", "a"), (9, "é́ ünï 漢字 😀 <|endoftext|> [INST]", "fr", "c"), (9, "second row of nine", "fr", "c"), (9, "second row of nine", "fr", "c"), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (10, "123 456 !!", "es", "c")]
    rows += [(20 + k, prose(rng, 80), ("en", "de")[k % 2], "ab"[k % 2]) for k in range(20)]
    return docs_of(spark, rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = rows_of(registry.queries()[name](spark, SF).toArrow())
    want = duck.sql(registry.oracle_sql()[name]).arrow()
    assert got == rows_of(want.read_all() if hasattr(want, "read_all") else want)


def test_words_and_ngrams():
    texts = ["", None, "a b c d e", "  A b\tC  ", "one", "a b c", "x\ny z w A B C D", "A B C D", "é É"]
    seen = {}
    for size, k in itertools.product((1, 6, 1 << 20), (1, 4, 5)):
        for s in W.slices(pa.array(texts), size=size):
            words, starts, ends, bounds = W.hashed_words(s)
            grams, at = W.ngrams(words, bounds, k)
            for d in range(s.rows):
                w = WORD.findall(lower(texts[s.first + d]))
                want = [tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0))]
                got = grams[at[d] : at[d + 1]].tolist()
                assert len(got) == len(want)
                for g, x in zip(got, want):
                    assert seen.setdefault((k, x), g) == g
    for k in (1, 4, 5):
        one = [g for (j, _), g in seen.items() if j == k]
        assert len(set(one)) == len(one)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in parent}
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(df, "u", "v").collect()} == want
    half = joined_components(None, df.limit(60))
    both = joined_components(half, df)
    assert {r["node"]: r["component"] for r in both.collect()} == want


# 1 ---------------------------------------------------------------------------------------------------------------


def shingle_sets(rows, k):
    out = []
    for i, text in rows:
        w = WORD.findall(lower(text))
        out.append((i, {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1 if w else 0))}))
    return out


def brute_components(sets, percent):
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is None or b is None or not x or not y:
            continue
        n = len(x & y)
        if 100 * n >= percent * (len(x) + len(y) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_ngram_join_brute_force(spark, odd):
    rng = np.random.default_rng(11)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    passage = prose(rng, 60, 10_000)
    base = prose(rng, 150, 10_000).split()
    for k in range(60):  # a group of near copies, some further apart than others
        w = list(base)
        for p in rng.integers(0, len(w), k % 7):
            w[p] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, passage + " " + prose(rng, int(rng.integers(1, 80)), 10_000)) for k in range(30)]
    far = prose(rng, 80, 10_000).split()
    for k in range(150):  # near copies of which many are too far apart, and none is the original
        w = list(far)
        for p in rng.choice(80, 1 + k % 6, replace=False):
            w[p] = f"y{k}.{p}"
        rows.append((300 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        want = brute_components(shingle_sets(rows, k), percent)
        got = ngram_join.jaccard_components(df, k, percent).collect()
        assert len(got) == len(rows)
        assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == want
        sizes = sorted((str(i), len(s)) for i, s in shingle_sets(rows, k))
        assert sorted((str(r["id"]), r["n_shingles"]) for r in got) == sizes


def test_ngram_join_empty(spark):
    assert ngram_join.jaccard_components(docs_of(spark, [])).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "u", "a" * 100_000), (2, "u x", "a" * 100_000), (3, None, None), (4, "v", ""), (None, "v", ""), (2, "u", "a" * 100_000), (9, "w", "é\r\n0\r\n\r\n" * 9000), (5, "z", "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id long").select("page_id", "url", "html", "id", F.lit("k").alias("keep"))
    manifest = warc.write_archives(df, table_path(spark, "archives"), segment=5000)
    records = warc.read_archives(manifest).collect()
    assert sum(r["records"] for r in manifest.collect()) > len(rows) and len(records) == len(rows)
    texts = {r["page"]: bytes(r["payload"]).decode() for r in records if r["kind"] == "response"}
    assert texts == {"2": "a" * 100_000, "4": "", "9": "é\r\n0\r\n\r\n" * 9000, "5": "short"} and not any(r["problem"] for r in records)
    out = {(r["page"], r["record_type"]): r for r in warc.resolve(warc.read_archives(manifest)).collect()}
    assert out["1", "revisit"]["refers_page"] == "2" and out["1", "revisit"]["payload_bytes"] == 100_000
    assert out["3", "revisit"]["refers_page"] == "4" and out["", "revisit"]["payload_bytes"] == 0


def test_warc_repeated_ids(spark):
    """An id that stands for several payloads is a record for each."""
    pages = spark.createDataFrame([(5, "u", "a"), (5, "u", "b"), (3, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    out = warc.resolve(warc.read_archives(warc.write_archives(pages, table_path(spark, "archives")))).collect()
    got = sorted((r["page"], r["record_type"], r["digest"], r["refers_page"]) for r in out)
    a, b = warc.digest(b"a"), warc.digest(b"b")
    assert got == sorted([("5", "response", a, None), ("5", "response", b, None), ("3", "revisit", a, "5"), ("2", "revisit", b, "5")], key=str)


def test_warc_damage(spark, tmp_path):
    def archive(name, records):
        import gzip

        (tmp_path / name).write_bytes(b"".join(gzip.compress(r) for r in records))
        return f"file://{tmp_path}/{name}"

    parts = warc.page_records(1, "u", b"x" * 40_000, None, False, 9000)
    other = warc.page_records(2, "u", b"y" * 100, None, False)
    broken = other[0].replace(b"y" * 50, b"z" * 50)
    m = spark.createDataFrame([(archive("a", [parts[0], *parts[2:]]), 1, 1), (archive("b", [broken]), 1, 1)], "path string, records long, bytes long")
    assert sorted(r["problem"] for r in warc.read_archives(m).collect()) == ["missing segment", "wrong digest"]
    with pytest.raises(Exception, match="missing segment|wrong digest"):
        warc.resolve(warc.read_archives(m)).collect()
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), table_path(spark, "none")).count() == 0


def test_warc_query(spark):
    got = {r["page_id"]: r for r in warc.op2_warc(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    last = {}
    for p in pages:
        last[p["html"] or ""] = max(last.get(p["html"] or "", -1), p["page_id"])
    for p in pages:
        raw, r = (p["html"] or "").encode(), got[p["page_id"]]
        keep = last[p["html"] or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == p["page_id"] else ("revisit", keep))


# 3 ---------------------------------------------------------------------------------------------------------------


def test_raking_meets_targets(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(s, g, t, int(rng.integers(1, 1000))) for s in "abc" for g in "xy" for t in "uv"] + [("d", "x", "u", 0)], "source string, lang string, topic string, tokens long")
    found, tokens, far = mixing.fitted(cells)
    c = found.toPandas()
    assert far <= mixing.TOLERANCE and (c.p <= 1).all() and (c.p > 0).all() and c[c.source == "d"].p.tolist() == [1.0]
    kept = c.p * c.tokens
    assert abs(kept.sum() - tokens) < 1e-3 * tokens
    for d, power in mixing.POWERS.items():  # the expected shares of the kept tokens, not only the weights
        sums = c[c.tokens > 0].groupby(d).tokens.sum() ** power
        got = kept.groupby(c[d]).sum()
        assert all(abs(got[v] / kept.sum() - sums[v] / sums.sum()) < 1e-5 for v in sums.index)


def test_sampled_shares(spark):
    """The tokens of the documents that are kept have the targets' shares, but for the sampling of whole documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs).withColumn("tokens", mixing.token_count(F.col("text"))).toPandas()
    for d, power in mixing.POWERS.items():
        sums = rows.groupby(f"__{d}").tokens.sum() ** power
        got = rows[rows.__kept].groupby(f"__{d}").tokens.sum()
        assert abs(got / got.sum() - sums / sums.sum()).max() < 0.04


def test_mixing_odd_rows(spark, odd):
    out = mixing.mixed(odd).collect()
    assert len(out) == odd.count() and all(0 < r["__p"] <= 1 for r in out)
    assert mixing.sample_mixed(odd).columns == odd.columns
    assert mixing.sample_mixed(docs_of(spark, [])).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------


def test_compact_windows_brute_force():
    rng = np.random.default_rng(1)
    col = pa.array([prose(rng, n, 60) for n in (30, 50, 120, 300)])
    for s in W.slices(col):
        f, _, d, l, c, r = passages.compact_windows(s, hashes=2, least=12)
        words, _, _, bounds = W.hashed_words(s)
        grams, at = W.ngrams(words, bounds, 5)
        want = set()
        for k in range(2):
            h = W.mix(grams ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(24)
            for x in range(s.rows):
                v = [(int(h[i]), i) for i in range(at[x], at[x + 1])]
                for i in range(len(v)):
                    a = b = i
                    while a and v[a - 1] > v[i]:
                        a -= 1
                    while b < len(v) - 1 and v[b + 1] > v[i]:
                        b += 1
                    if b - a + 1 >= 12:
                        want.add((k, x, a, i, b))
        assert set(zip(f.tolist(), d.tolist(), l.tolist(), c.tolist(), r.tolist())) == want


def test_repeated_passages(spark, odd):
    rng = np.random.default_rng(8)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    shared, near = prose(rng, 70, 10_000), prose(rng, 90, 10_000).split()
    line = "this line stands in every document"
    rows += [(300 + k, f"{prose(rng, 40 + k, 10_000)} {line} {shared if k % 2 else ''} {prose(rng, 60, 10_000)}") for k in range(12)]
    for k in range(4):
        w = list(near)
        w[20 * k + 5] = f"edit{k}"
        rows.append((400 + k, " ".join([prose(rng, 55, 10_000), *w, prose(rng, 20, 10_000)])))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["id"], []).append((r["start_word"], r["n_words"]))
        assert r["n_words"] >= 50
    assert set(spans) == {7, 8, *range(301, 312, 2), *range(400, 404)}
    for k in range(301, 312, 2):
        start = 40 + (k - 300) + 6
        (a, n), = spans[k]
        assert a <= start and a + n >= start + 70 and n <= 85  # line and passage are 76 words, 72 shingles: 72 / (2 * 81 - 72) = 0.8
    assert spans[7] == [(0, 30_000)]
    assert passages.repeated_passages(docs_of(spark, [])).count() == 0


def edited(rng, words, edits, kind):
    """The words with ``edits`` inserted or deleted ones."""
    out = list(words)
    for k in sorted(rng.choice(np.arange(8, len(out) - 8), edits, replace=False).tolist(), reverse=True):
        out[k:k + (kind == "delete")] = [f"edit{k}"] if kind == "insert" else []
    return out


@pytest.mark.parametrize("kind", ["insert", "delete"])
def test_passages_with_edits(spark, kind):
    """Words inserted or deleted between unlike contexts; every span found holds the similarity by brute force."""
    rng = np.random.default_rng(17)
    texts, expected = {}, {}
    for k in range(40):
        n, edits = ((60, 1), (80, 1), (150, 3), (230, 4))[k % 4]
        passage = prose(rng, n, 100_000).split()
        for side, words in ((0, passage), (1, edited(rng, passage, edits, kind))):
            texts[2 * k + side] = [*prose(rng, 200, 100_000).split(), *words, *prose(rng, 200, 100_000).split()]
            expected[2 * k + side] = range(200, 200 + len(words))
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r["id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = lambda i: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)})(texts[i][got[i]["start_word"] : got[i]["start_word"] + got[i]["n_words"]])
    for i, r in got.items():
        assert r["partner"] == i ^ 1 and r["n_words"] >= 50
        assert len(grams(i) & grams(i ^ 1)) >= 0.8 * len(grams(i) | grams(i ^ 1))
    whole = [i for i, r in got.items() if len(set(range(r["start_word"], r["start_word"] + r["n_words"])) & set(expected[i])) >= 0.9 * len(expected[i])]
    assert len(whole) >= 74  # two of four functions agree for 97 % at a similarity of 0.8


def test_chain_brute_force():
    """The longest stretch against all pairs of ranges, on distinct shingles with inserted and deleted places."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.permutation(1000)[:30]
        y = np.array(edited(rng, x.tolist(), int(rng.integers(1, 4)), "delete"))
        y = np.insert(y, rng.integers(0, len(y), 2), [2000, 2001])
        best = 0
        for p in range(len(x)):
            for q in range(p + 12, len(x) + 1):
                if q - p > best and any(passages.similar(x[p:q], y[u:v]) for u in range(len(y)) for v in range(u + 12, len(y) + 1)):
                    best = q - p
        found = passages.longest_chain(x, y, 0, 12)
        assert (found is None) == (best == 0)
        if found:
            p, q, u, v = found
            assert passages.similar(x[p:q], y[u:v]) and min(q - p, v - u) >= 12
            assert q - p >= best - 6


def replaced(rng, words, edits, name):
    out = list(words)
    for p in rng.choice(np.arange(4, len(out) - 4), edits, replace=False):
        out[p] = f"{name}.{p}"
    return out


def test_passage_recall(spark):
    """Edited copies of passages in 1, 4, 30 and 300 verbatim copies, one to three edits, against brute force."""
    rng = np.random.default_rng(31)
    texts, cases, n = {}, {}, 0
    for copies, groups, edited_ in ((1, 12, 2), (4, 6, 3), (30, 2, 12), (300, 1, 24), (1, 1, 20)):
        for _ in range(groups):
            base = prose(rng, 60, 100_000).split() if edited_ > 10 else prose(rng, int(rng.integers(60, 170)), 100_000).split()
            own = []
            for k in range(copies + edited_):
                most = 1 if len(base) < 110 else 2 if len(base) < 155 else 3
                words = base if k < copies else replaced(rng, base, int(rng.integers(1, most + 1)), f"e{n}")
                texts[n] = ([*prose(rng, 80, 100_000).split(), *words, *prose(rng, 80, 100_000).split()], words)
                own.append(n)
                n += 1
            cases[(copies, edited_, own[0])] = (own, copies)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows = [(i, " ".join(t)) for i, (t, _) in texts.items()]
    found = {r["id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, all_ = {}, {}
    for (copies, edited_, _), (own, c) in cases.items():
        for i in own[c:]:
            x = grams(texts[i][1])
            near = any(j != i and len(x & grams(texts[j][1])) >= 0.8 * len(x | grams(texts[j][1])) for j in own)
            if near:
                all_[copies, edited_] = all_.get((copies, edited_), 0) + 1
                hit[copies, edited_] = hit.get((copies, edited_), 0) + (i in found)
        if copies > 1:
            assert found >= set(own[:c])
    assert all(v >= 12 for v in all_.values()) and sum(all_.values()) >= 90
    assert sum(hit.values()) >= 0.9 * sum(all_.values()), (hit, all_)
    assert all(hit[k] >= 0.75 * all_[k] for k in all_), (hit, all_)


def test_long_text_places():
    """Places beyond 24 bits: windows of a long text are those of its parts, moved."""
    words = " ".join(f"w{k * 7919 % 1_000_003}" for k in range(120))
    for s in W.slices(pa.array([words])):
        _, name, _, l, c, r = passages.compact_windows(s)
        assert len(name) and (l <= c).all() and (c <= r).all() and (r - l + 1 >= passages.LEAST).all()


def test_passages_beyond_the_lead(spark):
    """Two documents share more with each other than with their group's first; touching passages keep all links."""
    rng = np.random.default_rng(23)
    new = lambda n: prose(rng, n, 100_000)
    rows = []
    for k in range(12):
        p, q = new(60), new(16)
        rows += [(10 * k + 1, f"{new(150)} {p} {new(150)}"), *((10 * k + x, f"{new(150)} {p} {q} {new(150)}") for x in (2, 3))]
    one, two = new(70), new(70)
    rows += [(1001, f"{new(150)} {one} {new(150)}"), (1002, f"{new(150)} {two} {new(150)}"), (1003, f"{new(90)} {two} {new(90)}"), (1004, f"{new(150)} {one} {two} {new(150)}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ends = {(r["id"], r["start_word"] + r["n_words"]) for r in got}
    assert sum(any(i == 10 * k + x and e >= 150 + 76 for i, e in ends) for k in range(12) for x in (2, 3)) == 24
    assert {r["class"] for r in got if r["id"] > 1000} == {1001} and {r["id"] for r in got if r["id"] > 1000} == {1001, 1002, 1003, 1004}
    assert all(r["class"] == r["id"] // 10 * 10 + 1 for r in got if r["id"] < 1000)


def test_passages_of_common_lines(spark):
    """A passage whose every key is common, in two documents that are neither their keys' first nor next to each other."""
    rng = np.random.default_rng(42)
    new = lambda n: prose(rng, n, 100_000)
    lines = [new(12) for _ in range(5)]
    rows = [(k, f"{new(60)} {lines[k % 4]} {lines[k % 4 + 1]} {new(60)}") for k in range(1200)]
    rows += [(k, f"{new(60)} {' '.join(lines)} {new(60)}") for k in (2001, 2002)]
    got = {r["id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2001, 2002}
    assert all(r["class"] == 2001 and r["start_word"] <= 60 and r["start_word"] + r["n_words"] >= 120 for r in got.values())


def test_blocks_against_brute_force():
    """Edited copies of a few passages and unlike windows: each window meets every class that it shares a passage with."""
    rng = np.random.default_rng(43)
    base = rng.integers(0, 1 << 31, (3, 2 * passages.NEAR + 1)).astype(np.int32)
    rows = []
    for k in range(60):
        s = base[k % 3].copy()
        for p in rng.choice(len(s), k // 6, replace=False):
            if abs(int(p) - passages.NEAR) > 3:
                s[p : p + 5] = rng.integers(0, 1 << 31, len(s[p : p + 5]))
        rows.append({"id": k, "c": 500, "back": passages.NEAR, "ahead": passages.NEAR, "class": k % 12, "covered": k % 5 == 0, "s": s.tolist()})
    kind = pa.struct([("id", pa.int64()), ("c", pa.int32()), ("back", pa.int32()), ("ahead", pa.int32()), ("class", pa.int64()), ("covered", pa.bool_()), ("s", pa.list_(pa.int32()))])
    block = passages.Block(pa.array(rows, kind))
    got = {(i, rows[j]["class"]) for i, j in passages.compared(block, block)}
    want, at = set(), passages.NEAR
    for i, a in enumerate(rows):
        for b in rows:
            may = b["covered"] and a["class"] != b["class"] if a["covered"] else a["id"] != b["id"]
            if may and passages.verified(np.array(a["s"]), np.array(b["s"]), np.array([[0, at, 2 * at] * 2])):
                want.add((i, b["class"]))
    assert len(want) > 100 and got == want


def test_windows_of_equal_reach_are_looked_at_once(monkeypatch):
    """Windows of several functions reach equally far on one diagonal: a pair that fails does so once, not a time each."""
    rng = np.random.default_rng(47)
    a = rng.integers(-(1 << 31), 1 << 31, 200)
    b = a.copy()
    b[::3] = rng.integers(-(1 << 31), 1 << 31, len(b[::3]))  # enough shingles in common, but no passage
    b[100:160] = np.roll(b[100:160], 1)
    looks, chain = [], passages.longest_chain
    monkeypatch.setattr(passages, "longest_chain", lambda *x: looks.append(1) or chain(*x))
    windows = np.array([[0, c, 199] * 2 for c in range(20, 180)])
    assert passages.verified(a, b, windows) == []
    assert len(looks) == 1


def test_pairs_together_as_one_by_one(monkeypatch):
    """Pairs that are prepared together, in slices of any size, give the spans of each pair alone; each holds the similarity."""
    rng = np.random.default_rng(53)
    pairs = []
    for k in range(40):
        a = rng.integers(-(1 << 31), 1 << 31, int(rng.integers(1, 300)))
        if k % 4 == 1:  # a line that comes back
            a[: len(a) // 2] = np.resize(a[:7], len(a) // 2)
        b = np.array(edited(rng, a.tolist(), 1 + k % 3, "delete")) if len(a) > 30 else a.copy()
        places = np.intersect1d(rng.integers(0, len(b), 6), np.arange(len(a)))
        pairs.append((a, b, np.array([[0, c, len(a) - 1, 0, c, len(b) - 1] for c in places.tolist()], np.int64).reshape(-1, 6)))
    a, b, windows = (np.concatenate([p[k] for p in pairs]) for k in range(3))
    at, to, bounds = (np.cumsum([0, *(len(p[k]) for p in pairs)]) for k in range(3))
    want = [(k, *found) for k, p in enumerate(pairs) for found in passages.verified(*p)]
    assert len({k for k, *_ in want}) > 20
    for k, p, q, u, v in want:
        x, y = set(pairs[k][0][p:q].tolist()), set(pairs[k][1][u:v].tolist())
        assert 100 * len(x & y) >= 80 * len(x | y) and min(q - p, v - u) >= passages.LEAST
    for together in (1, 500, 1 << 18):
        monkeypatch.setattr(passages, "TOGETHER", together)
        assert list(passages.verified_pairs(a, at, b, to, windows, bounds)) == want


def test_texts_of_copies(spark, monkeypatch):
    """Digests of odd texts; words are counted of the copies' texts, not of all documents to compare the count."""
    texts = ["", "AbC é É", "abc é É", "İ ÀZ", "x" * 300_000, "漢字 😀"]
    got = {r["id"]: bytes(r["d"]).hex() for r in passages._digests(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == {k: hashlib.sha256(lower(t).encode()).hexdigest() for k, t in enumerate(texts)}
    plans, stored = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, *x: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, *x))
    text = prose(np.random.default_rng(59), 60)
    rows = [(1, text), (2, text.upper()), (3, text), (4, "Too Short"), (5, "too short"), (6, "alone " + text[:40])]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"], r["n_words"], r["partner"], r["class"]) for r in found) == [(1, 60, 2, 1), (2, 60, 1, 1), (3, 60, 1, 1)]
    lines = [x for plan in plans for x in plan.split("\n") if "split(" in x]
    assert lines and not [x for x in lines if "Filter" in x]


# 5 ---------------------------------------------------------------------------------------------------------------


def test_fuse_filter():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = fuse.build(keys)
        assert fuse.contains(f, keys).all()
        others = rng.integers(1 << 63, 1 << 64, 20_000, dtype=np.uint64)
        assert fuse.contains(f, others).mean() < 0.012


def test_exact_groups(spark, odd):
    rows = [(r["doc_id"], lower(r["text"])) for r in odd.collect()]
    for digest in (exact.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary")):
        late = exact.second_half("doc_id")
        for batches, how in (([odd], {}), ([odd.where("doc_id % 2 = 0"), odd.where("doc_id % 2 = 1 or doc_id is null"), odd.limit(0)], {}), ([odd], {"late": late}), ([odd], {"late": ~F.col("doc_id").eqNullSafe(7)})):
            got = exact.exact_groups(batches, digest=digest, **how).collect()
            want = []
            for i, t in rows:
                ids = [j for j, u in rows if u == t]
                keep = max((j for j in ids if j is not None), default=None)
                want.append((i, keep, len(ids), i == keep))
            assert sorted(map(str, [(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got])) == sorted(map(str, want))
    assert exact.keep_one(odd).columns == odd.columns


# 6 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0}, "tempered"])
def test_packing(spark, odd, targets):
    extra = [(500 + k, prose(np.random.default_rng(k), 400), "en", "abc"[k % 3]) for k in range(60)]
    df = odd.unionByName(docs_of(spark, extra))
    temper = 0.7 if targets == "tempered" else None
    targets = None if temper else targets
    p = pack.pack(df, length=512, targets=targets, temper=temper).toPandas()
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    tk = tokens.Encoder().tokenizer
    total = sum(len(tk.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    assert p.length.sum() == total and p.sequence_id.max() == -(-total // 512) - 1
    for s, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() == 512 or s == p.sequence_id.max()
    for i, t in texts:
        if i in (None, 9) or sum(j == i for j, _ in texts) > 1:
            continue
        ids = np.array(tk.encode(t, add_special_tokens=False).ids + [2], "<u4")
        g = p[p.doc_id == i].sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    if temper:  # until a queue ends, every window has each source's target
        sizes = p.groupby("source").length.sum()
        goal = sizes**temper / (sizes**temper).sum()
        last = int((sizes / goal).min() // 512)
        window = p.groupby(["sequence_id", "source"]).length.sum().unstack().fillna(0).cumsum()
        assert last > 3 and (abs(window[:last] - np.outer(np.arange(1, last + 1) * 512, goal)) <= 2.01).all().all()
    elif targets is None:  # every full window has each source's share
        share = p.groupby("source").length.sum() / total
        window = p[p.sequence_id < p.sequence_id.max()].groupby(["sequence_id", "source"]).length.sum().unstack().fillna(0).cumsum()
        want = np.outer(np.arange(1, len(window) + 1), share * 512)
        assert (abs(window - want) <= 1.01).all().all()
    assert pack.pack(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("targets", [None, {"s007": 3.0, "s123": 1.0, "s299": 2.0}])
def test_packing_many_sources(spark, targets):
    """More than 256 sources: each keeps its own share of every window, and the targets are those of their sources."""
    rng = np.random.default_rng(12)
    df = docs_of(spark, [(k, prose(rng, 30 + k % 7), "en", f"s{k % 300:03}") for k in range(600)])
    p = pack.pack(df, length=512, targets=targets).toPandas()
    sizes = p.groupby("source").length.sum()
    assert len(sizes) == 300 and (p.groupby("doc_id").length.sum() == p.groupby("doc_id").doc_tokens.first()).all()
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    got = p.groupby(["sequence_id", "source"]).length.sum().unstack().fillna(0).cumsum()
    if targets is None:
        want = np.minimum(np.outer(np.arange(1, len(got) + 1) * 512, sizes / sizes.sum()), sizes.to_numpy())
        assert (abs(got - want) <= 1.01).all().all()
        return
    # with w = target, or size times the sum of targets by the targets' size, all are served in proportion till one ends
    weight = sizes * 6.0 / sizes[list(targets)].sum()
    weight.update({k: float(v) for k, v in targets.items()})
    active = sizes / weight
    first = active.min() * weight.sum()
    for k in range(int(first // 512)):
        assert (abs(got.iloc[k] - (k + 1) * 512 * weight / weight.sum()) <= 2.01).all()
    assert len(pack.Schedule(sizes.tolist(), weight.tolist()).x) <= len(targets) + 3


def test_schedule_large_totals():
    s = pack.Schedule([10**12, 3 * 10**12, 7])
    w = np.array([0, 1, 10**6, s.total // 4096])
    assert sum(s.got(q, w, 4096) for q in range(3)).tolist() == np.minimum(w * 4096, s.total).tolist()
    assert s.got(2, np.array([-(-s.total // 4096)]), 4096).tolist() == [7]


# 7 ---------------------------------------------------------------------------------------------------------------


def test_media_round_trip_and_carving(spark, odd):
    payload = b"hello" + b" " * 187
    for kind in ("png", "bmp", "pgm", "wav"):
        m = media.as_media(payload, kind)
        assert media.carve(m) == [(0, len(m), kind)] and media.samples(m, kind) == payload
        assert media.carve(m[:-1]) == []
        assert [x[2] for x in media.carve(b"BM junk RIFF" + m + b"GIF89a" + m)] == [kind, kind]
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04ab123\xff\0\xff\xd9"
    au = b".snd" + b"".join(x.to_bytes(4, "big") for x in (24, 8, 2, 8000, 1)) + b"12345678"
    assert [x[1:] for x in media.carve(b"?" + gif + jpeg + au)] == [(len(gif), "gif"), (len(jpeg), "jpeg"), (len(au), "au")]
    df = spark.createDataFrame([(1, gif, "png"), (2, b"", "png"), (3, None, None), (4, b"x" + gif, "gif")], "id int, media binary, declared string")
    got = {r["id"]: r for r in media.sniff(df, keep=("id",)).collect()}
    assert (got[1]["type"], got[1]["corrected"]) == ("gif", True) and got[2]["type"] is None and got[3]["media"] == []
    assert got[4]["type"] is None and got[4]["media"][0]["offset"] == 1
    texts = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=str)
    out = sorted(media.features(media.stored_media(odd)).collect(), key=lambda r: str((r["doc_id"], r["n_bytes"])))
    want = []
    for i, t in texts:
        raw = t.encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r[:5])) for r in out)
    assert media.features(media.stored_media(docs_of(spark, []))).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    rng = np.random.default_rng(6)
    nodes, children = {}, {}
    for k in range(120):
        parent = None if k % 40 == 0 else int(rng.integers(k // 40 * 40, k))
        nodes[k] = (parent, float(rng.integers(0, 9)))
        children.setdefault(parent, []).append(k)

    def path(n):
        out = []
        while n is not None:
            out.append(n)
            n = nodes[n][0]
        return out[::-1]

    rows = [(f"{k:03}", None if p is None else f"{p:03}", s) for k, (p, s) in nodes.items()]
    rows += [("x1", "x2", 1.0), ("x2", "x1", 1.0), ("x3", "x1", 1.0), ("lost", "nowhere", 1.0)]  # a cycle, and a missing parent
    df = spark.createDataFrame(rows, "node string, parent string, score double")
    got = {}
    for r in chat.best_paths(df, 2).collect():
        got.setdefault(r["leaf"], []).append((r["place"], r["node"]))
    want = {"lost": ["lost"]}
    for root in (0, 40, 80):
        leaves = [k for k in nodes if k not in children and path(k)[0] == root]
        leaves.sort(key=lambda k: (-sum(nodes[x][1] for x in path(k)) / len(path(k)), -k))
        want |= {f"{k:03}": [f"{x:03}" for x in path(k)] for k in leaves[:2]}
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == want


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nx", "&lt;&amp;#91; [", "", None, "é😀\n\n", "<", "|>"]
    turns = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)] + [(2, 0, "odd\nrole", "t"), (2, 0, None, "same turn"), (None, 5, "assistant", "no id")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, place int")
    out = {r["leaf"].split(":")[0]: r for r in chat.parsed(chat.reply_trees(chat.conversation_nodes(df))).collect()}
    assert [(t["role"], t["text"]) for t in out["1"]["turns"]] == [(r, t or "") for _, _, r, t in turns[:8]]
    assert out["1"]["masked"] == "".join(t or "" for _, _, r, t in turns[:8] if r == "assistant")
    assert [(t["role"], t["text"]) for t in out["2"]["turns"]] == [("", "same turn"), ("odd\nrole", "t")] and out[""]["masked"] == "no id"
    assert "[INST]" not in out["1"]["formatted"] and "</s>" not in out["1"]["formatted"] and out["1"]["formatted"].count("<|im_end|>") == 8
    assert chat.reply_trees(chat.conversation_nodes(df.limit(0))).count() == 0


# 9, 10 -----------------------------------------------------------------------------------------------------------


def test_language_id(spark, odd):
    got = {(r["doc_id"]): r for r in langid.op10_language_id(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.97
    assert all(got[k]["held_out"] == (k in held) for k in truth)
    model = langid.fit(odd)
    out = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[10]["lang_pred"] == "und" and out[1]["rejected"]
    assert out[9]["lang_pred"] in model.languages
    empty = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.keep_known(odd).columns == odd.columns and langid.predict(odd.limit(0), model).count() == 0


def test_quality(spark, odd):
    got = {r["doc_id"]: r for r in knn.op9_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k]["predicted"] == labels[k] for k in held]) > 0.9
    marks = spark.createDataFrame([(20, 1), (20, 0), (21, 0), (21, 0), (22, 1), (None, 1), (23, None), (999, 1)], "doc_id long, quality int")
    model = knn.fit(odd, marks, "quality")
    assert sorted(model["labels"].tolist()) == [0, 1, 1]
    out = knn.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out if r["doc_id"] in (1, 2)} == {round(2 / 3, 6)}
    none = knn.fit(odd, marks.limit(0), "quality")
    assert {r["score"] for r in knn.score(odd, none).collect()} == {0.5}


def test_vote_is_exact():
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = (rng.random(300) < 0.6).astype(np.float32)
    z = v[:40] + 0.01
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    got = knn.vote(z, {"vectors": v.T.copy(), "labels": labels}, 15)
    for q, s in zip(z, got):
        cos = v @ q
        top = np.argsort(-cos)[:15]
        w = np.clip(cos[top], 0, 1).astype(float) ** 6 + 1e-9
        assert abs((w * labels[top]).sum() / w.sum() - s) < 1e-5


# pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        path = table_path(spark, name)
        out.write.parquet(path)
        before[name], docs = docs, spark.read.parquet(path)
        kept, had = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in before[name].collect()}
        assert kept.items() <= had.items()
        if name == "language":
            assert len(kept) >= 0.97 * len(had)
        if name == "exact_dedup":
            keep = {}
            for k, t in had.items():
                keep[lower(t)] = max(k, keep.get(lower(t), -1))
            assert set(kept) == set(keep.values())
        if name == "near_dedup":
            assert set(kept) == set(brute_components(shingle_sets(had.items(), 5), 80).values())
        if name == "mix":
            assert len(kept) > 0.5 * len(had)
    p = P.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(p.doc_id) == set(kept)
    assert P.run(spark, SF).count() == len(p)
