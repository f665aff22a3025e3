"""Merkle manifests, fill-in-middle and URL filters on odd rows and against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from wayloom.llm import infill, merkle, urls


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return text and re.sub("[A-Z]", lambda m: m[0].lower(), text)


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    for nodes in tree[:-1]:
        a = i // 8 * 8
        yield i - a, "".join(nodes[a:i] + nodes[i + 1 : a + 8])
        i //= 8


def manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): what op11 returns."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
    trees = {g: levels([x[2] for x in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, (known, _, mine, r) in enumerate(groups[g]):
            steps = [*way(trees[g], i), *way(top, k)]
            node = leaf(r, lower(r[4])) if known and zlib.crc32(str(r[0]).encode()) % 3 == 0 else mine
            for at, siblings in steps:
                node = sha(siblings[: 64 * at] + node + siblings[64 * at :])
            yield r[0], mine, trees[g][-1][0], top[-1][0], sha("".join(s for _, s in steps)), node, node == top[-1][0]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def odd_documents():
    rng = random.Random(4)
    rows = [(None, "a", "en", 1, "No id"), (None, None, None, None, None), (7, "a", "en", 3, ""), (7, "a", "en", 3, ""), (7, "a", "en", 3, "Other"), (8, "ß", "é", -2, "Ünï 😀"), (9, "a", "", 0, "A" * 100_000)]
    rows += [(k, "s", rng.choice(["en", "en", "de", None]), k, f"Text {k}") for k in range(rng.randrange(700, 720))]
    return rows + [(5000, "s", "en", 1, "Same")] * 400


@pytest.mark.parametrize("size", [40, 50_000])
def test_manifest_of_odd_rows(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(merkle, "ROWS", size)
    rows = odd_documents()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).select(*COLUMNS).collect()
    want = collections.Counter(manifest(rows))
    assert collections.Counter(map(tuple, got)) == want
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_manifest_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 30)
    rows = [(k % 97, k, sha(str(k))) for k in range(600)] + [(200, k, sha(str(k))) for k in range(1, 9)]
    out = merkle.manifest(spark.createDataFrame(rows, "g int, k int, leaf string").withColumn("extra", F.lit("e")))
    bad = out.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root"))
    assert out.count() == 608 and bad.isEmpty() and out.select("root").distinct().count() == 1
    assert merkle.manifest(spark.createDataFrame([], "g int, k int, leaf string, extra string")).isEmpty()
    one = merkle.manifest(spark.createDataFrame([(1, 1, "ab", None)], "g int, k int, leaf string, extra string")).collect()[0]
    assert one["root"] == one["subroot"] == "ab" and one["proof"] == []


def test_spans_of_random_partitions():
    rng = random.Random(2)
    for _ in range(200):
        groups = sorted(rng.randrange(6) for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.randrange(len(groups) + 1) for _ in range(5))
        parts = [groups[a:b] for a, b in zip([0, *cuts], [*cuts, len(groups)])]
        found = merkle.spans([next(merkle.edges(iter([(g,) for g in p]))) for p in parts])
        names, at = sorted(set(groups)), 0
        for p, s in zip(parts, found):
            assert (s is None) == (not p)
            if p:
                assert s == (names.index(p[0]), names.index(p[-1]), at - groups.index(p[0]), groups.count(p[0]), groups.count(p[-1]), len(names))
            at += len(p)


def test_ropes():
    rng = random.Random(1)
    word = re.compile(r"\S+\s*")
    for size in (1, 3, 2048):
        infill.LEAF, kept = size, infill.LEAF
        try:
            for n in (0, 1, 2, 7, 100, 500):
                text = "".join(rng.choice("ab é😀\n") for _ in range(n))
                r = infill.rope(text)
                assert infill.written(r) == text and r.units == r.chars == n
                for k in (0, 1, n // 3, n):
                    a, b = infill.split(r, k)
                    assert (infill.written(a), infill.written(b)) == (text[:k], text[k:])
                    both = infill.join(b, a)
                    assert infill.written(both) == text[k:] + text[:k] and both.height <= 2 * math.log2(max(2, n)) + 3
                units = [m[0] for m in word.finditer(text)]
                w = infill.rope(text, word)
                assert w.units == len(units) and w.chars == n
                if units:
                    head = text[: len(text) - len("".join(units))]
                    k = len(units) // 2
                    a, b = infill.split(w, k)
                    assert infill.written(a) + infill.written(b) == text and (not k or infill.written(a) == head + "".join(units[:k]))
        finally:
            infill.LEAF = kept


def test_fill_in_middle_of_odd_rows(spark):
    texts = [None, "", "a", "one <S> two", "<P", "P>" * 50, "<" * 99 + "M>", "é😀漢" * 9000, " \n", "<S>"]
    rows = [(k, t, "x", 1) for k in range(60) for t in texts] + [(None, "no id here", "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    for unit in (None, r"\w+\W*"):
        out = infill.fill_in_middle(df, unit=unit, restore=True).collect()
        assert sorted((str(r["id"]), r["text"]) for r in out) == sorted((str(k), t or "") for k, t, *_ in rows)
        assert {r["form"] for r in out} == {"plain", "psm", "spm"}
        for r in out:
            if any(s in r["text"] for s in ("<P>", "<S>", "<M>")) or not r["n"]:
                assert r["form"] == "plain" and r["output"] == r["text"] and r["prefix_chars"] is None
            elif r["form"] != "plain":
                t, p, m = r["text"], r["prefix_chars"], r["middle_chars"]
                one, two, three = t[:p], t[p : p + m], t[p + m :]
                assert r["output"] == (f"<P>{one}<S>{three}<M>{two}" if r["form"] == "psm" else f"<S>{three}<P>{one}<M>{two}")
    assert infill.fill_in_middle(df.limit(0)).isEmpty()


def splits(run):
    for cuts in itertools.product((False, True), repeat=max(0, len(run) - 1)):
        words, at = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                words.append(run[at:k])
                at = k
        yield [*words, run[at:]]


def test_best_words_are_best():
    rng = random.Random(3)
    for _ in range(60):
        run = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): math.log(rng.randrange(1, 900)) for _ in range(12)}
        total = math.log(5000)
        value = lambda ws: sum(counts[w] - total if w in counts else math.log(10) - total - len(w) * math.log(10) for w in ws)
        assert abs(value(urls.best_words(run, counts, total)) - max(map(value, splits(run)))) < 1e-9


URLS = [
    "https://www.freebets.example.com/en/12", "http://cheap-pills.example.org/de/7.html", "https://blog.thestone.example.com/en/5?x=://y", "HTTPS://M.TheStone.Example.COM/en/9#top", "http://stone.example.net/fr/1",
    "http://stone.example.net/en/1", "http://a.b.org/fr/", "http://a.b.org/fr", "http://net", "http://net/", "no scheme", "", None, "://", "http://host?q=/net/", "http://x.example.com/de/" + "longpath" * 900, "https://onlinecasino.example.com/the/stone", "ftp://user@x.net:80/en/",
]
HTML = "<p>the stone blog <b>the</b> free<script>var pills</script> online casino"


def plain_judgement(rows):
    """(host, path, rule, verdict) of (url, html), by loops over everything."""
    parts, counts = [], collections.Counter()
    for url, html in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        parts.append((lower(m[1]), m[2]) if m else ("", ""))
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", html or "")
        counts.update(w for w in re.findall(r"[^\W\d_]+", plain.lower()) if len(w) <= urls.LONGEST)
    lexicon = set(urls.SEEDS + urls.COMMON)
    least = max(1.0, sum(counts.values()) * urls.LEXICON_SHARE)
    total = math.log(max(sum(counts.values()), 1) + least * len(urls.SEEDS + urls.COMMON))
    logs = {w: math.log(max(counts.get(w, 0), least if w in lexicon else 0)) for w in {*counts, *lexicon}}
    words = lambda text: [w for r in re.findall(r"[^\W\d_]+|\d+", text.lower()) for w in (["0"] if r.isdigit() else urls.best_words(r, logs, total))]
    bad_hosts = {h for h, _ in parts if set(words(h)) & set(urls.SEEDS)}
    seen = {False: collections.Counter(), True: collections.Counter()}
    for h, p in parts:
        seen[h in bad_hosts].update([("h", w) for w in words(h)] + [("p", w) for w in words(p)])
    every, pages_bad = seen[True] + seen[False], sum(h in bad_hosts for h, _ in parts)
    n = {c: sum(seen[c].values()) for c in seen}
    out = []
    for h, p in parts:
        odds = math.log((pages_bad + 1) / (len(parts) - pages_bad + 1))
        for w in [("h", w) for w in words(h)] + [("p", w) for w in words(p)]:
            share = urls.MU * every[w] / sum(every.values())
            odds += math.log((seen[True][w] + share) / (n[True] + urls.MU)) - math.log((seen[False][w] + share) / (n[False] + urls.MU))
        fits = [(len(r), v, r) for v, r in urls.RULES if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
        best = max(fits, default=None)
        out.append((h, p, best and best[2], best[1] if best else "block" if odds > 0 else "allow", round(odds, 3)))
    return out


def test_urls_against_loops(spark):
    rows = [(u, HTML if k % 3 else None) for k, u in enumerate(URLS * 3)]
    df = spark.createDataFrame([(k % 20 or None, u, h, "x", 1) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, run int")
    got = collections.Counter((r["host"], r["path"], r["rule"], r["verdict"], round(r["log_odds"], 3)) for r in urls.judged(df).collect())
    want = collections.Counter(plain_judgement(rows))
    assert got == want
    verdicts = {(h, p): v for h, p, _, v, _ in want}
    assert verdicts["onlinecasino.example.com", "/the/stone"] == verdicts["www.freebets.example.com", "/en/12"] == "block" and verdicts["user@x.net:80", "/en/"] == "allow"
    assert urls.judged(df.limit(0)).isEmpty()


def test_hosts_with_seeds_are_blocked(spark):
    out = urls.op13_url_filter(spark, SF).where("rule is null").collect()
    for r in out:
        name = r["host"].split(".")[-3]
        assert (r["verdict"] == "block") == bool(set(re.split("-", name)) & set(urls.SEEDS)), r


def test_scopes_and_release(spark):
    import os
    import threading

    from wayloom.llm.common import keep, release, scratch, shared_dir, stored

    root = shared_dir(spark).removeprefix("file://") + "/wayloom"
    there = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = there()
    with scratch(spark):
        with scratch(spark):  # both have stored nothing yet
            pass
        outer = keep(stored(spark.range(5), "outer"))
        with scratch(spark):
            stored(spark.range(3), "inner")
            handed = keep(stored(spark.range(4), "handed"))
        assert handed.count() == 4 and len(there() - before) == 2
    assert outer.count() == 5 and len(there() - before) == 1
    release(outer)
    assert there() == before

    def other():
        with scratch(spark):
            stored(spark.range(2), "other")

    with scratch(spark):
        mine = stored(spark.range(7), "mine")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert mine.count() == 7
    assert there() == before


def test_every_passage_is_near_the_span_it_names(spark):
    """Overlapping near copies of a passage, shared lines and exact copies: each row's own span and its partner's reach the similarity."""
    import numpy as np

    from wayloom.llm import passages

    rng = np.random.default_rng(21)
    prose = lambda n: [f"w{k}" for k in rng.integers(0, 9000, n)]
    base, line = prose(120), "this line stands in every document of the group".split()
    rows = []
    for k in range(24):
        own = list(base[(k % 4) * 10 : 80 + (k % 5) * 10])
        for at in rng.choice(len(own), k % 4, replace=False):
            own[at] = f"edit{k}x{at}"
        rows.append((k, " ".join([*prose(40 + k), *line, *own, *(line if k % 3 else []), *prose(50)])))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper())]
    text = {k: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for k, t in rows}
    sets = lambda k, a, n: {tuple(text[k][i : i + 5]) for i in range(a, a + n - 4)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"] for r in got} >= {*range(0, 24, 4), 3, 100, 101}  # unedited passages and copies
    for r in got:
        x, y = sets(r["id"], r["start_word"], r["n_words"]), sets(r["partner"], r["partner_start"], r["partner_words"])
        assert len(x & y) * 100 >= len(x | y) * 80 and min(r["n_words"], r["partner_words"]) >= 50
        assert r["extent_start"] <= r["start_word"] and r["start_word"] + r["n_words"] <= r["extent_start"] + r["extent_words"] <= len(text[r["id"]])
