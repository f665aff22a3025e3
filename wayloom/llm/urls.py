"""Operator 13: URL filters by host word segmentation and naive Bayes, with rules before them.

Host and path are cut into runs of letters and of digits. Each distinct run of letters is split into words by Viterbi decoding under a
unigram model: words counted over all given texts, a lexicon whose words have a least frequency, and, for unknown words, a
probability that falls by ten with each letter. Only words that occur in a run matter, so the counts are cut by a semi join
with the runs' substrings; there is no dictionary of fixed size. A multinomial naive Bayes model then adds, for each word in host or
path, the log ratio of its probabilities in blocked and allowed URLs. Class probabilities are smoothed towards the word's
share of all words (``MU`` pseudo-words), so that a word seen once says little and one not seen in the small class isn't evidence for it.
Labels are weak: a host is a blocked one for training if one of its words is a seed; all URLs are counted.

Words and scores are kept by distinct run, counts by host, so a host with a third of all rows is one row where it matters. URLs
meet the runs' scores in one join (broadcast if these are counted and few) and are summed by a row number.

A rule is ``host/path``: it fits its host and all subdomains, if the path starts with the rule's. The longest one wins (of equal
ones the blocking one) and decides before the model. Rules are a list of the caller's, looked up by the host's last labels.

Results for odd input: a null URL, or one without ``://``, has an empty host and path and is judged by the prior alone; a null
text has no words; other columns are ignored, whatever their names; equal URLs have equal verdicts, and repeated rows or ids a row
each; very long URLs are cut into runs as any, words of at most ``LONGEST`` letters are looked up; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import MAX_BROADCAST_KEYS, UPPER, drop, keep, restrict, scratch, stored, tidy

#: Letters of a word, at most.
LONGEST = 20
#: Frequency that a word of the lexicon has at least.
LEXICON_SHARE = 1e-6
#: Pseudo-words of each class.
MU = 50.0

#: Words that mark a host as blocked when labels for training are made.
SEEDS = (
    "ads", "adserver", "adult", "bet", "bets", "betting", "bingo", "casino", "cialis", "clickbait", "doorway", "escort", "escorts",
    "gamble", "gambling", "hentai", "jackpot", "linkfarm", "loan", "loans", "lottery", "malware", "nude", "payday", "phishing", "pill",
    "pills", "poker", "popunder", "porn", "roulette", "sex", "slots", "spam", "spyware", "torrent", "tracker", "tracking", "viagra", "warez", "xxx",
)
#: Common words of host names, for segmentation only.
COMMON = (
    "best", "blog", "book", "buy", "card", "cheap", "city", "click", "cloud", "credit", "data", "deal", "deals", "farm", "free", "game", "games",
    "health", "home", "hot", "live", "mail", "market", "media", "money", "news", "now", "online", "shop", "site", "sport", "store", "time", "top",
    "track", "travel", "video", "web", "win", "work", "world", "your",
)

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(size, verdict, rule) of the longest rule that fits, or null."""
    by: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        by.setdefault(name, []).append(("/" + rest, verdict, rule))
    if not by:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    entry = lambda p, v, r: F.struct(F.lit(len(r)).alias("size"), F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(p).alias("path"))
    table = F.create_map(*(x for name, own in by.items() for x in (F.lit(name), F.array(*(entry(*e) for e in own)))))
    labels = F.split(host_, r"\.")
    deepest = max(name.count(".") + 1 for name in by)
    names = F.transform(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(labels))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    known = F.filter(F.transform(names, lambda n: F.try_element_at(table, n)), lambda x: x.isNotNull())
    fit = F.filter(F.flatten(known), lambda x: F.startswith(path_, x.path))
    return F.array_max(F.transform(fit, lambda x: F.struct(x.size.alias("size"), x.verdict.alias("verdict"), x.rule.alias("rule"))))


def runs(text: Column) -> Column:
    """Runs of letters, lower-cased; a run of digits is ``0``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), 1)
    return F.transform(found, lambda x: F.when(x.rlike(r"^\p{N}"), F.lit("0")).otherwise(x))


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over the visible words of all texts (markup or plain), of ``LONGEST`` letters at most."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = texts.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def _few(df: DataFrame) -> DataFrame:
    """``df`` (stored), broadcast if it is counted and small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS else df


def best_words(run: str, counts: dict[str, float], total: float) -> list[str]:
    """The most probable words of a run: log counts of known words, ``total`` the log of all. Of equal splits the one with longer first words."""
    unknown = math.log(10.0) - total
    score, back = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):  # score[i]: of the best split of run[i:]
        best = None
        for j in range(min(len(run), i + LONGEST), i, -1):
            n = counts.get(run[i:j])
            s = score[j] + (n - total if n is not None else unknown - (j - i) * math.log(10.0))
            if best is None or s > best:
                best, back[i] = s, j
        score[i] = best
    words, i = [], 0
    while i < len(run):
        words.append(run[i : back[i]])
        i = back[i]
    return words


def segmented(found: DataFrame, counts: DataFrame, lexicon: tuple[str, ...] = SEEDS + COMMON) -> DataFrame:
    """(run, words) of distinct runs under the counts (word, n)."""
    spark = found.sparkSession
    starts = found.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    longest = F.least(F.lit(LONGEST), F.length("run") - F.col("i") + 1)
    parts = stored(starts.select("run", F.explode(F.transform(F.sequence(F.lit(1), longest), lambda k: F.substr("run", F.col("i"), k))).alias("word")).distinct(), "parts")
    all_words = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1.0, all_words * LEXICON_SHARE)
    known = restrict(counts, stored(parts.select("word").distinct(), "keys"), "word")
    extra = spark.createDataFrame([(w, least) for w in sorted(set(lexicon))], "word string, n double")
    known = stored(known.select("word", F.col("n").cast("double").alias("n")).unionByName(extra).groupBy("word").agg(F.max("n").alias("n")), "known")
    given = parts.join(_few(known), "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = math.log(max(all_words, 1) + least * len(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for text, entries in zip(b.column("run").to_pylist(), b.column("known").to_pylist()):
                words.append(best_words(text, {e["word"]: math.log(e["n"]) for e in entries or ()}, total))
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return stored(found.join(given, "run", "left").mapInArrow(tidy(run), "run string, words array<string>"), "segmented")


def fit(urls: DataFrame, split: DataFrame, seeds: tuple[str, ...] = SEEDS) -> tuple[DataFrame, float]:
    """(kind, run, score) for each run in hosts (h) or paths (p), and the prior's log odds of blocking, from all ``urls`` (host, path)."""
    hosts = stored(urls.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    in_hosts = hosts.select("host", "n", F.explode(runs(F.col("host"))).alias("run"))
    bad_runs = split.where(F.arrays_overlap("words", F.array(*map(F.lit, seeds)))).select("run", F.lit(1).alias("bad"))
    labels = in_hosts.join(bad_runs, "run").select("host").distinct().withColumn("bad", F.lit(1))
    labels = stored(hosts.select("host", "n").join(labels, "host", "left").select("host", "n", F.coalesce("bad", F.lit(0)).alias("bad")), "labels")
    in_paths = urls.select("host", F.explode(runs(F.col("path"))).alias("run")).groupBy("host", "run").agg(F.count("*").alias("n"))
    seen = in_hosts.select("host", F.lit("h").alias("kind"), "run", "n").unionByName(in_paths.select("host", F.lit("p").alias("kind"), "run", "n"))
    by_run = seen.join(_few(labels.select("host", "bad")), "host").groupBy("kind", "run").agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum("n").alias("n"))
    by_run = stored(by_run.join(split, "run"), "by_run")
    by_word = stored(by_run.select("kind", F.explode("words").alias("word"), "bad", "n").groupBy("kind", "word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "by_word")
    bad, all_ = by_word.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pages_bad, pages = labels.agg(F.coalesce(F.sum(F.col("bad") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = MU * F.col("n") / F.lit(float(max(all_, 1)))
    ratio = F.log((F.col("bad") + share) / F.lit(bad + MU)) - F.log((F.col("n") - F.col("bad") + share) / F.lit(all_ - bad + MU))
    words = by_word.select("kind", "word", ratio.alias("ratio"))
    scores = by_run.select("kind", "run", F.explode("words").alias("word")).join(words, ["kind", "word"]).groupBy("kind", "run").agg(F.sum("ratio").alias("score"))
    return stored(scores, "scores"), math.log((pages_bad + 1) / (pages - pages_bad + 1))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, lexicon: tuple[str, ...] = COMMON) -> DataFrame:
    """(id, host, path, rule, verdict, log_odds of blocking by the model) for each row."""
    url = F.col(url_col)
    with scratch(pages.sparkSession):
        urls = stored(pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
        both = urls.select("row", F.explode(F.concat(F.transform(runs(F.col("host")), lambda r: F.struct(F.lit("h").alias("kind"), r.alias("run"))), F.transform(runs(F.col("path")), lambda r: F.struct(F.lit("p").alias("kind"), r.alias("run"))))).alias("x")).select("row", "x.kind", "x.run")
        counts = stored(word_counts(pages, text_col), "counts")
        split = segmented(stored(both.select("run").distinct(), "runs"), counts, seeds + lexicon)
        scores, prior = fit(urls, split, seeds)
        sums = both.join(_few(scores), ["kind", "run"]).groupBy("row").agg(F.sum("score").alias("score"))
        out = urls.join(sums, "row", "left").withColumn("log_odds", F.coalesce("score", F.lit(0.0)) + F.lit(prior))
        out = out.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
        verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
        return keep(stored(out.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.round("log_odds", 6).alias("log_odds")), "judged"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL; words are counted over all pages' texts."""
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumnRenamed("id", "page_id")
