"""Operator 1: n-gram Jaccard join as a blocked sparse product of the document-by-n-gram incidence matrix.

The product's entries are overlap counts. Columns are dealt out in blocks (the shuffle partitions of the n-gram), each
block adds its share of every pair's overlap, and pairs are discarded by bounds that follow from the set
sizes. A link of sizes n and m needs an overlap of o = ceil(t (n + m) / (1 + t)). n-grams are ordered from rare to
frequent (``shingles``), and the first e common ones of a linked pair stand before place n - o + e of the one set and
m - o + e of the other (else fewer than o could be common). So a column counts for a pair only where both places are
within these bounds, and a pair goes on only if e columns count, e growing with the smaller size.

Rows with equal sets are one row of the matrix. Each column is multiplied with one of its rows first, that which shares
the largest part of its columns (in a group of near copies the one that was edited least), then the rows in other
components with one of themselves. What this links is one component. The rest, pairs of *different* components, is
multiplied by (column, band of the smaller size): a row stands in its own band as the smaller one and in the
bands of its possible partners as the larger one, cut at the bound of that band. Rows that share fewer than e such
columns with rows of other components go before any pair is made: a copy with many words of its own has these
first, so within its own band it has no column left. Of the rest the whole sets are looked at: rows that share less than
t of their n-grams with all others together (they have a passage in common, not the text) go too, then those that share less than a
partner of their band asks for with all its rows of other components together, again as long as this takes many. What is left of a
column is still compared with itself, but a pair that shares one of its first columns comes out once, where it first meets, and not once a column.
A group of near copies of one row costs about its size; what these bounds leave in a column costs its square in comparisons.
No link between components is lost.

Results for odd input: a null or empty text, or one without words, has an empty set and links with nothing; rows
with a null id link with nothing and have a null component; rows that repeat an id are one node of the graph,
with the size of each row's own set; a very long text is a row like others, hashed as a whole; an empty table gives no
rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from .common import drop, joined_components, keep, restrict, scratch, stored
from .shingles import EXTRA, frequency_classes, incidence, whole_sets


#: First columns of a row that tell where a pair is made.
FIRST = 12


def shared_least(n: Column) -> Column:
    """Prefix columns that a link of two sets shares at least, ``n`` being the smaller size."""
    return 1 + F.floor(n / EXTRA)


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / (100 + percent))


def _counts(n: Column, i: Column, m: Column, percent: int) -> Column:
    """Whether place i of a set of size n is within the bound for partners of size m."""
    return i < n - _least_overlap(n, m, percent) + shared_least(F.least(n, m))


def _fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _verified(pairs: DataFrame, whole, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets' similarity reaches the threshold. ``whole``: the sets (id, grams) of given ids."""
    ids = stored(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "ids")
    sets = stored(whole(ids), "sets")
    left = sets.select(F.col("id").alias("u"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("grams").alias("y"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("x", "y"))
    linked = common * 100 >= (F.size("x") + F.size("y") - common) * percent
    out = stored(both.where(linked).select("u", "v").distinct(), "linked")
    drop(ids, sets)
    return out


def _star(lists: DataFrame, percent: int) -> DataFrame:
    """(u, v): rows with their columns' most central row, where e columns with that one count."""
    top = F.struct("central", (-F.col("id")).alias("id"), "n", "i")
    leads = lists.groupBy("gram").agg(F.max(top).alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    leads = leads.select("gram", (-F.col("lead.id")).alias("v"), F.col("lead.n").alias("m"), F.col("lead.i").alias("j"))
    n, m = F.col("n"), F.col("m")
    pairs = lists.join(leads, "gram").where((F.col("id") != F.col("v")) & _fits(n, m, percent) & _counts(n, F.col("i"), m, percent) & _counts(m, F.col("j"), n, percent))
    pairs = pairs.groupBy(F.col("id").alias("u"), "v", "n", "m").agg(F.count("*").alias("c")).where(F.col("c") >= shared_least(F.least(n, m)))
    return stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "star")


def _labelled(lists: DataFrame, part: DataFrame) -> DataFrame:
    """The entries of columns of several components, with the row's component and the column's smallest one."""
    own = part.select(F.col("node").alias("id"), F.col("component").alias("own"))
    out = stored(lists.join(own, "id", "left").select("gram", "id", "n", "i", "central", F.coalesce("own", "id").alias("comp")), "labelled")
    mixed = out.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("gram", "low")
    mixed = stored(out.join(mixed, "gram"), "columns")
    drop(out)
    return mixed


def _cross(lists: DataFrame, whole, percent: int) -> DataFrame:
    """(u, v) of different components with enough columns that count."""
    n, i = F.col("n"), F.col("i")
    width = log(100 / percent) / 2
    band = lambda x: F.floor(F.log(x.cast("double")) / width).cast("int")
    least = F.ceil(n * percent / 100)
    small = lists.where(_counts(n, i, n, percent)).select("gram", "id", "n", "i", "comp", F.lit(True).alias("small"), band(n).alias("band"), shared_least(n).alias("e"))
    large = lists.withColumn("band", F.explode(F.sequence(band(F.greatest(least, F.lit(1))), band(n))))
    low = F.greatest(least, F.floor(F.exp(F.col("band") * width) - 1e-6))  # the band's sizes, rounded outwards
    high = F.least(n, F.ceil(F.exp((F.col("band") + 1) * width) + 1e-6))
    large = large.where(i < n - _least_overlap(n, low, percent) + shared_least(high)).select("gram", "id", "n", "i", "comp", F.lit(False).alias("small"), "band", shared_least(F.greatest(low, F.lit(1))).alias("e"))
    rows = stored(small.unionByName(large), "banded")
    side = lambda f, c, s: f(F.when(F.col("small") == s, F.col(c)))
    keys = rows.groupBy("gram", "band").agg(side(F.min, "comp", True).alias("s0"), side(F.max, "comp", True).alias("s1"), side(F.min, "comp", False).alias("l0"), side(F.max, "comp", False).alias("l1"))
    keys = stored(keys.where("(l0 <> s0 or l1 <> s1 or s0 <> s1)"), "keys")  # both sides, several components
    other = F.when(F.col("small"), (F.col("l0") != F.col("comp")) | (F.col("l1") != F.col("comp"))).otherwise((F.col("s0") != F.col("comp")) | (F.col("s1") != F.col("comp")))
    met = stored(rows.join(keys, ["gram", "band"]).where(other).select("gram", "band", "id", "n", "i", "comp", "small", "e"), "met")
    drop(rows, keys)
    enough = met.groupBy("id", "n", "small", "band", "e").agg(F.count("*").alias("c")).where("c >= e").select("id", "n", "small", "band")
    left = stored(met.join(enough, ["id", "n", "small", "band"]), "left")
    drop(met)
    # of these few, whole sets: a row that shares less than the threshold of its own with all others together links with none
    ids = stored(left.groupBy("id").agg(F.min("comp").alias("comp")), "ids")
    grams = stored(whole(ids.select("id")).join(ids, "id").select("id", "comp", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "grams")
    both = grams.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("gram")
    close = grams.join(both, "gram").groupBy("id", "n").agg(F.count("*").alias("c")).where(F.col("c") * 100 >= F.col("n") * percent).select("id").distinct()
    close = stored(close, "close")
    left = stored(restrict(left, close, "id"), "left")
    grams = restrict(grams.select("id", "n", "gram"), close, "id")
    # the same by role and band, with the overlap that partners of the band ask for; again while this takes a twentieth of the roles
    needed = F.when(F.col("small"), _least_overlap(n, n, percent)).otherwise(_least_overlap(n, low, percent))
    roles = stored(left.select("id", "n", "comp", "small", "band").distinct(), "roles")
    count = roles.count()
    while count:
        entries = grams.join(roles, ["id", "n"])
        keys = entries.groupBy("gram", "band").agg(side(F.min, "comp", True).alias("s0"), side(F.max, "comp", True).alias("s1"), side(F.min, "comp", False).alias("l0"), side(F.max, "comp", False).alias("l1"))
        met = entries.join(keys, ["gram", "band"]).where(other).groupBy("id", "n", "comp", "small", "band").agg(F.count("*").alias("c"))
        fewer = stored(met.where(F.col("c") >= needed).drop("c"), "roles")
        drop(roles)
        roles, before, count = fewer, count, fewer.count()
        if count * 20 > before * 19:
            break
    left = stored(left.join(roles.select("id", "n", "small", "band"), ["id", "n", "small", "band"], "left_semi"), "reachable")
    # a pair that shares one of its first columns is made at the first it shares (of these the lowest places, so all that count
    # come after it), and tested on the whole sets; only one that shares none of them is made once a column and counted
    role = ["id", "n", "small", "band"]
    first = left.groupBy(*role).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", "gram"))), lambda x: x.gram), 1, FIRST).alias("first"))
    left = stored(left.join(first, role), "reachable")
    a = left.where("small").select("gram", "band", F.col("id").alias("s"), F.col("n").alias("ns"), F.col("i").alias("si"), F.col("comp").alias("cs"), F.col("first").alias("fs"))
    b = left.where("not small").select("gram", "band", F.col("id").alias("l"), F.col("n").alias("nl"), F.col("i").alias("li"), F.col("comp").alias("cl"), F.col("first").alias("fl"))
    ns, nl, early = F.col("ns"), F.col("nl"), F.arrays_overlap("fs", "fl")
    on = (
        (a["gram"] == b["gram"]) & (a["band"] == b["band"]) & (F.col("cs") != F.col("cl")) & ((ns < nl) | ((ns == nl) & (F.col("s") < F.col("l")))) & _fits(ns, nl, percent)
        & _counts(ns, F.col("si"), nl, percent) & _counts(nl, F.col("li"), ns, percent) & (~early | (F.get(F.array_intersect("fs", "fl"), F.lit(0)) == a["gram"]))
    )
    pairs = a.join(b, on).select("s", "l", "ns", "nl", early.alias("early"))
    pairs = pairs.groupBy("s", "l", "ns", "nl").agg(F.count("*").alias("c"), F.max("early").alias("early")).where(F.col("early") | (F.col("c") >= shared_least(ns)))
    return stored(pairs.select(F.least("s", "l").alias("u"), F.greatest("s", "l").alias("v")).distinct(), "cross")


def similarity_classes(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, part), tables of the open scope: members are (id, n, rep), with equal sets under one representative (the
    smallest id); part is (node, component) of the representatives that link with another."""
    docs = docs.select(id_col, text_col)
    classes = frequency_classes(docs, text_col, k)
    rows = stored(incidence(docs, id_col, text_col, k, percent, classes), "incidence")
    key = ["n", "a", "b"]
    groups = rows.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    many = stored(groups.where("copies > 1").drop("copies"), "equal")
    members = rows.select("id", *key).join(many, key, "left").select("id", *key, F.coalesce("rep", F.when(F.col("n") > 0, F.col("id"))).alias("rep"))
    members = stored(members, "members")
    copies = stored(members.where("rep is not null and id <> rep").select("id", "a", "b").distinct(), "copies")
    entries = restrict(rows.where("n > 0 and id is not null"), copies, ["id", "a", "b"], "left_anti")
    entries = entries.select("id", "n", F.posexplode("grams").alias("i", "gram"))
    shared = stored(entries.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "shared")
    lists = stored(entries.join(shared, "gram").select("gram", "id", "n", "i"), "columns")
    drop(rows, many, copies, shared)
    # rows that share too few columns for any link go; of the others, how much of their prefix is shared
    counts = lists.groupBy("id", "n").agg(F.count("*").alias("c")).where(F.col("c") >= shared_least(F.ceil(F.col("n") * percent / 100)))
    counts = stored(counts.select("id", "n", F.floor(F.col("c") * 1000 / F.col("n")).cast("int").alias("central")), "enough")
    few = stored(lists.join(counts, ["id", "n"]).select("gram", "id", "n", "i", "central"), "columns")
    drop(lists, counts)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = lambda ids: whole_sets(restrict(texts, ids, "id"), "id", "text", k, classes)
    lists, part, tested = few, None, None
    for apart in (F.lit(True), F.col("comp") != F.col("low")):
        star = _star(lists.where(apart), percent)
        new = star if tested is None else stored(star.join(tested, ["u", "v"], "left_anti"), "star")
        part = joined_components(part, _verified(new, whole, percent))
        tested = new if tested is None else tested.unionByName(new)
        lists = _labelled(lists, part)
    cross = stored(_cross(lists, whole, percent).join(tested, ["u", "v"], "left_anti"), "cross")
    if not cross.isEmpty():
        part = joined_components(part, _verified(cross, whole, percent))
    return members, part


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    with scratch(docs.sparkSession):
        members, part = similarity_classes(docs, k, percent, id_col, text_col)
        out = members.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left")
        return keep(stored(out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")), "classes"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents, 4-word shingles, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).withColumnRenamed("id", "doc_id")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those of a larger id than another of their component. Rows with a null id stay."""
    with scratch(docs.sparkSession):
        found = jaccard_components(docs, k, percent, id_col, text_col)
        gone = keep(stored(found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "gone"))
    return restrict(docs, gone, id_col, "left_anti")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT u, v FROM links
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce((SELECT min(v) FROM reach WHERE u = doc_id), doc_id)) AS component_id
FROM sets
"""
