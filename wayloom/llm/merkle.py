"""Operator 11: a Merkle manifest of a dataset, with a proof for each row.

Rows are leaves; the leaves of a group, in the order of their key, are a tree whose nodes have ``FAN`` children each (the
last of a level fewer), and the groups' roots, in the order of the groups, are the leaves of the last tree. Digests are
lower-case hex SHA-256 of the children's digests, one after the other.

The leaves are an RDD sorted by ranges of (group, key). One job counts each partition's first and last group, so the
driver learns, of every partition, where its leaves stand in their groups: numbers for each partition, nothing for each group
or row. A second one builds all runs that lie whole within a partition and emits the rest: nodes at a ragged edge, by their
coordinate (tree, level, run), at most 2 (FAN - 1) a level. They are shuffled by that coordinate, level after level, until
each tree has its root; then the groups' roots likewise. A third one builds the partition's runs again, is given the
runs that it lacks (found by coordinate, two a level), and writes each row's digest of its proof, folded root and verdict.
The texts are read once; what is sorted are two digests a row. Partitions hold ``ROWS`` rows, whatever the groups' sizes.

Results for odd input: a null column is ``-`` in its leaf; a null group is a group of its own and the first; a null key comes
first in its group; rows that repeat a key are in the order of their leaves' digests; equal rows are leaves each, and which of
them has which place can't be told; very long texts are hashed whole; an empty table gives no rows; a group of one row has that
leaf as its root, and a dataset of one group has that group's as its root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import UPPER, keep, scratch, stored

FAN = 8
#: Characters of a digest.
HEX = 64
#: Rows of one partition of the sorted leaves, about.
ROWS = 50_000
#: Tree of the groups' roots; the others have their group's place.
TOP = -1

Coordinate = tuple[int, int, int]  # tree, level of its children, run


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows have equal inputs; null is ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


class Span(NamedTuple):
    """What the counts of all partitions say of one: the places of its first and last group among all groups, the place of
    its first leaf in its group, both groups' numbers of leaves, and the number of groups."""

    first: int
    last: int
    offset: int
    first_size: int
    last_size: int
    trees: int


def edges(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(first group, its rows, last group, its rows, number of groups) of a partition; groups are None where it has no rows."""
    first = last = None
    n_first = n_last = groups = 0
    for r in rows:
        if last is None or r[0] != last[0]:
            last, n_last, groups = (r[0],), 0, groups + 1
            first = first or last
        n_last += 1
        n_first += groups == 1
    yield first, n_first, last, n_last, groups


def spans(parts: list[tuple]) -> list[Span | None]:
    """One for each partition, from their ``edges`` in order."""
    place, open_, n = -1, None, 0  # the group at the end of what was read, and its leaves so far
    found: list[tuple[int, int, int] | None] = []
    sizes: dict[int, int] = {}  # of groups that are a partition's first or last
    for first, n_first, last, n_last, groups in parts:
        if first is None:
            found.append(None)
            continue
        if first != open_:
            place, n = place + 1, 0
        found.append((place, place + groups - 1, n))
        sizes[place] = sizes.get(place, 0) + n_first
        n = n_last if groups > 1 else n + n_last
        place, open_ = place + groups - 1, last
        if groups > 1:
            sizes[place] = n_last
    return [f and Span(*f, sizes[f[0]], sizes[f[1]], place + 1) for f in found]


def height(size: int) -> int:
    level = 0
    while size > 1:
        size, level = -(-size // FAN), level + 1
    return level


def path_runs(first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
    """(level, run) of the runs on the ways of leaves ``first`` to ``last`` to the root."""
    for level in range(height(size)):
        first, last = first // FAN, last // FAN
        for run in range(first, last + 1):
            yield level, run


class Local:
    """What the leaves from place ``at`` on determine of a tree of ``size``: the runs that are whole, by (level, run), and the
    nodes of the others."""

    def __init__(self, size: int, at: int, leaves: list[str]):
        self.size, self.at, self.n = size, at, len(leaves)
        self.runs: dict[tuple[int, int], str] = {}
        self.ragged: list[tuple[int, int, int, str]] = []  # level, run, node, digest
        nodes, end = leaves, at + len(leaves)
        for level in range(height(size)):
            wide = -(-size // FAN**level)
            low, high = -(-at // FAN), -(-end // FAN) if end == wide else end // FAN
            for k, d in enumerate(nodes, at):
                if not low <= k // FAN < high:
                    self.ragged.append((level, k // FAN, k, d))
            up = []
            for run in range(low, high):
                self.runs[level, run] = text = "".join(nodes[run * FAN - at : (run + 1) * FAN - at])
                up.append(digest(text))
            nodes, at, end = up, low, low + len(up)
        self.root = nodes[0] if nodes else None

    def lacking(self) -> Iterator[tuple[int, int]]:
        """The runs on the leaves' ways to the root that aren't whole here: two a level at most."""
        low, high = self.at, self.at + self.n - 1
        for level in range(height(self.size)):
            low, high = low // FAN, high // FAN
            yield from ((level, run) for run in sorted({low, high}) if (level, run) not in self.runs)


def trees_of(rows: Iterator[tuple], span: Span) -> Iterator[tuple[int, Local, list[tuple]]]:
    """(tree, its part here, its rows) for each group of a sorted partition."""
    for k, (_, own) in enumerate(groupby(rows, key=lambda r: (r[0],)), span.first):
        held = list(own)
        size = span.first_size if k == span.first else span.last_size if k == span.last else len(held)
        yield k, Local(size, span.offset if k == span.first else 0, [r[2] for r in held]), held


def boundary(part: int, rows: Iterator[tuple], span: Span | None) -> Iterator[tuple]:
    """Rows of EDGES: the ragged nodes of a partition, the roots it has, and the runs that its rows need from elsewhere."""
    if span is None:
        return
    for tree, local, _ in trees_of(rows, span):
        for level, run, node, d in local.ragged:
            yield "node", part, tree, local.size, level, run, node, d
        if local.root:
            yield "root", part, tree, local.size, 0, tree // FAN, tree, local.root
        for level, run in local.lacking():
            yield "want", part, tree, local.size, level, run, 0, ""
    for level, run in path_runs(span.first, span.last, span.trees):
        yield "want", part, TOP, span.trees, level, run, 0, ""


EDGES = "kind string, part int, tree long, size long, level int, run long, node long, digest string"


def finished(nodes: DataFrame, most: int) -> DataFrame | None:
    """(tree, level, run, digests, root) of all runs above ``nodes`` (tree, size, level, run, node, digest), for trees of
    at most ``most`` leaves: a level's nodes meet by their coordinate. ``root`` is set for a tree's last run."""
    out = above = None
    for level in range(height(most)):
        here = nodes.where(F.col("level") == level).select("tree", "size", "run", "node", "digest")
        if above is not None:
            moved = above.where("root is null").select("tree", "size", F.floor(F.col("run") / FAN).alias("run"), F.col("run").alias("node"), F.sha2("digests", 256).alias("digest"))
            here = here.unionByName(moved)
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x.digest)  # FAN at most
        runs = here.groupBy("tree", "size", "run").agg(F.concat_ws("", children).alias("digests"))
        last = F.col("size") <= FAN ** (level + 1)
        above = stored(runs.withColumn("level", F.lit(level)).withColumn("root", F.when(last, F.sha2("digests", 256))), "runs")
        out = above if out is None else out.unionByName(above)
    return out


def proven(rows: list[tuple], span: Span | None, given: list[tuple], root: str) -> Iterator[tuple]:
    """(group, key, leaf, extra, subroot, root, proof) of a partition's rows. ``given`` are the runs that it asked for."""
    if span is None:
        return
    runs: dict[Coordinate, str] = {(t, level, run): text for t, level, run, text in given}
    for tree, local, held in trees_of(iter(rows), span):
        top = [(place % FAN, runs[TOP, level, place // FAN]) for level, place in enumerate(ancestors(tree, span.trees))]
        subroot = local.root or digest(runs[tree, height(local.size) - 1, 0])
        for x, r in enumerate(held, local.at):
            way = []
            for level, place in enumerate(ancestors(x, local.size)):
                way.append((place % FAN, local.runs.get((level, place // FAN)) or runs[tree, level, place // FAN]))
            proof = [(at, text[: HEX * at] + text[HEX * (at + 1) :]) for at, text in way + top]
            yield r[0], r[1], r[2], r[3], subroot, root, proof


def ancestors(place: int, size: int) -> Iterator[int]:
    """The places of a leaf's node at each level below the root."""
    for _ in range(height(size)):
        yield place
        place //= FAN


PROOF = "array<struct<at:int,siblings:string>>"


def manifest(leaves: DataFrame) -> DataFrame:
    """(g, k, leaf, extra, subroot, root, proof) of leaves (g: group, k: key, leaf: digest, extra: any string, taken along).

    A proof has, for each level from the leaf to the root, the digests of the run's other nodes, left to right in one
    string, and the place among them where the row's own node goes (``folded`` puts it there). Runs of one have none."""
    spark = leaves.sparkSession
    kinds = dict(leaves.dtypes)
    schema = f"g {kinds['g']}, k {kinds['k']}, leaf string, extra string, subroot string, root string, proof {PROOF}"
    with scratch(spark):
        # equal rows are told apart by a number that is written once, so that a third of all rows may be equal
        own = stored(leaves.select("g", "k", "leaf", "extra", F.rand(7).alias("salt")), "leaves")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // ROWS))
        order = ["g", "k", "leaf", "salt"]
        ranged = own.repartitionByRange(n, *order).sortWithinPartitions(*order).select("g", "k", "leaf", "extra").rdd.map(tuple, True)
        counted = spans(ranged.mapPartitions(edges).collect())  # five values for each partition
        trees = next((s.trees for s in counted if s), 0)
        if not trees:
            return spark.createDataFrame([], schema)
        at = spark.sparkContext.broadcast(counted)
        cut = stored(spark.createDataFrame(ranged.mapPartitionsWithIndex(lambda i, rows: boundary(i, rows, at.value[i])), EDGES, verifySchema=False), "edges")
        ragged = finished(cut.where("kind = 'node'"), max(max(s.first_size, s.last_size) for s in counted if s))
        roots = cut.where("kind = 'root'").select("tree", "digest")
        if ragged is not None:
            roots = roots.unionByName(ragged.where("root is not null").select("tree", F.col("root").alias("digest")))
        place = F.col("tree")
        top = finished(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.lit(0).alias("level"), F.floor(place / FAN).alias("run"), place.alias("node"), "digest"), trees)
        runs = top if ragged is None else ragged if top is None else ragged.unionByName(top)
        root = (roots.select("digest") if top is None else top.where("root is not null").select("root")).first()[0]
        want = cut.where("kind = 'want'").select("part", "tree", "level", "run")  # none if all trees are single leaves
        given = want.withColumn("digests", F.lit("")) if runs is None else want.join(runs, ["tree", "level", "run"])
        given = stored(given.select("part", "tree", "level", "run", "digests"), "given")
        parts = ranged.getNumPartitions()
        by_part = given.rdd.map(lambda r: (r[0], tuple(r[1:]))).partitionBy(parts, int).mapPartitions(lambda rows: [[r for _, r in rows]])
        both = ranged.mapPartitions(lambda rows: [list(rows)]).zip(by_part)
        out = both.mapPartitionsWithIndex(lambda i, two: (x for rows, mine in two for x in proven(rows, at.value[i], mine, root)))
        return keep(stored(spark.createDataFrame(out, schema, verifySchema=False), "manifest"))


def folded(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""

    def up(node: Column, step: Column) -> Column:
        cut = step.at * HEX
        return F.sha2(F.concat(F.substr(step.siblings, F.lit(1), cut), node, F.substr(step.siblings, cut + 1)), 256)

    return F.aggregate(proof, leaf_digest, up)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each language; a third of the rows is presented with the text's A-Z lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    id_ = F.col("doc_id").cast("long")
    tampered = F.coalesce(F.crc32(id_.cast("string")) % 3 == 0, F.lit(False))
    seen = leaf(*row, F.translate("text", UPPER, UPPER.lower()))
    out = manifest(docs.select(F.col("lang").alias("g"), id_.alias("k"), leaf(*row, F.col("text")).alias("leaf"), F.when(tampered, seen).alias("extra")))
    out = out.withColumn("folded_root", folded(F.coalesce("extra", "leaf"), F.col("proof")))
    return out.select(
        F.col("k").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.concat_ws("", F.col("proof.siblings")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_sql(levels: int = 9, top: int = 4) -> str:
    """The same in SQL, its levels written out one by one: enough for 8^levels rows of a language and 8^top languages."""
    field_ = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf_ = lambda text: f"sha256({' || '.join(map(field_, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, b: {bits}), 4294967295)"
    ctes = [f"""d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM (
      SELECT doc_id, lang, {leaf_('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf_(lower)} ELSE {leaf_('text')} END AS seen FROM documents))""",
            "a0 AS (SELECT lang AS g, pos, leaf AS h, size FROM d)"]

    def tree(name: str, n: int) -> None:
        for i in range(n):
            ctes.append(f"{name}r{i} AS (SELECT g, pos // 8 AS run, size, string_agg(h, '' ORDER BY pos) AS t FROM {name}{i} WHERE size > 1 GROUP BY g, pos // 8, size)")
            ctes.append(f"{name}{i + 1} AS (SELECT g, run AS pos, sha256(t) AS h, (size + 7) // 8 AS size FROM {name}r{i})")

    tree("a", levels)
    every = " UNION ALL ".join(f"SELECT g, h FROM a{i} WHERE size = 1" for i in range(levels + 1))
    ctes += [f"s AS ({every})", "b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS size FROM s)",
             "k AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM s)"]
    tree("b", top)
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{i} WHERE size = 1" for i in range(top + 1)) + ")")
    ctes.append("f0 AS (SELECT d.doc_id, d.lang, d.leaf, d.pos, k.place, k.subroot, d.seen AS f, '' AS p FROM d JOIN k ON d.lang IS NOT DISTINCT FROM k.lang)")
    steps = [("a", i, "pos", "r.g IS NOT DISTINCT FROM f0.lang") for i in range(levels)] + [("b", i, "place", "true") for i in range(top)]
    for j, (name, i, at, same) in enumerate(steps):
        k = f"64 * ({at} // {8 ** i} % 8)"
        before, after = f"substr(r.t, 1, {k})", f"substr(r.t, {k} + 65)"
        ctes.append(f"f{j + 1} AS (SELECT f0.* EXCLUDE (f, p), CASE WHEN r.t IS NULL THEN f ELSE sha256({before} || f || {after}) END AS f, CASE WHEN r.t IS NULL THEN p ELSE p || {before} || {after} END AS p FROM f{j} AS f0 LEFT JOIN {name}r{i} AS r ON {same} AND r.run = {at} // {8 ** (i + 1)})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}, root"
