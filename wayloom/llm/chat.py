"""Operator 8: reply trees, formatted as conversations. DataFrame functions only.

Nodes have a parent (null, or one that doesn't exist: a root). Iterative self-joins double the distance of each
node's jump pointer and sum the scores on the way, so a tree of depth d takes log2(d) rounds. Each leaf then has
its root and the score of its branch (the mean of its nodes'); the best ``top`` branches of each root are
walked with the stored pointers, again doubling, and each is formatted as one conversation.

The template puts every turn between ``<|im_start|>role`` and ``<|im_end|>``. Inside texts and roles ``&``, ``<``
and ``[`` are written as entities (so is a line break in a role), so no control string of this or
another template survives inside a text, and the escape is reversible. The loss mask is a list of spans.

Results for odd input: a null text or role is empty; rows of one conversation that repeat a turn follow each
other by role and text; nodes on a cycle, or under one, belong to no path; equal branch scores go to the
larger leaf key; very long texts are formatted whole; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop, keep, scratch, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    for code, sign in (("&#10;", "\n"), ("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """Pointers of 1, 2, 4, ... steps: (node, jump, total, steps), where ``total`` sums the scores of the
    ``steps`` nodes from the node (inclusive) to its jump (exclusive). The last table's jumps are all null but for cycles."""
    present = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    first = nodes.join(present, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("jump"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    tables = [stored(first, "jumps")]
    most = max(1, tables[0].count()).bit_length() + 1
    while len(tables) <= most and not tables[-1].where("jump is not null").isEmpty():
        t = tables[-1]
        ahead = t.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("total").alias("more"), F.col("steps").alias("far"))
        open_, ended = t.where("jump is not null"), t.where("jump is null")
        moved = open_.join(ahead, "jump").select("node", F.col("next").alias("jump"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("far")).alias("steps"))
        tables.append(stored(moved.unionByName(ended), "jumps"))
    return tables


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, node, place) of the ``top`` best-scored root-to-leaf paths of each tree.

    ``nodes``: node (unique), parent, score. Place counts from the root, which has 0.
    """
    tables = jump_tables(nodes.select("node", "parent", F.col("score").cast("double").alias("score")))
    last = tables[-1].where("jump is null")  # nodes that reach a root
    parents = tables[0].where("jump is not null").select(F.col("jump").alias("node")).distinct()
    leaves = last.join(parents, "node", "left_anti")
    # the root of each leaf, by the same pointers
    at = leaves.select(F.col("node").alias("leaf"), "node", (F.col("steps") - 1).alias("left"), "total", "steps")
    at = _walk(at, tables)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("leaf")))
    chosen = at.withColumn("rank", rank).where(F.col("rank") <= top).select("leaf", "steps")
    path = stored(chosen.select("leaf", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("place")), "paths")
    for t in reversed(tables[:-1]):  # distances are sums of distinct powers of two
        k = tables.index(t)
        step = t.where("jump is not null").select("node", "jump")
        more = path.where(F.col("place") >= (1 << k)).join(step, "node").select("leaf", F.col("jump").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        path = stored(path.unionByName(more), "paths")
    return path


def _walk(at: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Moves each row's node up by ``left`` steps."""
    for k in reversed(range(len(tables) - 1)):
        step = tables[k].where("jump is not null").select("node", "jump")
        go = F.col("left") >= (1 << k)
        moved = at.where(go).join(step, "node").select("leaf", F.col("jump").alias("node"), (F.col("left") - (1 << k)).alias("left"), "total", "steps")
        at = stored(at.where(~go).select("leaf", "node", "left", "total", "steps").unionByName(moved), "walk")
    return at


def formatted(turns: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss): one string for each key from (key, place, role, text), and the assistant texts' spans."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    text = escape(F.coalesce("text", F.lit("")))
    parts = turns.select(key, "place", (F.coalesce("role", F.lit("")) == "assistant").alias("learn"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"))
    parts = parts.withColumn("n", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "learn", F.col("start").cast("int").alias("start"), F.length("body").alias("length"))
    out = parts.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x.learn), lambda x: F.struct(x.start.alias("start"), x.length.alias("length")))
    return out.select(key, F.concat_ws("", F.transform("t", lambda x: x.turn)).alias("formatted"), spans.alias("loss"))


def parsed(out: DataFrame) -> DataFrame:
    """Adds turns (role and text as they were) and the unescaped text under the loss mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(OPEN) + 1))
        head = F.substring_index(inner, "\n", 1)
        return F.struct(unescape(head).alias("role"), unescape(F.substr(inner, F.length(head) + 2)).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.length)))
    return out.withColumn("turns", F.transform(parts, turn)).withColumn("masked", F.concat_ws("", masked))


def reply_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, formatted, loss) of the best paths of trees: node, parent, score, role, text."""
    path = best_paths(nodes, top)
    turns = path.join(nodes.select("node", "role", "text"), "node")
    return formatted(turns, "leaf")


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Each conversation's rows as a tree: every row replies to the one before it; scores are text lengths."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(order))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return rows.select("conv_id", F.concat_ws(":", name, F.col("place")).alias("node"), F.when(F.col("place") > 1, F.concat_ws(":", name, F.col("place") - 1)).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def op8_reply_trees(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings of a template."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    with scratch(spark):
        nodes = stored(conversation_nodes(turns.unionByName(odd)), "nodes")
        out = keep(stored(reply_trees(nodes), "formatted"))
    read = parsed(out)
    of = F.split("leaf", ":")[0]
    return read.select(
        F.when(of != "", of.cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS r,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
