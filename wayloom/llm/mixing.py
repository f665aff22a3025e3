"""Operator 3: mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents are counted once into cells (source, language, topic) of token sums. A cell's kept tokens start in proportion
to its tokens and are raked to the targets of each dimension in turn, never above what the cell has: the
probability of a document is its cell's kept tokens by its actual ones, so the cap at 1 is a bound in each round and the
marginals are met under it. The budget is a part of the largest at which each target is reachable without repeats. Rounds
go on until no value is further from its target than ``TOLERANCE`` (of the tokens kept); if they don't get there, since
targets of several dimensions exclude each other at this budget, the budget is lowered and they start again, as long as
that helps. Where combinations are missing, no budget may meet all targets; then the residual, which is returned, says
how far off the best result is. A
document is kept if a hash of its id, as a number in [0, 1), is smaller than its probability.

Only cells go through the rounds (as many as there are combinations, not documents): few are raked in one partition
by window sums, many in shuffled ones. Documents meet the cells' probabilities in a join that broadcasts them only when
they are counted and few.

Results for odd input: a null source, language or topic is a value of its own (the empty string); a null or empty
text has 0 tokens; cells without tokens are kept whole (they cost nothing); rows that repeat an id are all kept or
all dropped within one cell; a very long text counts by all its words; a target for a value without tokens has no effect; an
empty table gives no rows; other columns stay as they are (names that begin with two underscores are the operator's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import MAX_BROADCAST_KEYS, drop, keep, scratch, stored

DIMENSIONS = ("source", "lang", "topic")
#: Rounds between two looks at the residual; rounds end if the residual is above this part of that of the look before.
ROUNDS = 12
STALLED = 0.9
#: Largest distance of a value's share of the kept tokens from its target.
TOLERANCE = 1e-6
#: Targets: shares proportional to the tokens to this power, so small values gain.
POWERS = {"source": 0.8, "lang": 0.7, "topic": 0.9}
#: Part of the largest budget at which each target alone is reachable.
BUDGET = 0.9
#: Cells that are raked in one partition.
FEW_CELLS = 50_000

_WHITE = " \t\n\x0b\f\r"


def token_count(text: Column) -> Column:
    """Words of a text (runs other than white space)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds: tables, marks, shouting, contacts, or prose by length."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "tables")
        .when(F.contains(t, F.lit("%%%")) | F.contains(t, F.lit("###")), "marks")
        .when(F.contains(t, F.lit("!! ")), "shouting")
        .when(F.contains(t, F.lit("@")), "contacts")
        .when(F.length(t) < 1000, "short prose")
        .when(F.length(t) < 4000, "prose")
        .otherwise("long prose")
    )


def unit_hash(id_: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of an id's text."""
    digest = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_goals(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """The cells with the target share of each of their values: g_source, ... (of the values with tokens)."""
    out = cells
    for d, power in powers.items():
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").select(d, F.pow("t", F.lit(power)).alias("s"), "t")
        whole = sums.agg(F.sum("s").alias("z"))
        share = sums.crossJoin(F.broadcast(whole)).select(d, (F.col("s") / F.col("z")).alias(f"g_{d}"), F.col("t").alias(f"t_{d}"))  # one row is broadcast
        out = out.join(share, d, "left")
    return out


def rake(cells: DataFrame, dimensions: list[str], budget: float, rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``w``, the tokens to keep, after so many rounds more: raked to the targets times the budget, never above
    their tokens. Without ``w`` they start in proportion to their tokens."""
    out = cells
    if "w" not in cells.columns:
        out = cells.withColumn("w", F.col("tokens") * F.lit(budget) / F.sum("tokens").over(Window.partitionBy()))
    for _ in range(rounds):
        for d in dimensions:
            sums = F.sum("w").over(Window.partitionBy(d))
            ratio = F.when(sums > 0, F.coalesce(F.col(f"g_{d}") * F.lit(budget) / sums, F.lit(1.0))).otherwise(1.0)
            out = out.withColumn("w", F.least(F.col("tokens").cast("double"), F.col("w") * ratio))
    return out


def residual(cells: DataFrame, dimensions: list[str]) -> float:
    """The largest distance of a value's share of the kept tokens from its target."""
    most = 0.0
    for d in dimensions:
        sums = cells.where(F.col(f"g_{d}").isNotNull()).groupBy(d).agg(F.sum("w").alias("w"), F.first(f"g_{d}").alias("g"))
        far = sums.withColumn("z", F.sum("w").over(Window.partitionBy())).agg(F.max(F.abs(F.col("w") / F.col("z") - F.col("g"))).alias("far")).first()["far"]
        most = max(most, far or 0.0)
    return most


def fitted(cells: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> tuple[DataFrame, float, float]:
    """(cells with p, tokens that are kept in expectation, the residual of the targets)."""
    powers = powers or POWERS
    names = list(powers)
    cells = with_goals(cells, powers)
    cells = stored(cells, "goals")
    reach = [F.min(F.when(F.col("tokens") > 0, F.col(f"t_{d}") / F.col(f"g_{d}"))).alias(d) for d in names]
    least = [x for x in cells.agg(*reach).first() if x is not None]
    tokens = budget * min(least) if least else 0.0
    few, best = cells.count() <= FEW_CELLS, None
    while True:
        now, far = cells, float("inf")
        while True:
            before, last = now, far
            now = stored(rake(now.coalesce(1) if few else now, names, tokens, rounds), "raked")
            if before is not cells:
                drop(before)
            far = residual(now, names)
            if far <= TOLERANCE or far > STALLED * last:
                break
        if best is None or far < best[2]:
            better = best is None or far < STALLED * best[2]
            best = now, tokens, far
        else:
            better = False
        if far <= TOLERANCE or not better:
            break
        tokens *= 0.9
    now, tokens, far = best
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") / F.col("tokens"))).otherwise(1.0)
    return now.withColumn("p", p), tokens, far


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with cell columns __source, __lang, __topic."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"__source": plain("source"), "__lang": plain("lang"), "__topic": topic_of(F.col(text_col))})


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) with __source, __lang, __topic, __p, __kept and __residual (of the whole mixture)."""
    rows = keyed(docs, text_col)
    with scratch(docs.sparkSession):
        counted = rows.select(*(F.col(f"__{d}").alias(d) for d in DIMENSIONS), token_count(F.col(text_col)).alias("tokens"))
        cells = stored(counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
        found, _, far = fitted(cells, powers, budget, rounds)
        found = keep(stored(found.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.col("p").alias("__p")), "probabilities"))
    few = found.count() <= MAX_BROADCAST_KEYS // 4
    out = rows.join(F.broadcast(found) if few else found, [f"__{d}" for d in DIMENSIONS], "left")
    return out.withColumn("__kept", unit_hash(F.col(id_col)) < F.col("__p")).withColumn("__residual", F.lit(far))


def op3_mix_to_targets(spark, sf_dir: str) -> DataFrame:
    """All documents with their cell, its calibrated probability and the decision; on_target says that the targets are met."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    out = mixed(docs)
    return out.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.round("__p", 6).alias("probability"), F.col("__kept").alias("kept"), (F.col("__residual") <= TOLERANCE).alias("on_target"),
    )


def sample_mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mixture keeps, columns as they are."""
    return mixed(docs, **how).where("__kept").select(*docs.columns)


def mix_sql() -> str:
    """The same in DuckDB SQL, the first rounds unrolled; those up to the first look that finds the targets met count."""
    looks = 5
    topic = """CASE WHEN contains(t, ' | ') THEN 'tables' WHEN contains(t, '%%%') OR contains(t, '###') THEN 'marks'
      WHEN contains(t, '!! ') THEN 'shouting' WHEN contains(t, '@') THEN 'contacts'
      WHEN length(t) < 1000 THEN 'short prose' WHEN length(t) < 4000 THEN 'prose' ELSE 'long prose' END"""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    parts = [
        f"d0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, trim(coalesce(text, ''), {white}) AS b FROM documents)",
        rf"d AS (SELECT doc_id, source, lang, {topic} AS topic, CASE WHEN b = '' THEN 0 ELSE len(regexp_split_to_array(b, '[\x20\x09-\x0D]+')) END AS tokens FROM d0)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for d, p in POWERS.items():
        parts.append(f"m_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS t, power(sum(tokens), {p}) / sum(power(sum(tokens), {p})) OVER () AS g FROM cells GROUP BY {d} HAVING sum(tokens) > 0)")
    least = " UNION ALL ".join(f"SELECT min(t / g) AS x FROM m_{d}" for d in POWERS)
    parts.append(f"z AS MATERIALIZED (SELECT {BUDGET} * min(x) AS z FROM ({least}))")
    last = "(SELECT *, tokens * (SELECT z FROM z) / sum(tokens) OVER () AS w FROM cells)"
    ends, far = [], []
    for r in range(looks * ROUNDS):
        for d in POWERS:
            name = f"r{r}_{d}"
            parts.append(f"{name} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, least(x.tokens, CASE WHEN s > 0 THEN w * coalesce(m.g * (SELECT z FROM z) / s, 1) ELSE w END) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {d}) AS s FROM {last}) x LEFT JOIN m_{d} m ON x.{d} = m.{d})")
            last = name
        if (r + 1) % ROUNDS == 0:
            ends.append(last)
            far += [f"SELECT {len(ends)} AS look, max(abs(w / (SELECT sum(w) FROM {last}) - g)) AS far FROM (SELECT {d}, sum(w) AS w FROM {last} GROUP BY {d}) JOIN m_{d} USING ({d})" for d in POWERS]
    p = " UNION ALL ".join(f"SELECT {k + 1} AS look, source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, w / tokens) ELSE 1.0 END AS p FROM {e}" for k, e in enumerate(ends))
    parts += [
        f"far AS MATERIALIZED (SELECT look, max(far) AS far FROM ({' UNION ALL '.join(far)}) GROUP BY look)",
        f"met AS MATERIALIZED (SELECT coalesce(min(look) FILTER (far <= {TOLERANCE}), {looks}) AS look FROM far)",
        f"p AS (SELECT * FROM ({p}) WHERE look = (SELECT look FROM met))",
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, round(p.p, 6) AS probability,
  CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < p.p AS kept, (SELECT far FROM far JOIN met USING (look)) <= {TOLERANCE} AS on_target
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
