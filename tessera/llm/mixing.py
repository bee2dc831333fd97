"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, written

ROUNDS = 10  # passes over the three marginals
POWER = 0.5  # a value's target share is its token share to this power, scaled to sum to 1
BUDGET = 0.8  # expected tokens of the sample as a share of all
SEED = "mix"
ONE_TASK = 100_000  # rows of the cell table that one task rakes; a larger table is raked by shuffles
MARGINS = ("source", "language", "topic")
#: A text's topic is the first of these that fits.
TOPICS = (("table", " | "), ("licence", "License"), ("secret", "token = "))


def topic() -> Column:
    out = F.when(F.col("text").isNull(), "none")
    for name, mark in TOPICS:
        out = out.when(F.contains("text", F.lit(mark)), name)
    return out.otherwise("prose")


def rake(cells: DataFrame, rounds: int = ROUNDS, power: float = POWER, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (source, language, topic, tokens) with weight: shares of the total, raked to each margin in turn.

    targets gives {margin: {value: share}}; a margin without any has token shares to the given power. Values
    without a target have none of the weight.
    """
    for m in MARGINS:
        given = (targets or {}).get(m)
        if given:
            wanted = F.coalesce(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(m)], F.lit(0.0))
            cells = cells.withColumn(f"to_{m}", wanted)
        else:
            sums = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
            whole = F.lit(float(sums.agg(F.sum("p")).first()[0] or 1.0))
            cells = cells.join(sums.select(m, (F.col("p") / whole).alias(f"to_{m}")), m)
    cells = written(cells.withColumn("weight", F.col("tokens").cast("double")), "cells", few=True)
    single = cells.count() <= ONE_TASK
    if single:
        cells = cells.coalesce(1)
    for i in range(rounds):
        for m in MARGINS:
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"to_{m}") / F.sum("weight").over(Window.partitionBy(m)))
        if i % 5 == 4 and i + 1 < rounds:
            cells = written(cells, "cells", few=True)
            cells = cells.coalesce(1) if single else cells
    return cells


def mix_sources(docs: DataFrame, budget: float = BUDGET, seed: str = SEED, topics: Column | None = None, **raking) -> DataFrame:
    """(row, source, language, topic, tokens, weight, probability, chosen, copies) of every row; row holds all its columns.

    tokens are runs without spaces, at least 1. A row's probability is the budget's share of its cell's weight over
    the cell's tokens, at most 1; it is chosen if a hash of seed and doc_id, as a number below 1, is less. copies are
    how often a row must stand in the sample for the targets to be met: what the 1 cuts off is whole copies and a
    chance of one more, by the same hash; a row has copies exactly if it is chosen. Nulls in
    source and lang are a value of their own, (none); null ids hash as empty; repeated rows are chosen alike. topics is the
    column of a row's topic, where there is a better one than topic(), which only tells kinds of lines apart.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    words = F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), F.lit(0)), F.lit(1)).cast("long")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    kinds = [blank("source").alias("source"), blank("lang").alias("language"), (topic() if topics is None else F.coalesce(topics.cast("string"), F.lit("(none)"))).alias("topic"), words.alias("tokens")]
    cells = rake(written(docs.select(*kinds).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells", few=True), **raking)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = F.lit(budget) * F.col("weight") * F.lit(float(total)) / F.col("tokens")
    rate = written(cells.select(*MARGINS, "weight", F.least(F.lit(1.0), wanted).alias("probability"), wanted.alias("wanted")), "rates", few=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *kinds, u.alias("u"))
    sure = F.floor("wanted")
    copies = sure + (F.col("u") < F.col("wanted") - sure).cast("long")
    return rows.join(rate, list(MARGINS)).select("row", *MARGINS, "tokens", "weight", "probability", (F.col("u") < F.col("probability")).alias("chosen"), copies.alias("copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), *MARGINS, "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "chosen", "copies")


def oracle() -> str:
    marks = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    parts = [
        f"""d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS language,
         CASE WHEN text IS NULL THEN 'none' {marks} ELSE 'prose' END AS topic,
         greatest(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0), 1)::BIGINT AS tokens,
         ('0x' || substr(md5('{SEED}-' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM documents)""",
        "c AS (SELECT source, language, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {POWER}) AS p FROM c GROUP BY {m})")
        parts.append(f"s_{m} AS (SELECT {m}, p / sum(p) OVER () AS to_{m} FROM t_{m})")
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM c JOIN s_source USING (source) JOIN s_language USING (language) JOIN s_topic USING (topic))")
    for i in range(ROUNDS * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (weight * to_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{i})")
    return f"""WITH {", ".join(parts)}, r AS (
  SELECT source, language, topic, weight, {BUDGET} * weight * (SELECT sum(tokens)::DOUBLE FROM c) / tokens AS wanted FROM w{ROUNDS * len(MARGINS)}
) SELECT doc_id, source, language, topic, tokens, round(weight, 6) AS weight, round(least(1.0, wanted), 6) AS probability, u < least(1.0, wanted) AS chosen,
  (floor(wanted) + CASE WHEN u < wanted - floor(wanted) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN r USING (source, language, topic)"""


ORACLE = oracle()
