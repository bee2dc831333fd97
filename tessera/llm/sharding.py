"""Sharding by vector bin packing: bytes, tokens and rows of groups of equal texts are balanced jointly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, written

CELLS = 8192  # light groups are packed by hash cell: a fixed number of items, whatever the input
HEAVY = 1 / 4096  # a group with a larger share of any measure is an item of its own


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (row of sizes): largest items first, each where the dot product of its vector with the
    shard's residual capacity is highest, the lower shard among equals. Measures are scaled to shares of the total."""
    total = sizes.sum(axis=0).astype(float)
    share = sizes / np.where(total > 0, total, 1)
    residual = np.full((shards, sizes.shape[1]), 1 / shards)
    out = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(axis=1))):
        out[i] = int(np.argmax(residual @ share[i]))
        residual[out[i]] -= share[i]
    return out


def place(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) of every row; size is UTF-8 bytes plus 1, null texts count as empty.

    Equal texts form a group and share a shard, except that a group with more than a shard's fair share of any
    measure is split, by row, into pieces of about an eighth of that, so that shards stay near equal. At most
    1 / HEAVY groups a measure are heavy; all others are packed by the hash cell of their text, CELLS in number,
    so that what the driver packs is bounded. Slots run gapless from 0 in each shard, by
    a count for each scan partition and not in one task. Repeated rows and null ids are rows like others; an
    empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(rows, "sized", few=docs)
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    bound = [max(1, int((x or 0) * HEAVY)) for x in total]
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    heavy = groups.filter((F.col("size") > bound[0]) | (F.col("tokens") > bound[1]) | (F.col("n") > bound[2]))
    share = {r["group"]: max(r[k] / (t or 1) for k, t in zip(("size", "tokens", "n"), total, strict=True)) for r in heavy.collect()}
    pieces = {g: int(np.ceil(8 * shards * x)) if x > 1 / shards else 1 for g, x in share.items()}
    spark = docs.sparkSession
    split = F.broadcast(spark.createDataFrame(list(pieces.items()), "group long, pieces int"))
    cell = F.coalesce(F.concat(F.lit("h"), F.col("group"), F.lit("."), F.pmod(F.xxhash64("rid"), F.col("pieces"))), F.concat(F.lit("c"), F.pmod(F.col("group"), F.lit(CELLS))))
    rows = rows.join(split, "group", "left").withColumn("cell", cell)
    items = sorted(rows.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect())
    where = pack(np.array([[r["size"], r["tokens"], r["n"]] for r in items], float).reshape(-1, 3), shards)
    placed = F.broadcast(spark.createDataFrame([(r["cell"], int(s)) for r, s in zip(items, where, strict=True)], "cell string, shard int"))
    rows = rows.join(placed, "cell").withColumn("part", F.shiftright("rid", 33))
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    # a row for each scan partition and shard: few, and summed by shard
    before = counts.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("part", "shard").orderBy("rid")))
    return ranked.join(before, ["part", "shard"]).select("doc_id", "size", "text_crc32", "group", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def balance(placed: DataFrame, by: Sequence[str] = ("size",)) -> DataFrame:
    """Sums and rows of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in by])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
