"""Interval operators: overlap joins, unions and coverage, overlap components, affinity, dominant regions, coalescing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_join(a: DataFrame, b: DataFrame, key: str, cell: int = 4096) -> DataFrame:
    """Pairs of half-open intervals (key, start, end) that share a byte: columns of a as a_*, of b as b_*, and overlap.

    Intervals are dealt to the fixed cells that they touch and joined by (key, cell), so that a key with many
    intervals is spread over its cells; a pair is taken in the cell where the overlap begins.
    """

    def dealt(x: DataFrame, p: str) -> DataFrame:
        x = x.filter(F.col("end") > F.col("start")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
        return x.select(*[F.col(c) if c in (key, "cell") else F.col(c).alias(f"{p}_{c}") for c in x.columns])

    both = dealt(a, "a").join(dealt(b, "b"), [key, "cell"])
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.filter((lo < hi) & (F.floor(lo / cell) == F.col("cell"))).withColumn("overlap", hi - lo).drop("cell")


def _islands(spans: DataFrame, keys: Sequence[str], touch: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("start") > before) if touch else (F.col("start") >= before)
    marked = spans.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int"))
    island = marked.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("parts").alias("parts")).drop("island")


def merge_overlapping(spans: DataFrame, keys: Sequence[str], touch: bool = True, cell: int = 65_536) -> DataFrame:
    """(keys, start, end, parts): unions of a key's intervals that overlap (or touch): gaps and islands by a running maximum.

    First among intervals that start in the same cell, so that a key with many is spread over its cells, then among what is left.
    """
    rows = spans.filter(F.col("end") > F.col("start")).select(*keys, "start", "end", F.lit(1).cast("long").alias("parts"), F.floor(F.col("start") / cell).alias("_cell"))
    return _islands(_islands(rows, [*keys, "_cell"], touch).drop("_cell"), keys, touch)


def coverage(wanted: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(key, wanted, covered): bytes of the union of wanted spans, and those of them that shown spans cover."""
    w, s = merge_overlapping(wanted, [key]), merge_overlapping(shown, [key])
    total = w.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("wanted"))
    hit = overlap_join(w, s, key).groupBy(key).agg(F.sum("overlap").alias("covered"))
    return total.join(hit, key, "left").select(key, "wanted", F.coalesce("covered", F.lit(0)).alias("covered"))


def affinity(candidates: DataFrame, cues: DataFrame, key: str = "owner") -> DataFrame:
    """(candidate id, affinity): mean cosine of the units over a candidate's span, weighted by shared bytes, clamped; none without overlap."""
    both = overlap_join(candidates, cues, key)
    mean = F.sum(F.col("b_cosine") * F.col("overlap")) / F.sum("overlap")
    return both.groupBy(F.col("a_id").alias("id")).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("affinity"))


def dominant_region(candidates: DataFrame, cues: DataFrame, key: str = "owner") -> DataFrame:
    """(id, start, end): the unit that shares most bytes with a candidate, then the higher cosine, then the earliest."""
    both = overlap_join(candidates, cues, key)
    best = both.groupBy(F.col("a_id").alias("id")).agg(F.max_by(F.struct(F.col("b_start").alias("start"), F.col("b_end").alias("end")), F.struct("overlap", "b_cosine", -F.col("b_start"), -F.col("b_end"))).alias("r"))
    return best.select("id", "r.start", "r.end")


def parents(children: DataFrame, blocks: DataFrame, key: str = "owner") -> DataFrame:
    """(child id, start, end): the smallest block that contains a unit's span, else the unit itself."""
    both = overlap_join(children, blocks, key).filter("b_start <= a_start and b_end >= a_end")
    best = both.groupBy("a_id").agg(F.min(F.struct((F.col("b_end") - F.col("b_start")).alias("size"), F.col("b_start").alias("s"), F.col("b_end").alias("e"))).alias("b"))
    rows = children.join(best, children["id"] == best["a_id"], "left")
    return rows.select("id", F.coalesce("b.s", "start").alias("start"), F.coalesce("b.e", "end").alias("end"))


def contained(passages: DataFrame, key: str = "owner") -> DataFrame:
    """(id, by): passages whose span lies inside another one of the same source; of equal spans all but the least id."""
    both = overlap_join(passages, passages, key).filter("a_id <> b_id and b_start <= a_start and b_end >= a_end and (b_start < a_start or b_end > a_end or b_id < a_id)")
    return both.groupBy(F.col("a_id").alias("id")).agg(F.min("b_id").alias("by"))


def interleave(rows: DataFrame, owner: str, order: Sequence, owner_order: str, most: int = 160) -> DataFrame:
    """Round robin over owners: each owner's first row, then each one's second, up to its most-th; owners in owner_order. Adds turn."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).filter(F.col("turn") <= most)
    return ranked.orderBy("turn", owner_order)
