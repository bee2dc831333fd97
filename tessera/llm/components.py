"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the others and itself) are tied to its least neighbour.

    The least neighbour is an aggregate that is joined back, never a list, so that a hub's links stay spread
    over tasks: the sum is partial before the shuffle and the join can be split by AQE.
    """
    if large:
        links = _both_ways(edges)
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = links.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is the least node that can be reached.

    Nulls and self-links are ignored; an empty table gives an empty one. Rounds are logarithmic in the size of
    a component; each round's links are a table in the shared folder.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links", few=edges)
    seen = None
    for _ in range(rounds):
        before, edges = edges, written(_star(_star(edges, True), False), "links", few=edges)
        release(before)
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(pmod(xxhash64(b, a), 1000000007) as long)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
    raise RuntimeError("components did not settle")
