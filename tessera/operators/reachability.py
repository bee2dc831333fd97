"""Which node reaches which, without a row for each pair: components condensed, intervals as labels, a search where they don't decide."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import reach, strong_components
from tessera.sources.store import parted, release, written

NUMBERINGS = 2  # random ones, in each of which a node has an interval
SEARCHED = 4  # edges that a search goes on in one job


@dataclass
class ReachIndex:
    """nodes (id, c, cyclic, labels...): of every node its component, whether it reaches itself, and the intervals of numbers below and above it; edges (a, b) of components."""

    nodes: DataFrame
    edges: DataFrame


def _labels() -> list[str]:
    return [f"{side}_{end}{i}" for side in ("below", "above") for i in range(NUMBERINGS) for end in ("low", "high")]


def build(edges: DataFrame) -> ReachIndex:
    """The index of a graph (a, b); null ends don't count, repeated edges once.

    What a node reaches includes what each of those reaches, so the interval of the numbers (hashes) below it holds theirs, and the
    interval above it is within theirs. Both are found by values that spread over the condensed graph, along and against its edges.
    """
    edges = written(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "graph")
    with parted(edges.sparkSession, edges.count()):
        return _build(edges)


def _build(edges: DataFrame) -> ReachIndex:
    strong = written(strong_components(edges), "strong")
    loops = edges.filter("a = b").select(F.col("a").alias("id"), F.lit(True).alias("loop"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(strong, "id", "left").join(loops, "id", "left")
    nodes = nodes.select("id", F.coalesce("component", "id").alias("c"), (F.col("component").isNotNull() | F.col("loop").isNotNull()).alias("cyclic"))
    nodes = written(nodes, "condensed")
    of = lambda side: nodes.select(F.col("id").alias(side), F.col("c").alias(f"c{side}"))
    dag = written(edges.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "dag")
    found = nodes.select(F.col("c").alias("id")).distinct()
    own = lambda i: F.xxhash64("id", F.lit(i))
    sides = []
    for side, way in (("below", dag.select(F.col("b").alias("a"), F.col("a").alias("b"))), ("above", dag)):
        # a low end is kept as the negative of what spreads, as the largest value does; ~x is -x - 1 and doesn't overflow
        names = [f"{side}_{end}{i}" for i in range(NUMBERINGS) for end in ("low", "high")]
        seeds = found.select("id", *[(F.bitwise_not(own(i)) if end == "low" else own(i)).alias(f"{side}_{end}{i}") for i in range(NUMBERINGS) for end in ("low", "high")])
        sides.append(reach(way, seeds, names))
    labels = written(sides[0].join(sides[1], "id").withColumnRenamed("id", "c"), "labels")
    out = ReachIndex(written(nodes.join(labels, "c").select("id", "c", "cyclic", *_labels()), "reach-index"), dag)
    release(edges, strong, nodes, labels)
    return out


def _may(a: str, b: str) -> Column:
    """Whether labels let a reach b."""
    wider = [F.col(f"{a}.below_{end}{i}") >= F.col(f"{b}.below_{end}{i}") for i in range(NUMBERINGS) for end in ("low", "high")]
    within = [F.col(f"{a}.above_{end}{i}") <= F.col(f"{b}.above_{end}{i}") for i in range(NUMBERINGS) for end in ("low", "high")]
    return reduce(lambda x, y: x & y, wider + within)


def reachable(index: ReachIndex, pairs: DataFrame, most: int = 1000) -> DataFrame:
    """(a, b, reaches, decided) of asked pairs (a, b), each once: whether b is reached from a by one edge or more, a node on a cycle from itself too.

    decided is how: by component, by labels, or by search, which goes on from the nodes that the labels allow. A node that the graph doesn't have
    reaches nothing (absent).
    """
    spark, pairs = index.nodes.sparkSession, pairs.select("a", "b").distinct()
    with parted(spark, 2 * max(pairs.count(), index.nodes.count())):
        return _reachable(index, pairs, most)


def _reachable(index: ReachIndex, asked: DataFrame, most: int) -> DataFrame:
    at = index.nodes.select("id", F.struct("c", *_labels()).alias("l"), "cyclic")
    rows = asked.join(at.select(F.col("id").alias("a"), F.col("l").alias("la"), "cyclic"), "a", "left").join(at.select(F.col("id").alias("b"), F.col("l").alias("lb")), "b", "left")
    how = F.when(F.col("la").isNull() | F.col("lb").isNull(), "absent").when(F.col("la.c") == F.col("lb.c"), "component").when(~_may("la", "lb"), "labels").otherwise("search")
    rows = written(rows.select("a", "b", F.col("la.c").alias("ca"), "lb", "cyclic", how.alias("decided")), "asked")
    labels = index.nodes.select(F.col("c").alias("next"), F.struct("c", *_labels()).alias("ln")).dropDuplicates(["next"])
    ways = written(index.edges.select(F.col("a").alias("from"), F.col("b").alias("next")).join(labels, "next"), "ways")
    # pairs of components: several asked pairs are one search
    by = ["ca", "cb", "at"]
    goals = written(rows.filter("decided = 'search'").select("ca", F.col("lb.c").alias("cb"), "lb").distinct(), "goals")
    front = goals.select("ca", "cb", "lb", F.col("ca").alias("at"))
    seen, hits = [front.select(*by)], []

    def on(front: DataFrame) -> DataFrame:
        """The front's rows and what SEARCHED edges or fewer lead to, each once; late: not gone on from. A row at its goal isn't gone on from."""
        front = front.withColumn("late", F.lit(True))
        for _ in range(SEARCHED):
            step = front.join(ways, F.col("late") & (F.col("at") != F.col("cb")) & (F.col("at") == F.col("from")), "left")
            to = (F.col("next") == F.col("cb")) | _may("ln", "lb")
            ends = F.array(F.struct("at", F.lit(True).alias("own")), F.when(to, F.struct(F.col("next").alias("at"), F.lit(False).alias("own"))))
            step = step.select("ca", "cb", "lb", F.inline(F.array_compact(ends))).groupBy(*by).agg(F.any_value("lb").alias("lb"), F.max("own").alias("own"))
            front = step.select("ca", "cb", "lb", "at", (~F.col("own")).alias("late"))
        return front

    for _ in range(most):
        step = on(front)
        for old in seen:
            step = step.join(old, by, "left_anti")
        step = written(step, "searched")
        hit = step.filter(F.col("at") == F.col("cb")).select("ca", "cb")
        hits.append(hit)
        seen.append(step.select(*by))
        front = step.filter("late").drop("late").join(hit, ["ca", "cb"], "left_anti")
        if front.isEmpty():
            break
    else:
        raise RuntimeError("the search did not end")
    got = reduce(DataFrame.unionByName, hits).distinct().select("ca", "cb", F.lit(True).alias("hit"))
    rows = rows.withColumn("cb", F.col("lb.c")).join(got, ["ca", "cb"], "left")
    reaches = F.when(F.col("decided") == "component", F.col("cyclic")).otherwise(F.coalesce("hit", F.lit(False)))
    return rows.select("a", "b", reaches.alias("reaches"), "decided")
