"""Graph operators: seeds, adjacency, the bounded two-hop walk, evidence, opposition, closure, cycles and chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.index import bucket_of
from tessera.sources.store import parted, release, written

NODE_BUCKETS = 32  # of a stored adjacency
HOPS = 2  # times that a graph is trimmed before it is written
SPREAD = 8  # edges that a frontier is moved on before it is held against what is known
#: The caps of a walk, and of the evidence shown for an assertion.
MOST_SEEDS, MOST_DEPTH, PER_SEED, PER_WALK = 12, 2, 16, 128
SUPPORTS, CONTRADICTS = 2, 1
#: What two opposite assertions agree in; an absent modality is asserted.
OPPOSITION_KEY = ("subject_id", "predicate", "object_id", "literal_type", "literal_value", "property", "unit", "modality", "valid_from", "valid_until")


def adjacency(assertions: DataFrame) -> DataFrame:
    """(node, other, id, direction): each assertion under its subject (outgoing) and its object (incoming)."""
    end = lambda node, other, way: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), "id", F.lit(way).alias("direction"))
    ends = F.explode(F.array(end("subject_id", "object_id", "outgoing"), end("object_id", "subject_id", "incoming"))).alias("end")  # assertions are made once for both
    return assertions.select(ends).select("end.*").filter("direction = 'outgoing' or node is not null")


def neighbors(assertions: DataFrame, entity: str, k: int = PER_SEED) -> DataFrame:
    """Named neighbours: the first k assertions of each role by id, filtered before the cap; omitted counts the rest of a role."""
    near = adjacency(assertions).filter(F.col("node") == entity)
    total = near.groupBy("direction").agg(F.count("*").alias("total"))
    cut = [near.filter(F.col("direction") == d).orderBy("id").limit(k) for d in ("outgoing", "incoming")]
    return cut[0].unionByName(cut[1]).join(F.broadcast(total), "direction").select("node", "other", "id", "direction", F.greatest(F.col("total") - k, F.lit(0)).alias("omitted"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int = MOST_DEPTH, per_seed: int = PER_SEED, per_walk: int = PER_WALK) -> DataFrame:
    """(seed, seed_rank, id, hop, node, other, direction, path, rank) of edges admitted from at most MOST_SEEDS seeds (id, rank).

    edges are an adjacency(); a stored one (indexes.adjacency) is read by the buckets of the frontier's nodes alone.
    Breadth first; a seed takes an edge once and at most per_seed of them, nearer hops first, in a hop by round
    robin over frontier nodes and then id; the walk takes at most per_walk, by round robin over seeds. The frontier
    of the second hop is that of admitted edges, so rows are bounded by seeds times per_seed times their degree.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is 1..{MOST_DEPTH}")
    start = seeds.orderBy("rank").limit(MOST_SEEDS).select(F.col("id").alias("seed"), F.col("rank").alias("seed_rank"), F.col("id").alias("node"), F.lit(0).alias("frontier_rank"), F.array().cast("array<string>").alias("path"))
    found = None
    for hop in range(1, depth + 1):
        nodes = sorted({r["node"] for r in start.select("node").collect()})  # seeds, or seeds * per_seed nodes at most
        near = edges.filter(F.col("node").isin(nodes))
        if "bucket" in edges.columns:
            near = near.filter(F.col("bucket").isin(sorted({bucket_of(n, NODE_BUCKETS) for n in nodes}))).drop("bucket")
        step = near.join(F.broadcast(start), "node").withColumn("hop", F.lit(hop))
        if found is not None:
            step = step.join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        step = step.withColumn("turn", F.row_number().over(Window.partitionBy("seed", "node").orderBy("id", "direction"))).filter(F.col("turn") <= per_seed)
        once = Window.partitionBy("seed", "id").orderBy("turn", "frontier_rank", "direction")
        step = step.withColumn("n", F.row_number().over(once)).filter("n = 1")
        step = step.withColumn("admit", F.row_number().over(Window.partitionBy("seed").orderBy("turn", "frontier_rank", "id")))
        taken = F.lit(0)
        if found is not None:
            have = found.groupBy("seed").agg(F.count("*").alias("have"))
            step, taken = step.join(have, "seed", "left"), F.coalesce("have", F.lit(0))
        step = step.filter(F.col("admit") + taken <= per_seed)
        step = step.select("seed", "seed_rank", "id", "hop", "node", "other", "direction", F.array_append("path", F.col("id")).alias("path"), "admit")
        before, found = found, written(step if found is None else found.unionByName(step), "walk")
        reached = found.filter(F.col("hop") == hop).filter("other <> seed").groupBy("seed", "seed_rank", F.col("other").alias("node")).agg(F.min(F.struct("admit", "path")).alias("p"))
        visited = found.filter(F.col("hop") == hop).select("seed", "node").distinct()
        start = reached.join(visited, ["seed", "node"], "left_anti").select("seed", "seed_rank", "node", F.col("p.admit").alias("frontier_rank"), F.col("p.path").alias("path"))
        if before is not None:
            release(before)
    order = Window.partitionBy("seed").orderBy("hop", "admit")
    found = found.withColumn("turn", F.row_number().over(order))
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("turn", "seed_rank")))  # at most seeds * per_seed rows
    return ranked.filter(F.col("rank") <= per_walk).select("seed", "seed_rank", "id", "hop", "node", "other", "direction", "path", "rank")


def attach_evidence(ids: DataFrame, evidence: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(id, stance, evidence_id, omitted): current ones first, then by id; at most 2 supports and 1 contradiction of each assertion.

    omitted counts all evidence of the stance that isn't shown, that outside the sources too.
    """
    rows = evidence.join(ids.select(F.col("id").alias("assertion_id")), "assertion_id", "left_semi")
    inside = F.lit(True) if sources is None else F.coalesce(F.col("source_id").isin(*sources), F.lit(False))
    most = F.when(F.col("stance") == "supports", SUPPORTS).otherwise(CONTRADICTS)
    # rows are dealt by their assertion once and sorted once, those inside the sources first
    every = Window.partitionBy("assertion_id", "stance")
    rows = rows.select("assertion_id", "stance", "id", (~inside).alias("outside"), (F.col("eligibility") != "current").alias("later"))
    rows = rows.withColumn("n", F.row_number().over(every.orderBy("outside", "later", "id"))).withColumns({"total": F.count("*").over(every), "inside": F.count_if(~F.col("outside")).over(every)})
    shown = rows.filter(~F.col("outside") & (F.col("n") <= most))
    return shown.select("assertion_id", "stance", F.col("id").alias("evidence_id"), (F.col("total") - F.least("inside", most.cast("long"))).alias("omitted"))


def opposition_columns(assertions: DataFrame) -> DataFrame:
    """The assertions with all columns of OPPOSITION_KEY: absent ones are null, the modality asserted unless it says another."""
    for c in OPPOSITION_KEY:
        if c not in assertions.columns:
            assertions = assertions.withColumn(c, F.lit(None).cast("string"))
    return assertions.withColumn("modality", F.coalesce("modality", F.lit("asserted")))


def opposing(assertions: DataFrame, key: tuple[str, ...] = OPPOSITION_KEY) -> DataFrame:
    """(id, opposed): pairs with equal keys, nulls equal to nulls, and opposite negation."""
    assertions = opposition_columns(assertions)
    a = assertions.select(*[F.col(c).alias(f"a_{c}") for c in key], F.col("id").alias("id"), F.col("negated").alias("n"))
    b = assertions.select(*[F.col(c).alias(f"b_{c}") for c in key], F.col("id").alias("opposed"), F.col("negated").alias("m"))
    same = None
    for c in key:
        e = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        same = e if same is None else same & e
    return a.join(b, same & (F.col("n") != F.col("m"))).select("id", "opposed")


def links_of(records: DataFrame, links: DataFrame) -> DataFrame:
    """Navigation edges (a, b, kind): page links both ways, and provenance by fields named *_id or *_ids but the record's own."""
    both = links.select(F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).alias("e")).select("e.a", "e.b", F.lit("link").alias("kind"))
    named = records.select("id", F.explode("fields").alias("field", "value")).filter(F.col("field").rlike("_ids?$") & (F.col("field") != "id"))
    out = named.select(F.col("id").alias("a"), F.explode(F.split("value", ",")).alias("b"), F.col("field").alias("kind")).filter("a <> b")
    return both.unionByName(out)


def navigation(records: DataFrame, links: DataFrame) -> DataFrame:
    """(node, other, id, direction): page links (from_id, to_id) under both of their ends, and provenance, by fields of records (id, fields) named *_id or *_ids
    but the record's own, under the record. An edge's id tells its ends and its kind, so that a link is one edge from either side."""
    named = records.select("id", F.explode("fields").alias("field", "value")).filter(F.col("field").rlike("_ids?$") & (F.col("field") != "id"))
    out = named.select(F.col("id").alias("a"), F.explode(F.split("value", ",")).alias("b")).filter("a <> b").distinct()
    ident = lambda kind: F.concat("a", F.lit(">"), "b", F.lit(f":{kind}")).alias("id")
    both = links.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a <> b").distinct()
    away = both.select(F.col("a").alias("node"), F.col("b").alias("other"), ident("link"), F.lit("outgoing").alias("direction"))
    back = both.select(F.col("b").alias("node"), F.col("a").alias("other"), ident("link"), F.lit("incoming").alias("direction"))
    return away.unionByName(back).unionByName(out.select(F.col("a").alias("node"), F.col("b").alias("other"), ident("provenance"), F.lit("outgoing").alias("direction")))


def walk_navigated(edges: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = MOST_DEPTH, per_seed: int = PER_SEED, per_walk: int = PER_WALK) -> DataFrame:
    """(seed, seed_rank, id, kind, hop, node, other, direction, path, rank): walk() over assertions and navigation() under one quota.

    In each hop a seed first takes assertions, then navigation, of all its frontier's nodes in turn: per_seed edges of both kinds over all hops. What the seeds
    take is admitted in turns as well, until the walk has per_walk distinct edges of both kinds; one that another seed brought in costs the seed
    its place, not the walk. What isn't admitted leads nowhere. Both kinds give the next hop its nodes, assertions first; a path holds assertions only. A node is
    left once for each seed. All tables are of at most MOST_SEEDS * per_seed rows but the edges at the frontier, of which each node gives per_seed.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is 1..{MOST_DEPTH}")
    top = seeds.orderBy("rank").limit(MOST_SEEDS)
    start = top.select(F.col("id").alias("seed"), F.col("rank").alias("seed_rank"), F.col("id").alias("node"), F.lit(0).cast("long").alias("frontier_rank"), F.array().cast("array<string>").alias("path"))
    names = ["seed", "seed_rank", "id", "kind", "hop", "node", "other", "direction", "path", "stage", "admit"]
    found = None
    left = start.select("seed", "node")  # what each seed has left
    for hop in range(1, depth + 1):
        nodes = sorted({r["node"] for r in start.select("node").collect()})
        for stage, (kind, table) in enumerate((("assertion", edges), ("navigation", links)), 2 * hop):
            near = table.filter(F.col("node").isin(nodes))
            if "bucket" in table.columns:
                near = near.filter(F.col("bucket").isin(sorted({bucket_of(n, NODE_BUCKETS) for n in nodes}))).drop("bucket")
            step = near.select("node", "other", "id", "direction").join(F.broadcast(start), "node")
            taken = F.lit(0)
            if found is not None:
                step = step.join(found.select("seed", "id"), ["seed", "id"], "left_anti").join(found.groupBy("seed").agg(F.count("*").alias("have")), "seed", "left")
                taken = F.coalesce("have", F.lit(0))
            step = step.withColumn("turn", F.row_number().over(Window.partitionBy("seed", "node").orderBy("id", "direction"))).filter(F.col("turn") <= per_seed)
            step = step.withColumn("n", F.row_number().over(Window.partitionBy("seed", "id").orderBy("turn", "frontier_rank", "direction"))).filter("n = 1")
            step = step.withColumn("admit", F.row_number().over(Window.partitionBy("seed").orderBy("turn", "frontier_rank", "id"))).filter(F.col("admit") + taken <= per_seed)
            # of edges that are new to the walk the first ones, by turns of the seeds, as long as there is room
            fresh = step.groupBy("id").agg(F.min(F.struct("admit", "seed_rank")).alias("at"))
            room = per_walk
            if found is not None:
                room -= found.select("id").distinct().count()
                fresh = fresh.join(found.select("id").distinct(), "id", "left_anti")
            late = fresh.withColumn("n", F.row_number().over(Window.orderBy("at"))).filter(F.col("n") > room).select("id")
            path = F.array_append("path", F.col("id")) if kind == "assertion" else F.col("path")
            step = step.join(late, "id", "left_anti").select("seed", "seed_rank", "id", F.lit(kind).alias("kind"), F.lit(hop).alias("hop"), "node", "other", "direction", path.alias("path"), F.lit(stage).alias("stage"), "admit")
            before, found = found, written((step if found is None else found.unionByName(step)).select(*names), "walk")
            if before is not None:
                release(before)
        reached = found.filter(F.col("hop") == hop).groupBy("seed", "seed_rank", F.col("other").alias("node")).agg(F.min(F.struct("stage", "admit", "path")).alias("p"))
        reached = reached.join(left, ["seed", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("p.stage", "p.admit")).cast("long")
        start = written(reached.select("seed", "seed_rank", "node", rank.alias("frontier_rank"), F.col("p.path").alias("path")), "frontier")
        left = left.unionByName(start.select("seed", "node"))
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("stage", "admit", "seed_rank")))
    return ranked.select("seed", "seed_rank", "id", "kind", "hop", "node", "other", "direction", "path", "rank")


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(a, b) of all pairs such that b can be reached from a; doubling, each round's pairs in the shared folder."""
    pairs = written(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "closure")
    n = pairs.count()
    for _ in range(most):
        longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        before, pairs = pairs, written(pairs.unionByName(longer).distinct(), "closure")
        release(before)
        m = pairs.count()
        if m == n:
            return pairs
        n = m
    raise RuntimeError("the closure did not settle")


def reach(edges: DataFrame, seeds: DataFrame, value: str | list[str], most: int = 1000, known: DataFrame | None = None) -> DataFrame:
    """(id, value): the largest value of the seeds (id, value) that each id can be reached from along edges (a, b), a to b; of several values each its largest.

    A frontier of ids of which a value rose is moved SPREAD edges on in one job, then held against what is known and written. Edges stay dealt
    out and sorted by their start, so that a hop shuffles what it reaches and no more; only what rose in the last of the hops goes on. With
    `known` (id, value), values that the ids have already, only what rises above them goes on, and only that is returned.
    """
    values = [value] if isinstance(value, str) else value
    top = [F.max(v).alias(v) for v in values]
    with parted(edges.sparkSession, edges.count()) as n:
        return _reach(edges, seeds, values, top, most, known, n)


def _reach(edges: DataFrame, seeds: DataFrame, values: list[str], top: list[Column], most: int, known: DataFrame | None, n: int) -> DataFrame:
    # a number that is given stays, so that the hops' own partitions meet these
    dealt = edges.select("a", "b").repartition(n, "a").sortWithinPartitions("a").persist()

    def rose(new: DataFrame, old: list[DataFrame]) -> DataFrame:
        """What of the new values (with the column late, if there is one) is above the old ones: one aggregation of both."""
        late = [c for c in new.columns if c == "late"]
        none = [F.lit(None).cast(dict(seeds.dtypes)[v]) for v in values]
        rows = [new.select("id", *values, *[n.alias(f"_{v}") for v, n in zip(values, none, strict=True)], *late)]
        rows += [t.select("id", *[n.alias(v) for v, n in zip(values, none, strict=True)], *[F.col(v).alias(f"_{v}") for v in values], *[F.lit(False).alias(c) for c in late]) for t in old]
        both = reduce(DataFrame.unionByName, rows).groupBy("id").agg(*[F.max(c).alias(c) for c in [*[c for v in values for c in (v, f"_{v}")], *late]])
        more = reduce(lambda x, y: x | y, [F.col(v).isNotNull() & (F.col(f"_{v}").isNull() | (F.col(v) > F.col(f"_{v}"))) for v in values])
        return both.filter(more).select("id", *values, *late)

    def moved(front: DataFrame) -> DataFrame:
        """(id, value, late) of what SPREAD edges or fewer lead to: an id keeps its value beside those that reach it, and goes on if the edge before raised it (late)."""
        front = front.withColumn("late", F.lit(True))
        for _ in range(SPREAD):
            on = front.join(dealt, (F.col("id") == F.col("a")) & F.col("late"), "left")
            ends = F.explode(F.array(F.struct("id", F.lit(True).alias("own")), F.struct(F.col("b").alias("id"), F.lit(False).alias("own")))).alias("end")
            met = on.select(ends, *values).select("end.*", *values).filter("id is not null").groupBy("id").agg(*top, *[F.max(F.when(F.col("own"), F.col(v))).alias(f"_{v}") for v in values])
            late = reduce(lambda x, y: x | y, [F.col(v).isNotNull() & ~F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values])
            front = met.select("id", *values, late.alias("late"))
        return front

    given = [] if known is None else [known]
    seen = [written(rose(seeds, given), "reach")]
    front = seen[0]
    try:
        for _ in range(most):
            fresh = written(rose(moved(front), [*given, *seen]), "reach")
            seen.append(fresh)
            front = fresh.filter("late").drop("late")
            if front.isEmpty():
                return reduce(DataFrame.unionByName, [t.select("id", *values) for t in seen]).groupBy("id").agg(*top)
            if len(seen) > 8:
                older = written(reduce(DataFrame.unionByName, [t.select("id", *values) for t in seen[:-1]]).groupBy("id").agg(*top), "reach")
                release(*seen[:-1])
                seen = [older, fresh]
    finally:
        dealt.unpersist()
    raise RuntimeError("values did not settle")


def strong_components(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(id, component) of the nodes of strongly connected components of several nodes; component is one of them.

    Nodes without an edge in or out are trimmed until none is left. Then every node takes the largest node that reaches it as its
    color, and what reaches that node inside the color is its component; components leave the graph and the rest goes on.
    Rows are those of the graph, never pairs of nodes. Rounds follow the longest shortest path, SPREAD edges each.
    """
    rest = written(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "cycles")
    left = rest.count()
    with parted(rest.sparkSession, left):
        return _strong_components(rest, left, most)


def _strong_components(rest: DataFrame, left: int, most: int) -> DataFrame:
    found = [rest.limit(0).select(F.col("a").alias("id"), F.col("b").alias("component"))]
    for _ in range(most):
        while left:
            trimmed = rest
            for _ in range(HOPS):
                trimmed = trimmed.join(trimmed.select(F.col("b").alias("a")), "a", "left_semi").join(trimmed.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
            before, rest = rest, written(trimmed, "cycles")
            release(before)
            now = rest.count()
            if now == left:
                break
            left = now
        if not left:
            return reduce(DataFrame.unionByName, found)
        color = reach(rest, rest.select(F.col("a").alias("id"), F.col("a").alias("color")), "color")
        of = lambda side: color.select(F.col("id").alias(side), F.col("color").alias(f"{side}_color"))
        inside = written(rest.join(of("a"), "a").join(of("b"), "b").filter("a_color = b_color").select("a", "b", F.col("a_color").alias("color")), "inside")
        back = inside.select(F.col("b").alias("a"), F.col("a").alias("b"))  # an edge back stays in its color, so a root's mark does
        whole = written(reach(back, color.filter("id = color").select("id", F.lit(1).alias("one")), "one").select("id"), "members")
        member = inside.join(whole.withColumnRenamed("id", "a"), "a", "left_semi").join(whole.withColumnRenamed("id", "b"), "b", "left_semi")
        found.append(written(member.select(F.explode(F.array("a", "b")).alias("id"), F.col("color").alias("component")).distinct(), "components"))
        before, rest = rest, written(rest.join(whole.withColumnRenamed("id", "a"), "a", "left_anti").join(whole.withColumnRenamed("id", "b"), "b", "left_anti"), "cycles")
        release(before, inside, whole)
        left = rest.count()
    raise RuntimeError("components did not settle")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(id) of nodes on a cycle: those of strong_components(), and those with an edge to themselves."""
    return strong_components(edges).select("id").unionByName(edges.filter("a = b").select(F.col("a").alias("id"))).distinct()


def longest_chains(edges: DataFrame, limit: int = 64) -> DataFrame:
    """(id, length): edges on the longest path from each node of an acyclic graph, capped at limit + 1; level by level."""
    level = written(edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().withColumn("length", F.lit(0)), "chain")
    for step in range(1, limit + 2):
        grown = edges.join(level.filter(F.col("length") == step - 1).select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).distinct().withColumn("grown", F.lit(step))
        nxt = written(level.join(grown, "id", "left").select("id", F.coalesce("grown", "length").alias("length")), "chain")
        release(level)
        if nxt.filter(F.col("length") == step).isEmpty():
            return nxt
        level = nxt
    return level


def topological(edges: DataFrame, nodes: DataFrame, limit: int = 10_000) -> list[str]:
    """Order of a change's operations (at most limit, with 16 times as many edges): the smallest id that waits for nothing comes first. a waits for b."""
    import heapq

    ids = [r[0] for r in nodes.limit(limit + 1).collect()]
    if len(ids) > limit:
        raise ValueError(f"more than {limit} operations")
    waits, after = {i: 0 for i in ids}, {i: [] for i in ids}
    pairs = edges.select("a", "b").distinct().limit(16 * limit + 1).collect()
    if len(pairs) > 16 * limit:
        raise ValueError(f"more than {16 * limit} dependencies")
    for r in pairs:
        waits[r["a"]] += 1
        after[r["b"]].append(r["a"])
    ready, out = [i for i in ids if not waits[i]], []
    heapq.heapify(ready)
    while ready:
        out.append(heapq.heappop(ready))
        for i in after[out[-1]]:
            waits[i] -= 1
            if not waits[i]:
                heapq.heappush(ready, i)
    if len(out) < len(ids):
        raise ValueError("the operations wait for each other")
    return out
