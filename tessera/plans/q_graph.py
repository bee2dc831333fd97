"""Queries over the knowledge graph of the star tables: adjacency, walks, evidence, support, opposition, closure, remaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog, dense, eligibility, filters, graph, references
from tessera.operators.reachability import reachable
from tessera.plans import indexes
from tessera.plans.q_search import COS_SQL, _vector
from tessera.plans.registry import query
from tessera.sources import model
from tessera.sources.model import ASSERTIONS_SQL, ENTITIES_SQL, EVIDENCE_SQL

STATE_SQL = "CASE WHEN status = 'retracted' THEN 'historical' WHEN withdrawn THEN 'withdrawn' WHEN older THEN 'historical' ELSE 'current' END"
SUPPORT_SQL = f"""{ASSERTIONS_SQL}, {EVIDENCE_SQL}, ev AS (SELECT *, {STATE_SQL} AS state FROM evidence),
sm AS (SELECT assertion_id, bool_or(stance = 'supports' AND state = 'current') AS cur, bool_or(stance = 'supports' AND older AND status = 'active' AND NOT withdrawn) AS old, bool_or(stance = 'contradicts' AND state = 'current') AS dis FROM ev GROUP BY assertion_id),
sp AS (SELECT a.*, CASE WHEN coalesce(cur, false) THEN 'current' WHEN coalesce(old, false) THEN 'stale' ELSE 'unsupported' END AS eligibility, coalesce(dis, false) AS disputed FROM assertions a LEFT JOIN sm ON id = assertion_id)"""
ADJ_SQL = f"""{ASSERTIONS_SQL}, adj AS (SELECT subject_id AS node, object_id AS other, id, 'outgoing' AS direction FROM assertions UNION ALL SELECT object_id, subject_id, id, 'incoming' FROM assertions WHERE object_id IS NOT NULL)"""


@query("graph_degree", f"WITH {ADJ_SQL} SELECT node, count(*) FILTER (direction = 'outgoing') AS outgoing, count(*) FILTER (direction = 'incoming') AS incoming FROM adj GROUP BY node")
def graph_degree(spark, sf):
    a = graph.adjacency(model.assertions(spark, sf))
    return a.groupBy("node").agg(F.count_if(F.col("direction") == "outgoing").alias("outgoing"), F.count_if(F.col("direction") == "incoming").alias("incoming"))


@query(
    "graph_neighbors",
    f"""WITH {ADJ_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY id) AS rn, count(*) OVER (PARTITION BY direction) AS total FROM adj WHERE node = 'supplier_3')
SELECT node, other, id, direction, greatest(total - 16, 0) AS omitted FROM n WHERE rn <= 16""",
)
def graph_neighbors(spark, sf):
    return graph.neighbors(model.assertions(spark, sf), "supplier_3")


def _seeds(spark):
    return spark.createDataFrame([("nation_1", 1), ("supplier_2", 2), ("part_5", 3), ("region_0", 4)], "id string, rank int")


WALK_SQL = f"""WITH {ADJ_SQL}, sd(seed, seed_rank) AS (VALUES ('nation_1', 1), ('supplier_2', 2), ('part_5', 3), ('region_0', 4)),
h1a AS (SELECT seed, seed_rank, node, other, id, direction, row_number() OVER (PARTITION BY seed, node ORDER BY id, direction) AS turn FROM adj JOIN sd ON node = seed QUALIFY turn <= 16),
h1b AS (SELECT * FROM h1a QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY turn, direction) = 1),
h1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY turn, id) AS admit FROM h1b QUALIFY admit <= 16),
fr AS (SELECT seed, seed_rank, other AS node, min(admit) AS frontier_rank, arg_min(id, admit) AS via FROM h1 WHERE other <> seed GROUP BY ALL),
h2a AS (SELECT fr.seed, fr.seed_rank, adj.node, adj.other, adj.id, adj.direction, frontier_rank, via, row_number() OVER (PARTITION BY fr.seed, adj.node ORDER BY adj.id, adj.direction) AS turn
  FROM adj JOIN fr USING (node) WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = fr.seed AND h1.id = adj.id) QUALIFY turn <= 16),
h2b AS (SELECT * FROM h2a QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY turn, frontier_rank, direction) = 1),
h2c AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY turn, frontier_rank, id) AS admit FROM h2b),
h2 AS (SELECT h2c.* FROM h2c LEFT JOIN (SELECT seed, count(*) AS have FROM h1 GROUP BY seed) USING (seed) WHERE admit + coalesce(have, 0) <= 16),
al AS (SELECT seed, seed_rank, id, 1 AS hop, node, other, direction, admit, id AS path FROM h1 UNION ALL SELECT seed, seed_rank, id, 2, node, other, direction, admit, via || ' / ' || id FROM h2),
tn AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, admit) AS turn FROM al), rk AS (SELECT *, row_number() OVER (ORDER BY turn, seed_rank) AS rank FROM tn)
SELECT """


@query("graph_walk", f"{WALK_SQL} seed, id, hop, node, other, direction, rank FROM rk WHERE rank <= 40")
def graph_walk(spark, sf):
    out = graph.walk(indexes.adjacency(spark, sf), _seeds(spark), per_walk=40)
    return out.select("seed", "id", "hop", "node", "other", "direction", F.col("rank").cast("long").alias("rank"))


@query("graph_walk_paths", f"{WALK_SQL} seed, id, hop, path, rank FROM rk WHERE rank <= 128")
def graph_walk_paths(spark, sf):
    out = graph.walk(indexes.adjacency(spark, sf), _seeds(spark))
    return out.select("seed", "id", "hop", F.array_join("path", " / ").alias("path"), F.col("rank").cast("long").alias("rank"))


@query("graph_walk_navigated")
def graph_walk_navigated(spark, sf):
    """Assertions and navigation from the seeds under one quota; suppliers' pages link to those of the parts that they return, parts and customers refer to others."""
    t = lambda name: model.table(spark, sf, name)
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    links = t("lineitem").filter("l_returnflag = 'R'").select(s("supplier_", F.col("l_suppkey")).alias("from_id"), s("part_", F.col("l_partkey")).alias("to_id"))
    part = t("part").select(s("part_", F.col("p_partkey")).alias("id"), F.create_map(F.lit("successor_id"), s("part_", F.col("p_partkey") + 1), F.lit("name"), F.lit("x")).alias("fields"))
    customer = t("customer").select(s("customer_", F.col("c_custkey")).alias("id"), F.create_map(F.lit("nation_ids"), s("nation_", F.col("c_nationkey")), F.lit("name"), F.lit("x")).alias("fields"))
    nation = t("nation").select(s("nation_", F.col("n_nationkey")).alias("id"), F.create_map(F.lit("region_id"), s("region_", F.col("n_regionkey")), F.lit("id"), F.lit("x")).alias("fields"))
    seeds = spark.createDataFrame([("customer_7", 1), ("region_0", 2), ("part_5", 3), ("supplier_2", 4)], "id string, rank int")
    out = graph.walk_navigated(indexes.adjacency(spark, sf), graph.navigation(part.unionByName(customer).unionByName(nation), links), seeds)
    return out.select("seed", "id", "kind", "hop", "node", "other", F.array_join("path", " / ").alias("path"), F.col("rank").cast("long").alias("rank"))


@query(
    "graph_seeds",
    f"""WITH {ENTITIES_SQL}, q AS (SELECT id, title, CASE WHEN id = 'nation_3' THEN 0 WHEN lower(title) = lower((SELECT n_name FROM nation WHERE n_nationkey = 3)) THEN 1 ELSE 2 END AS tier FROM entities WHERE id = 'nation_3' OR contains(lower(title), lower((SELECT n_name FROM nation WHERE n_nationkey = 3))))
SELECT id, title, tier FROM q ORDER BY tier, id LIMIT 12""",
)
def graph_seeds(spark, sf):
    name = model.table(spark, sf, "nation").filter("n_nationkey = 3").first()["n_name"].lower()
    e = model.entities(spark, sf).withColumn("tier", F.when(F.col("id") == "nation_3", 0).when(F.lower("title") == name, 1).when(F.contains(F.lower("title"), F.lit(name)), 2))
    return e.filter("tier is not null").orderBy("tier", "id").limit(graph.MOST_SEEDS).select("id", "title", "tier")


@query("graph_policy", f"WITH {SUPPORT_SQL} SELECT predicate, count(*) FILTER (eligibility = 'current' AND status = 'accepted') AS plain, count(*) FILTER (eligibility IN ('current', 'historical', 'stale')) AS everything FROM sp GROUP BY predicate")
def graph_policy(spark, sf):
    s = eligibility.support(model.assertions(spark, sf), model.evidence(spark, sf))
    return s.groupBy("predicate").agg(F.count_if(filters.graph_policy()).alias("plain"), F.count_if(filters.graph_policy(True, True)).alias("everything"))


@query(
    "evidence_attached",
    f"""WITH {EVIDENCE_SQL}, ev AS (SELECT *, {STATE_SQL} AS eligibility FROM evidence),
t AS (SELECT assertion_id, stance, count(*) AS total FROM ev GROUP BY ALL),
s AS (SELECT * FROM ev WHERE source_id IN ('src_1', 'src_2', 'src_3', 'src_4', 'src_5', 'src_6', 'src_7', 'src_8', 'src_9', 'src_11', 'src_12', 'src_13', 'src_14') QUALIFY row_number() OVER (PARTITION BY assertion_id, stance ORDER BY eligibility <> 'current', id) <= CASE WHEN stance = 'supports' THEN 2 ELSE 1 END),
c AS (SELECT assertion_id, stance, count(*) AS shown FROM s GROUP BY ALL)
SELECT assertion_id, stance, id AS evidence_id, total - shown AS omitted FROM s JOIN t USING (assertion_id, stance) JOIN c USING (assertion_id, stance)""",
)
def evidence_attached(spark, sf):
    ev = model.evidence(spark, sf).withColumn("eligibility", eligibility.evidence_state())
    ids = model.assertions(spark, sf).select("id")
    return graph.attach_evidence(ids, ev, [f"src_{i}" for i in range(1, 15) if i != 10])


@query("evidence_states", f"WITH {EVIDENCE_SQL} SELECT {STATE_SQL} AS state, stance, count(*) AS n FROM evidence GROUP BY ALL")
def evidence_states(spark, sf):
    return model.evidence(spark, sf).groupBy(eligibility.evidence_state().alias("state"), "stance").agg(F.count("*").alias("n"))


@query("assertion_support", f"WITH {SUPPORT_SQL} SELECT id, status, eligibility, disputed FROM sp WHERE predicate = 'uses'")
def assertion_support(spark, sf):
    return eligibility.support(model.assertions(spark, sf).filter("predicate = 'uses'"), model.evidence(spark, sf)).select("id", "status", "eligibility", "disputed")


def _two_sided(spark, sf):
    """Ratings of parts by suppliers: both polarities occur, and some objects, properties, dates and modalities are null."""
    li = model.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    p = F.col("l_partkey")
    return li.select(
        F.concat(F.lit("c_"), F.col("l_suppkey").cast("string"), F.lit("_"), p.cast("string"), F.lit("_"), "l_returnflag").alias("id"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("subject_id"),
        F.lit("rates").alias("predicate"),
        F.when(p % 40 != 0, F.concat(F.lit("part_"), F.floor(p / 4).cast("string"))).alias("object_id"),
        F.when(p % 3 == 0, "grade").alias("property"),
        F.when(p % 2 == 0, "asserted").when(p % 7 == 1, "possible").alias("modality"),
        F.when(p % 5 == 0, "2020-01-01").alias("valid_from"),
        (F.col("l_returnflag") == "R").alias("negated"),
        F.when(F.col("l_returnflag") == "A", "proposed").otherwise("accepted").alias("status"),
        F.when(p % 7 == 0, "stale").otherwise("current").alias("eligibility"),
        F.lit(False).alias("disputed"),
    )


TWO_SQL = """tw AS (SELECT DISTINCT 'c_' || l_suppkey || '_' || l_partkey || '_' || l_returnflag AS id, 'supplier_' || l_suppkey AS subject_id, 'rates' AS predicate, CASE WHEN l_partkey % 40 <> 0 THEN 'part_' || (l_partkey // 4) END AS object_id,
  CASE WHEN l_partkey % 3 = 0 THEN 'grade' END AS property, CASE WHEN l_partkey % 2 = 0 THEN 'asserted' WHEN l_partkey % 7 = 1 THEN 'possible' ELSE 'asserted' END AS modality, CASE WHEN l_partkey % 5 = 0 THEN '2020-01-01' END AS valid_from,
  l_returnflag = 'R' AS negated, CASE WHEN l_returnflag = 'A' THEN 'proposed' ELSE 'accepted' END AS status, CASE WHEN l_partkey % 7 = 0 THEN 'stale' ELSE 'current' END AS eligibility FROM lineitem)"""
SAME_SQL = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("subject_id", "object_id", "property", "modality", "valid_from"))


@query(
    "opposition_marked",
    f"""WITH {TWO_SQL}, b AS (SELECT subject_id, object_id, property, modality, valid_from, bool_or(negated) AND bool_or(NOT negated) AS sides FROM tw WHERE eligibility = 'current' AND status = 'accepted' GROUP BY ALL)
SELECT a.id, eligibility, coalesce(sides, false) AND eligibility = 'current' AND status = 'accepted' AS disputed FROM tw a LEFT JOIN b ON {SAME_SQL}""",
)
def opposition_marked(spark, sf):
    return eligibility.mark_opposed(_two_sided(spark, sf)).select("id", "eligibility", "disputed")


@query("opposing_pairs", f"WITH {TWO_SQL} SELECT a.id, b.id AS opposed FROM tw a JOIN tw b ON {SAME_SQL} AND a.negated <> b.negated")
def opposing_pairs(spark, sf):
    return graph.opposing(_two_sided(spark, sf))


def _deps(spark, sf):
    """Records of orders: each depends on that of half its number and, in parts, on a third; few are missing or invalid."""
    o = model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"))
    records = o.filter("n % 97 <> 5").select(F.col("n").alias("id"), F.when(F.col("n") % 101 == 7, "invalid").when(F.col("n") % 53 == 9, "withdrawn").otherwise("current").alias("eligibility"))
    edges = o.filter("n > 3").select(F.col("n").alias("id"), F.floor(F.col("n") / 2).alias("depends_on")).unionByName(o.filter("n % 3 = 0 and n > 8").select(F.col("n").alias("id"), F.floor(F.col("n") / 3).alias("depends_on")))
    return records, edges


DEPS_SQL = """n AS (SELECT o_orderkey AS n FROM orders), rec AS (SELECT n AS id, CASE WHEN n % 101 = 7 THEN 'invalid' WHEN n % 53 = 9 THEN 'withdrawn' ELSE 'current' END AS eligibility FROM n WHERE n % 97 <> 5),
ed AS (SELECT n AS id, n // 2 AS depends_on FROM n WHERE n > 3 UNION ALL SELECT n, n // 3 FROM n WHERE n % 3 = 0 AND n > 8)"""


@query(
    "dependency_fixpoint",
    f"""WITH RECURSIVE {DEPS_SQL},
bad(id) AS (SELECT id FROM rec WHERE eligibility = 'invalid' UNION SELECT e.id FROM ed e JOIN rec USING (id) WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.id = e.depends_on) UNION SELECT e.id FROM bad b JOIN ed e ON e.depends_on = b.id JOIN rec r ON r.id = e.id),
soft(id) AS (SELECT id FROM rec WHERE eligibility <> 'current' UNION SELECT id FROM bad UNION SELECT e.id FROM soft s JOIN ed e ON e.depends_on = s.id JOIN rec r ON r.id = e.id)
SELECT id, CASE WHEN id IN (FROM bad) THEN 'invalid' WHEN eligibility = 'current' AND id IN (FROM soft) THEN 'stale' ELSE eligibility END AS eligibility FROM rec""",
)
def dependency_fixpoint(spark, sf):
    return eligibility.dependency_fixpoint(*_deps(spark, sf))


@query(
    "invalid_propagated",
    f"""WITH RECURSIVE {DEPS_SQL}, rf AS (SELECT id, depends_on AS target FROM ed WHERE id % 4 <> 0),
bad(id) AS (SELECT id FROM rec WHERE eligibility = 'invalid' UNION SELECT rf.id FROM bad JOIN rf ON rf.target = bad.id JOIN rec r ON r.id = rf.id)
SELECT id, id IN (FROM bad) AS invalid FROM rec""",
)
def invalid_propagated(spark, sf):
    records, edges = _deps(spark, sf)
    refs = edges.select("id", F.col("depends_on").alias("target"), (F.col("id") % 4 == 0).alias("identity_only"))
    return eligibility.propagate_invalid(records.select("id", (F.col("eligibility") == "invalid").alias("invalid")), refs)


CHANGED_FROM = 700  # what hangs on the first orders is nearly all


def _changed_deps(spark, sf):
    """_deps() after a change of one in a hundred behind the first CHANGED_FROM: some records become invalid, current or go, some come, and some depend on another one."""
    records, edges = _deps(spark, sf)
    n, o = F.col("id"), model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    late = f"id > {CHANGED_FROM} and"
    now = F.when((n > CHANGED_FROM) & (n % 300 == 17), F.when(F.col("eligibility") == "current", "invalid").otherwise("current")).otherwise(F.col("eligibility"))
    new = records.filter(f"not ({late} id % 1200 = 29)").select("id", now.alias("eligibility")).unionByName(o.filter(f"{late} id % 97 = 5 and id % 4 = 1").select("id", F.lit("current").alias("eligibility")))
    moved = edges.filter(f"not ({late} id % 600 = 41)").unionByName(edges.filter(f"{late} id % 600 = 41").select("id", F.floor(F.col("depends_on") / 3).alias("depends_on")))
    changed = o.filter(f"{late} (id % 300 = 17 or id % 1200 = 29 or id % 600 = 41 or (id % 97 = 5 and id % 4 = 1))")
    return new, moved, changed


FIX_SQL = """bad(id) AS (SELECT id FROM rec WHERE eligibility = 'invalid' UNION SELECT e.id FROM ed e JOIN rec USING (id) WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.id = e.depends_on) UNION SELECT e.id FROM bad b JOIN ed e ON e.depends_on = b.id JOIN rec r ON r.id = e.id),
soft(id) AS (SELECT id FROM rec WHERE eligibility <> 'current' UNION SELECT id FROM bad UNION SELECT e.id FROM soft s JOIN ed e ON e.depends_on = s.id JOIN rec r ON r.id = e.id),
fix AS (SELECT id, CASE WHEN id IN (FROM bad) THEN 'invalid' WHEN eligibility = 'current' AND id IN (FROM soft) THEN 'stale' ELSE eligibility END AS eligibility FROM rec)"""


@query(
    "fixpoint_refreshed",
    f"""WITH RECURSIVE {DEPS_SQL.replace("rec AS", "rec0 AS").replace("ed AS", "ed0 AS")},
rec AS (SELECT id, CASE WHEN id > {CHANGED_FROM} AND id % 300 = 17 THEN CASE WHEN eligibility = 'current' THEN 'invalid' ELSE 'current' END ELSE eligibility END AS eligibility FROM rec0 WHERE NOT (id > {CHANGED_FROM} AND id % 1200 = 29) UNION ALL SELECT n, 'current' FROM n WHERE n > {CHANGED_FROM} AND n % 97 = 5 AND n % 4 = 1),
ed AS (SELECT id, CASE WHEN id > {CHANGED_FROM} AND id % 600 = 41 THEN depends_on // 3 ELSE depends_on END AS depends_on FROM ed0), {FIX_SQL}
SELECT id, eligibility FROM fix""",
)
def fixpoint_refreshed(spark, sf):
    """The fixpoint after a change, from the stored one before it and what depends on the change."""
    records, edges, changed = _changed_deps(spark, sf)
    before = indexes.badness(spark, sf, lambda: _deps(spark, sf))
    touched = eligibility.refreshed_badness(before, records, edges, changed)
    return eligibility.judged(records, before.join(touched, "id", "left_anti").unionByName(touched))


CHAIN_SQL = """ch AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 8 <> 7 UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 16 = 6 UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 50 = 0)"""


def _chain(spark, sf):
    """Chains of eight customers each; every other chain has a cycle of four, and some customers lead to themselves."""
    c, all_ = F.col("c_custkey"), model.table(spark, sf, "customer")
    return all_.filter("c_custkey % 8 <> 7").select(c.alias("a"), (c + 1).alias("b")).unionByName(all_.filter("c_custkey % 16 = 6").select(c.alias("a"), (c - 3).alias("b"))).unionByName(all_.filter("c_custkey % 50 = 0").select(c.alias("a"), c.alias("b")))


@query("reachability", f"WITH RECURSIVE {CHAIN_SQL}, r AS (FROM ch UNION SELECT r.a, ch.b FROM r JOIN ch ON r.b = ch.a) SELECT a, b FROM r")
def reachability(spark, sf):
    return graph.closure(_chain(spark, sf))


def _tangle(spark, sf):
    """Orders by number: two of three are a component (each leads to two, as binary numbers are shifted), the others lead to a third of their number."""
    n = F.col("o_orderkey")
    o = model.table(spark, sf, "orders").select(n, (F.floor(n / 3) * 2 + n % 3).alias("r"))
    size = model.table(spark, sf, "orders").agg((2 * F.floor((F.max(n) - 2) / 3)).alias("m"))
    inside = o.filter("o_orderkey % 3 <> 2").join(F.broadcast(size)).filter("r < m")
    number = lambda r: F.floor(r / 2) * 3 + r % 2
    shifted = [inside.select(n.alias("a"), number((2 * F.col("r") + i) % F.col("m")).alias("b")) for i in (0, 1)]
    tail = o.filter("o_orderkey % 3 = 2").select(n.alias("a"), F.floor(n / 3).alias("b"))
    return shifted[0].unionByName(shifted[1]).unionByName(tail)


@query(
    "reachability_asked",
    """WITH RECURSIVE m AS (SELECT 2 * ((max(o_orderkey) - 2) // 3) AS m FROM orders), n AS (SELECT o_orderkey AS n, o_orderkey // 3 * 2 + o_orderkey % 3 AS r FROM orders),
com AS (SELECT n FROM n, m WHERE n % 3 <> 2 AND r < m), tails AS (SELECT n AS a, n // 3 AS b FROM n WHERE n % 3 = 2),
dag AS (SELECT CASE WHEN a IN (FROM com) THEN -1 ELSE a END AS a, CASE WHEN b IN (FROM com) THEN -1 ELSE b END AS b FROM tails),
up AS (SELECT a, b FROM dag UNION SELECT up.a, dag.b FROM up JOIN dag ON dag.a = up.b),
asked AS (SELECT o_orderkey AS a, o_orderkey // 7 * 2 + 2 AS b FROM orders UNION SELECT o_orderkey, o_orderkey // 9 FROM orders),
c AS (SELECT a, b, CASE WHEN a IN (FROM com) THEN -1 ELSE a END AS ca, CASE WHEN b IN (FROM com) THEN -1 ELSE b END AS cb FROM asked)
SELECT c.a, c.b, (ca = -1 AND cb = -1) OR EXISTS (SELECT 1 FROM up WHERE up.a = ca AND up.b = cb) AS reaches FROM c""",
)
def reachability_asked(spark, sf):
    """Asked pairs against an index of a graph with a component of two thirds of the orders."""
    index = indexes.reach(spark, sf, lambda: _tangle(spark, sf))
    o, n = model.table(spark, sf, "orders"), F.col("o_orderkey")
    pairs = o.select(n.alias("a"), (F.floor(n / 7) * 2 + 2).alias("b")).unionByName(o.select(n.alias("a"), F.floor(n / 9).alias("b")))
    return reachable(index, pairs).select("a", "b", "reaches")


@query("cycle_members", f"WITH RECURSIVE {CHAIN_SQL}, r AS (FROM ch UNION SELECT r.a, ch.b FROM r JOIN ch ON r.b = ch.a) SELECT a AS id FROM r WHERE a = b")
def cycle_members(spark, sf):
    return graph.cycle_members(_chain(spark, sf))


@query(
    "longest_chains",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 10 = 0 AND p_partkey > 3),
r AS (SELECT a AS id, b AS at, 1 AS n FROM e UNION SELECT r.id, e.b, n + 1 FROM r JOIN e ON r.at = e.a),
ids AS (SELECT a AS id FROM e UNION SELECT b FROM e)
SELECT id, coalesce(max(n), 0)::INTEGER AS length FROM ids LEFT JOIN r USING (id) GROUP BY id""",
)
def longest_chains(spark, sf):
    p = F.col("p_partkey")
    part = model.table(spark, sf, "part")
    edges = part.filter("p_partkey > 1").select(p.alias("a"), F.floor(p / 2).alias("b")).unionByName(part.filter("p_partkey % 10 = 0 and p_partkey > 3").select(p.alias("a"), (p - 3).alias("b")))
    return graph.longest_chains(edges)


@query("navigation_edges", "SELECT 'order_' || o_orderkey AS a, 'customer_' || o_custkey AS b, 'customer_id' AS kind FROM orders UNION ALL SELECT 'order_' || o_orderkey, 'order_' || (o_orderkey // 2), 'link' FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT 'order_' || (o_orderkey // 2), 'order_' || o_orderkey, 'link' FROM orders WHERE o_orderkey % 100 = 0")
def navigation_edges(spark, sf):
    o = model.table(spark, sf, "orders")
    ident = lambda c: F.concat(F.lit("order_"), c.cast("string"))
    records = o.select(ident(F.col("o_orderkey")).alias("id"), F.create_map(F.lit("customer_id"), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")), F.lit("id"), F.lit("x"), F.lit("note"), F.lit("y")).alias("fields"))
    links = o.filter("o_orderkey % 100 = 0").select(ident(F.col("o_orderkey")).alias("from_id"), ident(F.floor(F.col("o_orderkey") / 2)).alias("to_id"))
    return graph.links_of(records, links)


@query("reference_errors", "WITH r AS (SELECT 'order_' || o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN 'customer_' || (o_custkey + 1000000) ELSE 'customer_' || o_custkey END AS target, o_orderkey % 17 = 4 AS wrong FROM orders) SELECT r.id, 'customer_id' AS field, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'kind' END AS reason FROM r LEFT JOIN customer ON target = 'customer_' || c_custkey WHERE c_custkey IS NULL OR wrong")
def reference_errors(spark, sf):
    o, k = model.table(spark, sf, "orders"), F.col("o_orderkey")
    far = F.when(k % 10 == 3, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    refs = o.select(F.concat(F.lit("order_"), k.cast("string")).alias("id"), F.lit("customer_id").alias("field"), F.concat(F.lit("customer_"), far.cast("string")).alias("target"), F.when(k % 17 == 4, "supplier").otherwise("customer").alias("kind"), F.lit(None).cast("string").alias("owner"))
    records = model.entities(spark, sf).filter("entity_type = 'customer'").select("id", F.col("entity_type").alias("kind"), F.lit(None).cast("string").alias("owner"))
    return eligibility.check_references(refs, records)


# Records of the kinds that refer to others: a source and a revision for each customer, and extractions, packets and evidence of orders.
REFS_SQL = """c AS (SELECT c_custkey AS k, c_custkey % 7 AS m FROM customer), o AS (SELECT o_orderkey AS n, o_custkey AS k FROM orders),
rec AS (
  SELECT 's' || k AS id, 'source' AS kind, CASE WHEN m = 1 THEN 'r' || (k + 1) ELSE 'r' || k END AS current_revision, CASE m WHEN 2 THEN ['r' || k, 'r' || k] WHEN 3 THEN ['r' || k, 'r' || (k + 1)] ELSE ['r' || k] END AS revisions,
    NULL AS source_id, NULL AS source_revision, []::VARCHAR[] AS source_ids, []::VARCHAR[] AS source_revision_ids, NULL AS supersedes_id, NULL AS assertion_id, NULL AS span_start, NULL AS span_end FROM c UNION ALL
  SELECT 'r' || k, 'revision', NULL, [], CASE WHEN m = 4 THEN 's' || (k - 1) ELSE 's' || k END, NULL, [], [], NULL, NULL, NULL, NULL FROM c UNION ALL
  SELECT 'x' || n, 'extraction', NULL, [], NULL, NULL, CASE WHEN n % 9 = 4 THEN ['s' || k, 's' || (k + 2)] ELSE ['s' || k] END, CASE WHEN n % 11 = 5 THEN ['r' || (k + 3)] ELSE ['r' || k] END, NULL, NULL, NULL, NULL FROM o UNION ALL
  SELECT 'p' || n, 'extraction_packet', NULL, [], 's' || k, 'r' || (k + CASE WHEN n % 13 = 6 THEN 1 ELSE 0 END), [], [], NULL, NULL, NULL, NULL FROM o UNION ALL
  SELECT 'e' || n, 'evidence', NULL, [], 's' || k % 5, 'r' || n % 2, [], [], CASE WHEN n > 6 THEN 'e' || (n - 6) END, 'a' || n % 3, (n // 50)::VARCHAR, (n // 40)::VARCHAR FROM o)"""


def _referring(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = model.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).alias("m"))
    o = model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("k"))
    k, m, n = F.col("k"), F.col("m"), F.col("n")
    source = c.select(s("s", k).alias("id"), F.lit("source").alias("kind"), s("r", F.when(m == 1, k + 1).otherwise(k)).alias("current_revision"), F.when(m == 2, F.array(s("r", k), s("r", k))).when(m == 3, F.array(s("r", k), s("r", k + 1))).otherwise(F.array(s("r", k))).alias("revisions"))
    revision = c.select(s("r", k).alias("id"), F.lit("revision").alias("kind"), s("s", F.when(m == 4, k - 1).otherwise(k)).alias("source_id"))
    extraction = o.select(s("x", n).alias("id"), F.lit("extraction").alias("kind"), F.when(n % 9 == 4, F.array(s("s", k), s("s", k + 2))).otherwise(F.array(s("s", k))).alias("source_ids"), F.array(s("r", F.when(n % 11 == 5, k + 3).otherwise(k))).alias("source_revision_ids"))
    packet = o.select(s("p", n).alias("id"), F.lit("extraction_packet").alias("kind"), s("s", k).alias("source_id"), s("r", F.when(n % 13 == 6, k + 1).otherwise(k)).alias("source_revision"))
    evidence = o.select(s("e", n).alias("id"), F.lit("evidence").alias("kind"), s("s", k % 5).alias("source_id"), s("r", n % 2).alias("source_revision"), F.when(n > 6, s("e", n - 6)).alias("supersedes_id"), s("a", n % 3).alias("assertion_id"), F.floor(n / 50).cast("string").alias("span_start"), F.floor(n / 40).cast("string").alias("span_end"))
    out = source
    for t in (revision, extraction, packet, evidence):
        out = out.unionByName(t, True)
    for name in ("link", "locator_kind", "quote_hash"):
        out = out.withColumn(name, F.lit(None).cast("string"))
    return out.withColumn("link", F.concat(F.lit("notes/"), "id")).withColumn("input_ids", F.array().cast("array<string>")).withColumn("output_ids", F.array().cast("array<string>"))


@query(
    "reference_reasons",
    f"""WITH {REFS_SQL}, ty AS (SELECT id, 'source_id' AS field, source_id AS target, 'source' AS kind, CASE WHEN length(id) % 4 = 1 THEN 'notes/' || source_id || CASE WHEN right(id, 1) = '3' THEN '!' ELSE '' END END AS companion FROM rec WHERE kind = 'revision'),
li AS (SELECT id, kind, 'revisions' AS field, 'revision' AS wanted, unnest(revisions) AS target FROM rec UNION ALL SELECT id, kind, 'source_ids', 'source', unnest(source_ids) FROM rec UNION ALL SELECT id, kind, 'source_revision_ids', 'revision', unnest(source_revision_ids) FROM rec),
en AS (SELECT li.*, r.kind AS is_, r.source_id AS of FROM li LEFT JOIN rec r ON r.id = li.target),
se AS (SELECT x.id, (SELECT list_sort(list(DISTINCT s)) FROM (SELECT unnest(x.source_ids) AS s)) AS said, (SELECT list_sort(list(DISTINCT of)) FROM en WHERE en.id = x.id AND field = 'source_revision_ids' AND of IS NOT NULL) AS owned FROM rec x WHERE kind = 'extraction')
SELECT ty.id, 'invalid_reference:source_id' AS reason FROM ty LEFT JOIN rec r ON r.id = target WHERE r.kind IS DISTINCT FROM 'source' OR companion <> 'notes/' || r.id
UNION SELECT id, 'invalid_reference:' || field FROM en WHERE is_ IS DISTINCT FROM wanted
UNION SELECT id, 'duplicate_reference:' || field FROM li GROUP BY id, field, target HAVING count(*) > 1
UNION SELECT id, 'revision_ownership_mismatch' FROM en WHERE kind = 'source' AND field = 'revisions' AND is_ IS NOT NULL AND of IS DISTINCT FROM id
UNION SELECT id, 'head_not_retained' FROM rec WHERE kind = 'source' AND NOT list_contains(revisions, current_revision)
UNION SELECT id, 'extraction_ownership_set_mismatch' FROM se WHERE said IS DISTINCT FROM owned
UNION SELECT p.id, 'packet_revision_ownership_mismatch' FROM rec p JOIN rec r ON r.id = p.source_revision WHERE p.kind = 'extraction_packet' AND r.source_id IS DISTINCT FROM p.source_id
UNION SELECT e.id, 'evidence_successor_chain_disagreement' FROM rec e JOIN rec p ON p.id = e.supersedes_id WHERE e.kind = 'evidence' AND (e.assertion_id IS DISTINCT FROM p.assertion_id OR e.source_id IS DISTINCT FROM p.source_id OR (e.source_revision = p.source_revision AND (e.span_start IS DISTINCT FROM p.span_start OR e.span_end IS DISTINCT FROM p.span_end)))""",
)
def reference_reasons(spark, sf):
    records = _referring(spark, sf)
    link = F.concat(F.lit("notes/"), "source_id", F.when(F.col("id").endswith("3"), "!").otherwise(""))
    typed = records.filter("kind = 'revision'").select("id", F.lit("source_id").alias("field"), F.col("source_id").alias("target"), F.lit("source").alias("kind"), F.when(F.length("id") % 4 == 1, link).alias("companion"))
    return references.reference_reasons(records, typed)


SUPERSEDE_SQL = "sup AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 = 0 THEN o_orderkey + 3 WHEN o_orderkey % 64 < 4 THEN o_orderkey - 1 WHEN o_orderkey % 16 = 4 THEN NULL WHEN o_orderkey % 16 = 9 THEN o_orderkey - 2 ELSE o_orderkey - 1 END AS p FROM orders), pre AS (SELECT s.id, p FROM sup s WHERE p IN (SELECT id FROM sup))"


@query(
    "successor_chains",
    f"""WITH RECURSIVE {SUPERSEDE_SQL}, w AS (SELECT id AS first, id, 0::BIGINT AS place FROM sup WHERE id NOT IN (SELECT id FROM pre) UNION ALL SELECT w.first, pre.id, place + 1 FROM w JOIN pre ON pre.p = w.id),
f AS (SELECT p AS id FROM pre GROUP BY p HAVING count(*) > 1)
SELECT sup.id, first, place, first IS NULL AS cyclic, sup.id IN (FROM f) AS forked FROM sup LEFT JOIN w USING (id)""",
)
def successor_chains(spark, sf):
    """Orders that supersede one another in chains of up to 60; some fork, and four of each 64 go round."""
    n = F.col("o_orderkey")
    before = F.when(n % 64 == 0, n + 3).when(n % 64 < 4, n - 1).when(n % 16 == 4, None).when(n % 16 == 9, n - 2).otherwise(n - 1)
    return references.chains(model.table(spark, sf, "orders").select(n.alias("id"), before.alias("supersedes_id")))


@query("entity_channels", "SELECT 'supplier_' || s_suppkey AS id, CASE WHEN s_acctbal < -900 THEN 'invalid' WHEN s_suppkey % 9 = 0 THEN 'historical' ELSE 'current' END AS identity_eligibility, CASE WHEN s_acctbal < -900 THEN 'invalid' WHEN s_acctbal < 0 THEN 'stale' ELSE 'current' END AS description_eligibility FROM supplier")
def entity_channels(spark, sf):
    s = model.table(spark, sf, "supplier").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 9 == 0, "superseded").otherwise("active").alias("status"), (F.col("s_acctbal") < -900).alias("identity_invalid"), F.when(F.col("s_acctbal") < 0, "stale").otherwise("current").alias("eligibility"))
    return eligibility.dual_channel(s).select("id", "identity_eligibility", "description_eligibility")


REMAP_SQL = f"{ASSERTIONS_SQL}, rm AS (SELECT 'supplier_' || s_suppkey AS old, 'supplier_' || (s_suppkey - s_suppkey % 4) AS new FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey > 4)"


@query(
    "entities_merged",
    f"""WITH {REMAP_SQL} SELECT a.id, coalesce(s.new, subject_id) AS subject_id, coalesce(o.new, object_id) AS object_id, CASE WHEN (s.new IS NOT NULL OR o.new IS NOT NULL) AND status = 'accepted' THEN 'proposed' ELSE status END AS status
FROM assertions a LEFT JOIN rm s ON subject_id = s.old LEFT JOIN rm o ON object_id = o.old""",
)
def entities_merged(spark, sf):
    return catalog.merge_entities(model.assertions(spark, sf), _remap(spark, sf)).drop("predicate")


def _remap(spark, sf):
    k = F.col("s_suppkey")
    s = lambda c: F.concat(F.lit("supplier_"), c.cast("string"))
    return model.table(spark, sf, "supplier").filter("s_suppkey % 4 <> 0 and s_suppkey > 4").select(s(k).alias("old"), s(k - k % 4).alias("new"))


@query(
    "remap_errors",
    f"""WITH {REMAP_SQL}, need AS (SELECT id, 'subject' AS side, subject_id AS old FROM assertions WHERE subject_id IN (SELECT old FROM rm) UNION ALL SELECT id, 'object', object_id FROM assertions WHERE object_id IN (SELECT old FROM rm)),
given AS (SELECT * FROM need WHERE length(id) % 5 <> 0 UNION ALL SELECT 'x>' || old, 'object', old FROM rm)
SELECT 'missing' AS reason, id || ':' || side AS id FROM need WHERE length(id) % 5 = 0 UNION ALL SELECT 'not a reference', 'x>' || old || ':object' FROM rm""",
)
def remap_errors(spark, sf):
    a, rm = model.assertions(spark, sf), _remap(spark, sf)
    need = a.select(F.col("id").alias("assertion_id"), F.lit("subject").alias("side"), F.col("subject_id").alias("old")).join(rm.select("old"), "old", "left_semi")
    given = need.filter(F.length("assertion_id") % 5 != 0).select("assertion_id", "side", "old").unionByName(rm.select(F.concat(F.lit("x>"), "old").alias("assertion_id"), F.lit("object").alias("side"), "old"))
    return catalog.remap_errors(given, a, rm.select(F.col("old").alias("id")))


@query("review_outcomes", f"WITH {EVIDENCE_SQL} SELECT CASE WHEN h = 0 THEN 'uncovered' WHEN h = 1 THEN 'retract' WHEN (h = 2) = (stance = 'supports') THEN 'unchanged' ELSE 'retract and succeed' END AS outcome, count(*) AS n FROM (SELECT *, length(id) * 7 % 4 AS h FROM evidence) GROUP BY outcome")
def review_outcomes(spark, sf):
    ev = model.evidence(spark, sf).select("id", "stance")
    h = F.length("id") * 7 % 4
    answers = ev.select("id", F.when(h == 1, "insufficient").when(h == 2, "supports").when(h == 3, "contradicts").alias("assessment")).filter("assessment is not null")
    return catalog.review(ev, answers).groupBy("outcome").agg(F.count("*").alias("n"))


@query("withdrawal_affects", f"WITH {EVIDENCE_SQL} SELECT 'assertion' AS kind, assertion_id AS id FROM evidence WHERE source_id = 'src_7' UNION SELECT 'revision', 'rev_' || o_orderkey FROM orders WHERE o_orderkey % 40 = 7")
def withdrawal_affects(spark, sf):
    k = F.col("o_orderkey")
    revisions = model.table(spark, sf, "orders").select(F.concat(F.lit("src_"), (k % 40).cast("string")).alias("source_id"), F.concat(F.lit("rev_"), k.cast("string")).alias("id"))
    return catalog.withdrawal("src_7", revisions, model.evidence(spark, sf))


@query(
    "decisions_applied",
    """WITH st AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'superseded' ELSE 'active' END AS status FROM supplier),
w AS (SELECT d.k, CASE WHEN i.status <> 'superseded' THEN CASE WHEN d.k % 2 = 0 THEN 'not merged' ELSE 'not superseded' END END AS a, CASE WHEN o.status IS NULL THEN 'missing' WHEN o.status <> 'active' THEN 'not active' END AS b FROM st d JOIN st i ON i.k = d.k LEFT JOIN st o ON o.k = d.k + 1)
SELECT 'd_' || k AS id, CASE WHEN a IS NULL AND b IS NULL THEN 'current' ELSE 'invalid' END AS eligibility, array_to_string(list_sort(list_filter([a, b], lambda x: x IS NOT NULL)), ',') AS reasons FROM w""",
)
def decisions_applied(spark, sf):
    k = F.col("s_suppkey")
    s = lambda c: F.concat(F.lit("supplier_"), c.cast("string"))
    records = model.table(spark, sf, "supplier").select(s(k).alias("id"), F.when(k % 3 == 0, "superseded").otherwise("active").alias("status"), F.when(k % 3 == 0, s(k + 1)).alias("superseded_by"))
    decisions = model.table(spark, sf, "supplier").select(F.concat(F.lit("d_"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "merge").otherwise("split").alias("action"), F.array(s(k)).alias("inputs"), F.array(s(k + 1)).alias("outputs"))
    return eligibility.apply_decisions(decisions, records)


@query("semantic_seeds", f"WITH s AS (SELECT vec_id % 25 AS owner, max({COS_SQL}) AS score FROM embeddings GROUP BY 1) SELECT 'nation_' || owner AS id, row_number() OVER (ORDER BY score DESC, owner) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 12")
def semantic_seeds(spark, sf):
    """Dense hits collapsed to graph targets."""
    units = model.units(spark, sf).select((F.col("unit_id") % 25).alias("owner"), "unit_id", "embedding")
    best = dense.dense_owners(units, _vector(), graph.MOST_SEEDS).filter("unit_rank = 1")
    return best.select(F.concat(F.lit("nation_"), F.col("owner").cast("string")).alias("id"), F.col("owner_rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
