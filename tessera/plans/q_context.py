"""Queries of context assembly: overlaps, coverage, affinity, weights, utilities, packing, set selection, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import context, dense, intervals
from tessera.plans.registry import query
from tessera.sources import model
from tessera.sources.model import TOKENS_SQL

SPANS_SQL = """sp AS (SELECT l_orderkey // 32 AS owner, l_orderkey * 10 + l_linenumber AS id, (l_partkey * 13) % 3000 AS start, (l_partkey * 13) % 3000 + l_quantity::BIGINT * 4 AS "end", (round(l_discount * 100)::BIGINT - 4) / 16::DOUBLE AS cosine FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount) = 1)"""


def _spans(spark, sf):
    one = model.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount")).alias("s"))
    start = F.col("s.l_partkey") * 13 % 3000
    return one.select(F.floor(F.col("l_orderkey") / 32).alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start"), (start + F.col("s.l_quantity").cast("long") * 4).alias("end"), ((F.round(F.col("s.l_discount") * 100).cast("long") - 4) / 16.0).alias("cosine"))


CANDS_SQL = 'cd AS (SELECT owner, id, start, "end" FROM sp WHERE id % 2 = 0), cu AS (SELECT owner, id, start, "end", cosine FROM sp WHERE id % 2 = 1)'


def _cands(spark, sf):
    s = _spans(spark, sf)
    return s.filter("id % 2 = 0").select("owner", "id", "start", "end"), s.filter("id % 2 = 1")


@query("span_overlaps", f'WITH {SPANS_SQL}, {CANDS_SQL} SELECT cd.owner, cd.id AS a, cu.id AS b, least(cd."end", cu."end") - greatest(cd.start, cu.start) AS overlap FROM cd JOIN cu ON cd.owner = cu.owner AND cd.start < cu."end" AND cu.start < cd."end"')
def span_overlaps(spark, sf):
    return intervals.overlap_join(*_cands(spark, sf), "owner", 256).select("owner", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "overlap")


ISLANDS_SQL = """is_{n} AS (SELECT owner, start, "end", CASE WHEN start > max("end") OVER w THEN 1 WHEN max("end") OVER w IS NULL THEN 1 ELSE 0 END AS gap FROM {src} WINDOW w AS (PARTITION BY owner ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ig_{n} AS (SELECT *, sum(gap) OVER (PARTITION BY owner ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM is_{n}),
mg_{n} AS (SELECT owner, min(start) AS start, max("end") AS "end", count(*) AS parts FROM ig_{n} GROUP BY owner, island)"""


@query("spans_merged", f"WITH {SPANS_SQL}, {ISLANDS_SQL.format(n='a', src='sp')} SELECT owner, start, \"end\", parts FROM mg_a")
def spans_merged(spark, sf):
    return intervals.merge_overlapping(_spans(spark, sf), ["owner"])


@query(
    "span_coverage",
    f"""WITH {SPANS_SQL}, {CANDS_SQL}, {ISLANDS_SQL.format(n="a", src="cd")}, {ISLANDS_SQL.format(n="b", src="cu")},
w AS (SELECT owner, sum("end" - start)::BIGINT AS wanted FROM mg_a GROUP BY owner), c AS (SELECT a.owner, sum(least(a."end", b."end") - greatest(a.start, b.start))::BIGINT AS covered FROM mg_a a JOIN mg_b b ON a.owner = b.owner AND a.start < b."end" AND b.start < a."end" GROUP BY a.owner)
SELECT owner, wanted, coalesce(covered, 0) AS covered FROM w LEFT JOIN c USING (owner)""",
)
def span_coverage(spark, sf):
    return intervals.coverage(*_cands(spark, sf), "owner")


@query(
    "cue_affinity",
    f"""WITH {SPANS_SQL}, {CANDS_SQL} SELECT cd.id, floor(greatest(-1, least(1, sum(cosine * (least(cd."end", cu."end") - greatest(cd.start, cu.start))) / sum(least(cd."end", cu."end") - greatest(cd.start, cu.start)))) * 1e6 + 0.5)::BIGINT AS affinity
FROM cd JOIN cu ON cd.owner = cu.owner AND cd.start < cu."end" AND cu.start < cd."end" GROUP BY cd.id""",
)
def cue_affinity(spark, sf):
    """Affinities in millionths: halves are dyadic, so sums are the same in any order."""
    return intervals.affinity(*_cands(spark, sf)).select("id", F.floor(F.col("affinity") * 1e6 + 0.5).alias("affinity"))


@query(
    "dominant_region",
    f"""WITH {SPANS_SQL}, {CANDS_SQL} SELECT cd.id, cu.start, cu."end" FROM cd JOIN cu ON cd.owner = cu.owner AND cd.start < cu."end" AND cu.start < cd."end"
QUALIFY row_number() OVER (PARTITION BY cd.id ORDER BY least(cd."end", cu."end") - greatest(cd.start, cu.start) DESC, cosine DESC, cu.start, cu."end") = 1""",
)
def dominant_region(spark, sf):
    return intervals.dominant_region(*_cands(spark, sf))


@query(
    "parent_spans",
    f"""WITH {SPANS_SQL}, {CANDS_SQL}, p AS (SELECT cd.id, cu.start, cu."end" FROM cd JOIN cu ON cd.owner = cu.owner AND cu.start <= cd.start AND cu."end" >= cd."end" QUALIFY row_number() OVER (PARTITION BY cd.id ORDER BY cu."end" - cu.start, cu.start) = 1)
SELECT cd.id, coalesce(p.start, cd.start) AS start, coalesce(p."end", cd."end") AS "end" FROM cd LEFT JOIN p USING (id)""",
)
def parent_spans(spark, sf):
    return intervals.parents(*_cands(spark, sf))


@query("contained_spans", f"""WITH {SPANS_SQL} SELECT a.id, min(b.id) AS "by" FROM sp a JOIN sp b ON a.owner = b.owner AND a.id <> b.id AND b.start <= a.start AND b."end" >= a."end" AND (b.start < a.start OR b."end" > a."end" OR b.id < a.id) GROUP BY a.id""")
def contained_spans(spark, sf):
    return intervals.contained(_spans(spark, sf).select("owner", "id", "start", "end"))


@query("owner_interleave", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings WHERE label IS NOT NULL QUALIFY turn <= 160")
def owner_interleave(spark, sf):
    e = model.table(spark, sf, "embeddings").filter("label is not null").select("vec_id", "label")
    return intervals.interleave(e, "label", ["vec_id"], "label").withColumn("turn", F.col("turn").cast("long"))


@query("top_two_per_owner", "SELECT vec_id, label FROM embeddings WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 2")
def top_two_per_owner(spark, sf):
    w = Window.partitionBy("label").orderBy(F.col("vec_id").desc())
    return model.table(spark, sf, "embeddings").filter("label is not null").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("vec_id", "label")


@query(
    "term_weights",
    f"""WITH b AS (SELECT doc_id, unnest(list_distinct({TOKENS_SQL.format("text")})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round((1 + ln((n + 1) / count(*))) * 1e6)::BIGINT AS weight FROM b, n GROUP BY term, n HAVING count(*) > 3""",
)
def term_weights(spark, sf):
    d = model.table(spark, sf, "documents").select(F.col("doc_id").alias("block"), model.tokens("text").alias("terms"))
    return context.term_weights(d).filter("df > 3")


UTIL_SQL = """ut AS (SELECT o_orderkey AS key, o_custkey % 40 AS request, o_custkey % 7 AS owner, 1.0 / (60.0 + o_orderkey % 50) AS score, (o_orderkey % 11) / 11.0 AS novel, (o_orderkey % 13) / 13.0 AS local, 0.25 + (o_orderkey % 4) / 8.0 AS density,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 17) / 17.0 - 0.2 END AS affinity, CASE WHEN o_custkey % 40 < 20 THEN 0.8 ELSE 0.0 END AS best, o_orderkey % 5 = 0 AS seed, o_orderkey % 6 = 0 AS clipped FROM orders)"""


def _utilities(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = model.table(spark, sf, "orders").select(
        k.alias("key"), (c % 40).alias("request"), (c % 7).alias("owner"), (1.0 / (60.0 + k % 50)).alias("score"), ((k % 11) / 11.0).alias("novel"), ((k % 13) / 13.0).alias("local"), (0.25 + (k % 4) / 8.0).alias("density"),
        F.when(k % 3 != 0, (k % 17) / 17.0 - 0.2).alias("affinity"), F.when(c % 40 < 20, 0.8).otherwise(0.0).alias("best"), (k % 5 == 0).alias("seed"), (k % 6 == 0).alias("clipped"),
    )
    return rows.withColumn("utility", context.utility(*[F.col(x) for x in ("score", "novel", "local", "density", "affinity", "best", "seed", "clipped")]))


@query(
    "packet_utility",
    f"""WITH {UTIL_SQL} SELECT key, round(score * CASE WHEN affinity IS NOT NULL THEN (0.05 + pow(CASE WHEN best > 0 THEN greatest(affinity, 0) / best ELSE 0 END, 4)) * (1 + 0.25 * novel + 0.5 * local)
  ELSE (0.25 + 2 * novel + 0.5 * local + CASE WHEN seed THEN 0.05 ELSE 0 END) * CASE WHEN best > 0 THEN 0.15 ELSE 1 END END * density * CASE WHEN clipped THEN 0.7 ELSE 1 END, 8)::DOUBLE AS utility FROM ut""",
)
def packet_utility(spark, sf):
    return _utilities(spark, sf).select("key", F.round("utility", 8).alias("utility"))


@query("context_packed")
def context_packed(spark, sf):
    """Each request's packets, admitted or refused with the reason."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = model.table(spark, sf, "orders")
    terms = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("t"), ((k + 3 * i) % 9).cast("string")))
    start, size = k * 37 % 5000, 200 + k * 53 % 1500
    packets = o.select(
        F.floor(c / 16).alias("request"), k.alias("key"), (c % 7).alias("owner"), start.alias("start"), (start + size).alias("end"), (1.0 / (60.0 + k % 50)).alias("score"), F.array_distinct(terms).alias("terms"),
        F.transform(F.array_distinct(terms), lambda t: 100 + F.ascii(F.right(t, F.lit(1))) % 7 * 50).alias("weights"), (k % 13 * 10).alias("local"), (0.25 + (k % 4) / 8.0).alias("density"),
        F.when((k % 3 != 0) & (c % 40 < 20), (k % 17) / 17.0 - 0.2).alias("affinity"), (k % 5 == 0).alias("seed"), (k % 6 == 0).alias("clipped"), (k % 8 == 0).alias("graph"),
        F.when(k % 2 == 0, start).cast("double").alias("child_start"), F.when(k % 2 == 0, start + F.floor(size / 3)).cast("double").alias("child_end"),
    )
    return context.pack(packets, 8000, 2000, 2048)


@query("context_rendered")
def context_rendered(spark, sf):
    """The printed context of each request over spans of documents, with the bytes that packing charged for it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    docs = model.table(spark, sf, "documents").select(F.col("doc_id").alias("owner"), F.concat(F.lit("doc/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("label"), F.coalesce("text", F.lit("")).alias("body"))
    n = docs.agg((F.max("owner") + 1).alias("documents"))
    terms = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("t"), ((k + 3 * i) % 9).cast("string")))
    o = model.table(spark, sf, "orders").join(F.broadcast(n)).select("*", (k * 7 % F.col("documents")).alias("owner")).join(docs, "owner")
    chars = F.length("body")
    first, last = F.floor(chars * (k % 5) / 8), F.least(F.floor(chars * (k % 5) / 8) + 100 + k * 53 % 900, chars)
    at = lambda i: F.octet_length(F.left("body", F.greatest(i, F.lit(0)).cast("int"))).cast("long")
    packets = o.select(
        F.floor(c / 16).alias("request"), k.alias("key"), "owner", at(first).alias("start"), at(last).alias("end"), (1.0 / (60.0 + k % 50)).alias("score"), F.array_distinct(terms).alias("terms"),
        F.transform(F.array_distinct(terms), lambda t: 100 + F.ascii(F.right(t, F.lit(1))) % 7 * 50).alias("weights"), (k % 13 * 10).alias("local"), (0.25 + (k % 4) / 8.0).alias("density"),
        F.when((k % 3 != 0) & (c % 40 < 20), (k % 17) / 17.0 - 0.2).alias("affinity"), (k % 5 == 0).alias("seed"), (k % 6 == 0).alias("clipped"), (k % 8 == 0).alias("graph"),
        F.when(k % 2 == 0, at(first)).alias("child_start"), F.when(k % 2 == 0, at(first + F.floor((last - first) / 3))).alias("child_end"),
    )
    out = context.pack_rendered(packets, docs, 8000, 2000, 2048)
    return out.select("request", "passages", "charged", F.octet_length("context").cast("long").alias("bytes"), F.sha2("context", 256).alias("context_sha256"))


@query(
    "whole_originals",
    """WITH o AS (SELECT o_custkey % 60 AS request, o_orderkey AS key, o_orderkey * 7 % 100 AS rank, 1000 + o_orderkey * 31 % 40000 AS bytes FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rank, key) AS n FROM o QUALIFY n <= 10),
r AS (FROM (WITH RECURSIVE g AS (SELECT request, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS key, 0::BIGINT AS position FROM (SELECT DISTINCT request FROM c) UNION ALL
  SELECT c.request, c.n, CASE WHEN g.used + c.bytes <= 98304 THEN g.used + c.bytes ELSE g.used END, CASE WHEN g.used + c.bytes <= 98304 THEN c.key END, CASE WHEN g.used + c.bytes <= 98304 THEN g.position + 1 ELSE g.position END FROM g JOIN c ON c.request = g.request AND c.n = g.n + 1) FROM g))
SELECT request, key, position FROM r WHERE key IS NOT NULL""",
)
def whole_originals(spark, sf):
    k = F.col("o_orderkey")
    o = model.table(spark, sf, "orders").select((F.col("o_custkey") % 60).alias("request"), k.alias("key"), (k * 7 % 100).alias("rank"), (1000 + k * 31 % 40000).alias("bytes"))
    return context.whole_originals(o)


@query("facility_location")
def facility_location(spark, sf):
    e = model.table(spark, sf, "embeddings").filter("label is not null").select(F.col("label").alias("request"), F.col("vec_id").alias("key"), ((F.col("vec_id") % 7 + 1).cast("double")).alias("weight"), F.col("embedding").alias("vector"))
    return context.facility_location(e, 5)


@query("complementary_passages")
def complementary_passages(spark, sf):
    d = model.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("request"), F.col("doc_id").alias("key"), (F.col("doc_id") % 6).alias("region"), context.semantic_strength(F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 97) / 97.0)).alias("strength"), "text")
    d = context.cut_for_request(d, [F.col("strength").desc(), F.col("key")])  # the operator's own cut, before texts become terms
    d = d.withColumn("terms", F.array_distinct(model.tokens("text"))).drop("text")
    return context.complementary(d.withColumn("weights", F.transform("terms", lambda t: F.length(t).cast("long"))), 8)


@query(
    "units_selected",
    """WITH u AS (SELECT vec_id AS unit_id, coalesce(label, -1) AS owner, vec_id % 40 AS start, round(embedding[1]::DOUBLE, 4) AS cosine, (vec_id * 7 % 50) / 10.0 AS bm25 FROM embeddings),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY owner, start ORDER BY cosine DESC, bm25 DESC, unit_id) = 1), c AS (FROM o ORDER BY cosine DESC, bm25 DESC, unit_id LIMIT 160)
SELECT unit_id, row_number() OVER (ORDER BY cosine DESC, bm25 DESC, unit_id) AS rank, row_number() OVER (ORDER BY cosine DESC, unit_id) AS dense_rank, row_number() OVER (ORDER BY bm25 DESC, unit_id) AS bm25_rank FROM c""",
)
def units_selected(spark, sf):
    e = model.table(spark, sf, "embeddings")
    units = e.select(F.col("vec_id").alias("unit_id"), F.coalesce("label", F.lit(-1)).alias("owner"), (F.col("vec_id") % 40).alias("start"), (F.col("vec_id") % 40 + 10).alias("end"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("cosine"))
    out = context.select_units(units, e.select(F.col("vec_id").alias("unit_id"), (F.col("vec_id") * 7 % 50 / 10.0).alias("bm25")))
    return out.select("unit_id", *[F.col(c).cast("long").alias(c) for c in ("rank", "dense_rank", "bm25_rank")])


@query(
    "evidence_bundles",
    """WITH p AS (SELECT 'a' || (l_suppkey % 50) || '_' || (l_partkey % 20) AS assertion_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS passage_id, l_returnflag <> 'R' AS supports, l_returnflag <> 'N' AS contradicts, l_linestatus = 'O' AS cur, 'p' || (l_orderkey % 40) AS path, l_quantity::BIGINT AS start, l_orderkey % 15 AS support_group FROM lineitem),
ag AS (SELECT * FROM p WHERE contradicts QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY NOT supports, NOT cur, path, start, passage_id) = 1),
fs AS (SELECT * FROM p WHERE supports AND NOT contradicts QUALIFY row_number() OVER (PARTITION BY assertion_id, support_group ORDER BY NOT cur, path, start, passage_id) = 1),
tw AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY NOT cur, path, start, passage_id) <= 2),
al AS (SELECT assertion_id, 'supports' AS role, passage_id FROM tw UNION ALL SELECT assertion_id, 'contradicts', passage_id FROM ag)
SELECT DISTINCT assertion_id, role, passage_id FROM al WHERE assertion_id IN (SELECT assertion_id FROM p WHERE supports)""",
)
def evidence_bundles(spark, sf):
    li = model.table(spark, sf, "lineitem")
    p = li.select(
        F.concat(F.lit("a"), (F.col("l_suppkey") % 50).cast("string"), F.lit("_"), (F.col("l_partkey") % 20).cast("string")).alias("assertion_id"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("passage_id"),
        (F.col("l_returnflag") != "R").alias("supports"), (F.col("l_returnflag") != "N").alias("contradicts"), (F.col("l_linestatus") == "O").alias("current"),
        F.concat(F.lit("p"), (F.col("l_orderkey") % 40).cast("string")).alias("path"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_orderkey") % 15).alias("support_group"),
    )
    return context.bundles(p).distinct()


@query("passage_scores", "SELECT o_orderkey AS key, round(CASE WHEN o_orderkey % 3 <> 0 THEN 1.0 / (60.0 + o_orderkey % 20) ELSE 0 END + CASE WHEN o_orderkey % 4 <> 0 THEN 1.0 / (60.0 + o_orderkey % 30) ELSE 0 END, 8)::DOUBLE AS score FROM orders")
def passage_scores(spark, sf):
    k = F.col("o_orderkey")
    return model.table(spark, sf, "orders").select(k.alias("key"), F.round(context.passage_score(F.when(k % 3 != 0, k % 20), F.when(k % 4 != 0, k % 30)), 8).alias("score"))


@query("rank_fusion", "WITH r AS (SELECT o_custkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' ELSE 'graph_evidence' END AS channel, min(o_orderkey % 80 + 1) AS rank FROM orders GROUP BY ALL) SELECT path, round(sum(1.0 / (60.0 + rank)), 8)::DOUBLE AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM r GROUP BY path")
def rank_fusion(spark, sf):
    k = F.col("o_orderkey")
    lists = model.table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.when(k % 3 == 0, "dense").when(k % 3 == 1, "lexical").otherwise("graph_evidence").alias("channel"), (k % 80 + 1).alias("rank"))
    return dense.fuse(lists).withColumn("score", F.round("score", 8))


HANDED_SQL = f"""WITH {SPANS_SQL}, on_ AS (SELECT owner, start, "end", min({{'late': id % 5 <> 0, 'rank': id, 'id': id}}) AS b FROM sp GROUP BY owner, start, "end"), o AS (SELECT owner, start, "end", b.late AS late, b.id AS id FROM on_),
k AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.owner = a.owner AND b.id <> a.id AND b.start <= a.start AND b."end" >= a."end")), f AS (FROM k ORDER BY late, id LIMIT 32),
n AS (SELECT *, row_number() OVER w AS n, sum("end" - start) OVER w AS s FROM f WINDOW w AS (ORDER BY late, id))
SELECT 'p' || n AS passage, owner, start, "end" FROM n WHERE s <= 65536"""


@query("handed_over", HANDED_SQL)
def handed_over(spark, sf):
    from tessera.operators.catalog import hand_over

    return hand_over(_spans(spark, sf).select("id", "owner", "start", "end", (F.col("id") % 5 == 0).alias("explicit"), F.col("id").alias("rank")))


@query("relations_admitted", "WITH r AS (SELECT l_orderkey AS rule, CASE WHEN l_linenumber % 2 = 0 THEN 'exception' ELSE 'condition' END AS role, l_partkey AS target, l_quantity::BIGINT AS bytes FROM lineitem) SELECT rule, role, target, bytes FROM r WHERE rule % 3 = 0 AND rule IN (SELECT rule FROM r GROUP BY rule HAVING sum(bytes) <= 120)")
def relations_admitted(spark, sf):
    from tessera.operators.catalog import relations_admitted as admit

    li = model.table(spark, sf, "lineitem")
    r = li.select(F.col("l_orderkey").alias("rule"), F.when(F.col("l_linenumber") % 2 == 0, "exception").otherwise("condition").alias("role"), F.col("l_partkey").alias("target"), F.col("l_quantity").cast("long").alias("bytes"))
    return admit(r, r.filter("rule % 3 = 0").select(F.col("rule").alias("id")).distinct(), 120)
