"""Queries of catalog upkeep: health, claims, inventories, captures, deltas, links, hand-over, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import catalog
from tessera.plans.registry import query
from tessera.sources import model, store
from tessera.sources.model import ASSERTIONS_SQL, DOCUMENTS_SQL


@query("health_counts", f"WITH {DOCUMENTS_SQL} SELECT (SELECT count(*) FROM pages WHERE url LIKE '%#%') AS diagnostics, count(*) FILTER (eligibility IN ('withdrawn', 'invalid')) AS excluded, count(*) FILTER (record_id IS NULL AND source_id IS NULL) AS inspection_only FROM d")
def health_counts(spark, sf):
    return catalog.health(model.table(spark, sf, "pages").filter(F.col("url").contains("#")), model.documents(spark, sf, body=False))


@query("duplicate_ids", "SELECT 'id-' || (doc_id % 900) AS record_id, string_agg(DISTINCT 'p/' || doc_id, ',' ORDER BY 'p/' || doc_id) AS paths, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1 HAVING n > 1")
def duplicate_ids(spark, sf):
    d = F.col("doc_id")
    return catalog.duplicate_ids(model.table(spark, sf, "documents").select(F.concat(F.lit("id-"), (d % 900).cast("string")).alias("record_id"), F.concat(F.lit("p/"), d.cast("string")).alias("path")))


@query("keyset_page", "SELECT page_id, url FROM pages WHERE page_id > 100 ORDER BY page_id LIMIT 25")
def keyset_page(spark, sf):
    return catalog.keyset_page(model.table(spark, sf, "pages").select("page_id", "url"), "page_id", 100, 25)


@query("existence_probe", "SELECT EXISTS (SELECT 1 FROM documents WHERE doc_id = 17) OR EXISTS (SELECT 1 FROM pages WHERE page_id = -1) AS found")
def existence_probe(spark, sf):
    return catalog.exists(model.table(spark, sf, "documents").filter("doc_id = 17"), model.table(spark, sf, "pages").filter("page_id = -1"))


@query("point_lookup", f"WITH {DOCUMENTS_SQL} SELECT path, record_id, title, eligibility FROM d WHERE doc_id = 42 OR path = 'doc/en/17'")
def point_lookup(spark, sf):
    """By id, and by path, whose last part is an id as well: both reach the scan as filters of a column, which their disjunction over a path that is made wouldn't."""
    docs, path = model.documents(spark, sf, body=False), "doc/en/17"
    by_path = docs.filter((F.col("doc_id") == int(path.rsplit("/", 1)[1])) & (F.col("doc_id") != 42) & (F.col("path") == path))
    return docs.filter("doc_id = 42").unionByName(by_path).select("path", "record_id", "title", "eligibility")


@query("inventory", "WITH b AS (SELECT source AS class, md5(text) AS h, count(*) AS n, max(strlen(text)) AS b FROM documents GROUP BY ALL) SELECT class, sum(n)::BIGINT AS objects, sum(n * b)::BIGINT AS bytes, count(*) AS distinct_contents, sum((n - 1) * b)::BIGINT AS duplicate_bytes FROM b GROUP BY class")
def inventory(spark, sf):
    return catalog.inventory(model.table(spark, sf, "documents").select(F.col("source").alias("class"), F.md5(F.col("text").cast("binary")).alias("hash"), F.octet_length("text").cast("long").alias("bytes")))


@query("document_sizes", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents WHERE strlen(text) > 5000")
def document_sizes(spark, sf):
    t = model.table(spark, sf, "documents")
    return t.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars")).filter("bytes > 5000")


@query("omissions", "SELECT 'c' || user_id AS record, 'p' || (event_id % 5) AS path, event_type AS reason, sum(event_id % 4)::BIGINT AS count FROM events GROUP BY ALL")
def omissions(spark, sf):
    e = model.ledger(spark, sf)
    return catalog.omissions(e.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("record"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("path"), F.col("event_type").alias("reason"), (F.col("event_id") % 4).alias("count")))


REV_SQL = """cv AS (SELECT conv_id AS source_id, turn AS ordinal, md5(coalesce(text, '')) AS h, CASE WHEN turn % 3 <> 0 THEN md5(lower(text)) END AS c, 'x' || (turn % 2) AS x FROM conversations)"""


def _revisions(spark, sf):
    h = lambda c: F.md5(c.cast("binary"))
    return model.table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ordinal"), h(F.coalesce("text", F.lit(""))).alias("original_hash"), F.when(F.col("turn") % 3 != 0, h(F.lower("text"))).alias("content_hash"), F.concat(F.lit("x"), (F.col("turn") % 2).cast("string")).alias("extractor"))


@query("matching_revision", f"WITH {REV_SQL} SELECT a.source_id || '-' || a.ordinal AS capture_id, min(b.ordinal) AS revision FROM cv a LEFT JOIN cv b ON a.source_id = b.source_id AND a.h = b.h AND a.c IS NOT DISTINCT FROM b.c AND a.x = b.x AND b.ordinal < 2 GROUP BY 1")
def matching_revision(spark, sf):
    r = _revisions(spark, sf)
    captures = r.withColumn("capture_id", F.concat(F.col("source_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string"))).drop("ordinal")
    return catalog.matching_revision(captures, r.filter("ordinal < 2"))


@query("current_revision", "SELECT conv_id AS source_id, max(turn) AS current_revision, count(*) AS revisions FROM conversations GROUP BY conv_id")
def current_revision(spark, sf):
    return _revisions(spark, sf).groupBy("source_id").agg(F.max("ordinal").alias("current_revision"), F.count("*").alias("revisions"))


@query("captured", "SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'unsupported' ELSE 'complete' END AS status, CASE WHEN doc_id % 13 <> 0 THEN length(text) END AS chars FROM documents")
def captured(spark, sf):
    raw = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit(b"\xff"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return catalog.capture(model.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), raw.alias("bytes"))).select("id", "status", F.length("content").cast("long").alias("chars"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark, sf):
    return model.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query(
    "evidence_revalidated",
    """WITH q AS (SELECT doc_id AS id, source, substr(text, 20, 30) AS quote, text, doc_id % 4 = 0 AS same FROM documents WHERE length(text) > 60),
t AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'zz' || text WHEN id % 3 = 1 THEN text || quote ELSE substr(text, 40) END AS now FROM q)
SELECT id, CASE WHEN same THEN 'kept' WHEN contains(now, quote) AND position(quote IN substr(now, position(quote IN now) + 1)) = 0 THEN 'moved' ELSE 'lost' END AS state,
  CASE WHEN NOT same AND contains(now, quote) AND position(quote IN substr(now, position(quote IN now) + 1)) = 0 THEN strlen(substr(now, 1, position(quote IN now) - 1)) END AS start FROM t""",
)
def evidence_revalidated(spark, sf):
    d = model.table(spark, sf, "documents").filter(F.length("text") > 60).select(F.col("doc_id").alias("id"), "text", F.substring("text", 20, 30).alias("quote"))
    ev = d.select("id", F.col("id").alias("source_id"), F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("revision"), "quote")
    now = F.when(F.col("id") % 3 == 0, F.concat(F.lit("zz"), "text")).when(F.col("id") % 3 == 1, F.concat("text", "quote")).otherwise(F.expr("substring(text, 40)"))
    return catalog.revalidate(ev, d.select(F.col("id").alias("source_id"), F.lit(2).alias("revision"), now.alias("text")))


def _notes(spark, sf):
    d = F.col("doc_id")
    n = F.concat(F.lit("n"), d.cast("string"))
    return model.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), (d % 7).cast("string"), F.lit("/"), n, F.when(d % 2 == 0, ".md").otherwise("")).alias("path"), F.array(F.concat(F.lit("al"), (d % 40).cast("string"))).alias("aliases"))


def _note_links(spark, sf):
    d = F.col("doc_id")
    target = F.when(d % 5 == 0, F.concat(F.lit("d"), ((d + 1) % 7).cast("string"), F.lit("/n"), (d + 1).cast("string"))).when(d % 5 == 1, F.concat(F.lit("n"), (d - 1).cast("string"))).when(d % 5 == 2, F.concat(F.lit("al"), (d % 50).cast("string"))).otherwise(F.lit("nowhere"))
    return _notes(spark, sf).select(F.col("path").alias("from_path"), target.alias("target"))


NOTES_SQL = """nt AS (SELECT doc_id, 'd' || (doc_id % 7) || '/n' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '' END AS path, ['al' || (doc_id % 40)] AS aliases FROM documents),
lk AS (SELECT DISTINCT path AS from_path, CASE doc_id % 5 WHEN 0 THEN 'd' || ((doc_id + 1) % 7) || '/n' || (doc_id + 1) WHEN 1 THEN 'n' || (doc_id - 1) WHEN 2 THEN 'al' || (doc_id % 50) ELSE 'nowhere' END AS target FROM nt)"""


@query(
    "links_resolved",
    f"""WITH {NOTES_SQL}, k AS (SELECT path AS k, path, 0 AS tier FROM nt UNION SELECT left(path, length(path) - 3), path, 1 FROM nt WHERE ends_with(path, '.md') UNION SELECT regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', ''), path, 2 FROM nt UNION SELECT unnest(aliases), path, 2 FROM nt),
h AS (SELECT from_path, target, path, tier, min(tier) OVER (PARTITION BY from_path, target) AS best FROM lk JOIN k ON target = k),
f AS (SELECT from_path, target, count(DISTINCT path) AS n, min(path) AS path FROM h WHERE tier = best GROUP BY ALL)
SELECT from_path, target, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution, CASE WHEN n = 1 THEN path END AS to_path FROM lk LEFT JOIN f USING (from_path, target)""",
)
def links_resolved(spark, sf):
    return catalog.resolve_links(_note_links(spark, sf), _notes(spark, sf))


@query("links_typed", "SELECT 'o' || o_orderkey AS from_path, 'customer_' || o_custkey AS target_id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN o_orderkey % 9 = 0 THEN 'kind' WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 'conflict' WHEN c_acctbal < 0 THEN 'stale' ELSE 'resolved' END AS resolution FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 11 <> 0")
def links_typed(spark, sf):
    o, k = model.table(spark, sf, "orders"), F.col("o_orderkey")
    links = o.select(F.concat(F.lit("o"), k.cast("string")).alias("from_path"), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("target_id"), F.when(k % 9 == 0, "supplier").otherwise("customer").alias("kind"), F.when(k % 8 == 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).when(k % 4 == 0, F.lit("other")).alias("companion"))
    c = model.table(spark, sf, "customer").filter("c_custkey % 11 <> 0")
    records = c.select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("kind"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_acctbal") < 0, "stale").otherwise("current").alias("eligibility"))
    return catalog.typed_links(links, records)


@query("links_affected", f"WITH {NOTES_SQL} SELECT DISTINCT from_path, length(from_path) AS byte_start FROM lk WHERE target IN ('nowhere', 'al3', 'n10', 'n20') OR from_path IN ('d0/n14.md')")
def links_affected(spark, sf):
    keys = _note_links(spark, sf).select("from_path", F.length("from_path").cast("long").alias("byte_start"), F.array("target", "from_path").alias("keys"))
    return catalog.affected_links(keys, spark.createDataFrame([(k,) for k in ("nowhere", "al3", "n10", "n20", "d0/n14.md")], "key string"))


@query("overlay", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 NOT IN (1, 2) UNION ALL SELECT c_custkey, upper(c_name) || '!' FROM customer WHERE c_custkey % 10 = 1")
def overlay(spark, sf):
    c = model.table(spark, sf, "customer").select("c_custkey", "c_name")
    return store.overlay(c, c.filter("c_custkey % 10 = 1").select("c_custkey", F.concat(F.upper("c_name"), F.lit("!")).alias("c_name")), c.filter("c_custkey % 10 = 2").select("c_custkey"), "c_custkey")


@query("full_check", "SELECT n_nationkey, n_name, 'missing' AS side FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, n_name || '?', 'unexpected' FROM nation WHERE n_nationkey % 5 = 0")
def full_check(spark, sf):
    n = model.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return store.differences(n, n.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name"))))


@query("published_generation", "SELECT r_regionkey, r_name, 2 AS gen FROM region WHERE r_regionkey <> 3")
def published_generation(spark, sf):
    import uuid

    root = f"{store.shared_dir(spark)}/generations-{uuid.uuid4().hex}"
    r = model.table(spark, sf, "region").select("r_regionkey", "r_name")
    store.publish(r, root, 1)
    store.publish(r.filter("r_regionkey <> 3"), root, 2)
    g, rows = store.published(spark, root)
    return rows.select("r_regionkey", "r_name").withColumn("gen", F.lit(int(g)))


@query("vectors_stored", "SELECT 's' AS space, vec_id::VARCHAR AS input_hash, vec_id % 2 = 0 AS ready FROM embeddings")
def vectors_stored(spark, sf):
    u = model.units(spark, sf).select(F.lit("s").alias("space"), F.col("unit_id").cast("string").alias("input_hash"))
    held = store.put_vectors(u.filter("input_hash % 3 = 0").withColumn("ready", F.lit(False)), u)
    return store.confirm_vectors(held, u.filter("input_hash % 2 = 0"))


@query("membership_replaced", "SELECT 's' || (vec_id % 3) AS space, 1 AS snapshot, vec_id AS unit FROM embeddings WHERE vec_id % 3 <> 1 UNION ALL SELECT 's1', 1, vec_id FROM embeddings WHERE vec_id < 50")
def membership_replaced(spark, sf):
    u = model.units(spark, sf)
    old = u.select(F.concat(F.lit("s"), (F.col("unit_id") % 3).cast("string")).alias("space"), F.lit(1).alias("snapshot"), F.col("unit_id").alias("unit"))
    return store.replace_membership(old, u.filter("unit_id < 50").select(F.lit("s1").alias("space"), F.lit(1).alias("snapshot"), F.col("unit_id").alias("unit")))


@query("unit_counts", "SELECT source AS owner, sum(n_chars // 500 + 1)::BIGINT AS units, max(doc_id) AS last FROM documents GROUP BY source")
def unit_counts(spark, sf):
    return model.table(spark, sf, "documents").groupBy(F.col("source").alias("owner")).agg(F.sum(F.floor(F.col("n_chars") / 500) + 1).alias("units"), F.max("doc_id").alias("last"))


@query("distinct_ids", "SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def distinct_ids(spark, sf):
    return model.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).union(model.table(spark, sf, "customer").select("c_custkey")).distinct()


@query(
    "maintenance_queue",
    f"WITH {DOCUMENTS_SQL}, q AS (SELECT 0 AS o, 'revalidate citations' AS task, doc_id::VARCHAR AS id FROM d WHERE eligibility = 'historical' UNION SELECT 1, 'review contradiction', doc_id::VARCHAR FROM d WHERE eligibility = 'withdrawn' UNION SELECT 2, 'repair page support', doc_id::VARCHAR FROM d WHERE kind = 'page' AND record_id IS NULL) SELECT task, id FROM q ORDER BY o, id LIMIT 128",
)
def maintenance_queue(spark, sf):
    d = model.documents(spark, sf, body=False).withColumn("id", F.col("doc_id"))
    return catalog.maintenance(("revalidate citations", d.filter("eligibility = 'historical'")), ("review contradiction", d.filter("eligibility = 'withdrawn'")), ("repair page support", d.filter("kind = 'page' and record_id is null")))


RUNS_SQL = """runs AS (SELECT c_custkey AS run, c_custkey % 2 = 0 AS has_report, c_custkey % 3 = 0 AS fresh, c_custkey % 4 AS claims, c_custkey % 5 = 0 AS packet_stale FROM customer),
scopes AS (SELECT DISTINCT o_custkey AS run, 's' || o_orderkey % 300 AS source_id FROM orders),
ev AS (SELECT DISTINCT 'e' || l_orderkey || '_' || l_linenumber AS id, 's' || l_orderkey % 1000 AS source_id, 'a' || l_partkey AS assertion_id FROM lineitem),
rec AS (SELECT 'a' || p_partkey AS id, 'assertion' AS kind, 'accepted' AS status, 'current' AS eligibility, p_partkey % 6 = 0 AS disputed, p_partkey % 7 = 0 AS link_fault FROM part UNION ALL
  SELECT 'p' || s_suppkey, 'page', CASE WHEN s_suppkey % 4 = 0 THEN 'draft' ELSE 'reviewed' END, CASE WHEN s_suppkey % 3 = 0 THEN 'stale' ELSE 'current' END, false, false FROM supplier),
dep AS (SELECT DISTINCT 'p' || l_suppkey AS id, 'a' || l_partkey AS depends_on FROM lineitem WHERE l_linenumber = 1),
lk AS (SELECT DISTINCT 'p' || l_suppkey AS from_id, CASE l_linenumber WHEN 2 THEN 's' || l_orderkey % 1000 WHEN 3 THEN 'e' || l_orderkey || '_' || l_linenumber ELSE 'a' || l_partkey END AS target_id, CASE l_quantity::INT % 40 WHEN 1 THEN 'Missing' WHEN 2 THEN 'WrongKind:page' ELSE 'Resolved' END AS resolution FROM lineitem WHERE l_suppkey % 5 <> 0 OR l_quantity::INT % 40 > 2)"""


@query(
    "run_maintenance",
    f"""WITH {RUNS_SQL}, ab AS (SELECT DISTINCT run, assertion_id FROM scopes JOIN ev USING (source_id)), pg AS (SELECT * FROM rec WHERE kind = 'page' AND status = 'reviewed'),
rel AS (SELECT DISTINCT run, pg.id, pg.eligibility FROM dep JOIN pg USING (id) JOIN ab ON depends_on = assertion_id),
nm AS (SELECT run, assertion_id AS t FROM ab UNION SELECT run, ev.id FROM scopes JOIN ev USING (source_id) UNION SELECT run, source_id FROM scopes),
tk AS (SELECT run, 0 AS o, run::VARCHAR AS id FROM runs WHERE has_report AND NOT fresh UNION ALL SELECT run, 1, run::VARCHAR FROM runs WHERE has_report AND claims > 0 UNION ALL SELECT run, 2, run::VARCHAR FROM runs WHERE packet_stale
  UNION ALL SELECT run, 3, assertion_id FROM ab JOIN rec ON rec.id = assertion_id WHERE disputed UNION ALL SELECT run, 4, assertion_id FROM ab JOIN rec ON rec.id = assertion_id WHERE link_fault
  UNION ALL SELECT run, 5, id FROM rel WHERE eligibility <> 'current'
  UNION ALL SELECT run, 6, id FROM (SELECT run, id FROM rel UNION SELECT run, from_id FROM lk JOIN nm ON target_id = t JOIN pg ON pg.id = from_id) x WHERE id IN (SELECT from_id FROM lk WHERE split_part(resolution, ':', 1) IN ('Missing', 'WrongKind')))
SELECT run, row_number() OVER (PARTITION BY run ORDER BY o, id) AS place, ['revalidate_report_citations', 'review_report_for_synthesis', 'refresh_research_packet', 'review_contradiction', 'repair_evidence_navigation', 'repair_page_support', 'repair_navigation'][o + 1] AS kind, id, greatest(count(*) OVER (PARTITION BY run) - 128, 0) AS omitted FROM tk QUALIFY place <= 128""",
)
def run_maintenance(spark, sf):
    """What each customer's research run leaves to repair, by all rules."""
    t = lambda name: model.table(spark, sf, name)
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c, li, none = F.col("c_custkey"), t("lineitem"), F.lit(False)
    runs = t("customer").select(c.alias("run"), (c % 2 == 0).alias("has_report"), (c % 3 == 0).alias("fresh"), (c % 4).alias("claims"), (c % 5 == 0).alias("packet_stale"))
    scopes = t("orders").select(F.col("o_custkey").alias("run"), s("s", F.col("o_orderkey") % 300).alias("source_id")).distinct()
    item = F.concat(s("e", F.col("l_orderkey")), s("_", F.col("l_linenumber")))
    evidence = li.select(item.alias("id"), s("s", F.col("l_orderkey") % 1000).alias("source_id"), s("a", F.col("l_partkey")).alias("assertion_id")).distinct()
    p, k = F.col("p_partkey"), F.col("s_suppkey")
    asserted = t("part").select(s("a", p).alias("id"), F.lit("assertion").alias("kind"), F.lit("accepted").alias("status"), F.lit("current").alias("eligibility"), (p % 6 == 0).alias("disputed"), (p % 7 == 0).alias("link_fault"))
    pages = t("supplier").select(s("p", k).alias("id"), F.lit("page").alias("kind"), F.when(k % 4 == 0, "draft").otherwise("reviewed").alias("status"), F.when(k % 3 == 0, "stale").otherwise("current").alias("eligibility"), none.alias("disputed"), none.alias("link_fault"))
    depends = li.filter("l_linenumber = 1").select(s("p", F.col("l_suppkey")).alias("id"), s("a", F.col("l_partkey")).alias("depends_on")).distinct()
    q = F.round("l_quantity").cast("int") % 40
    target = F.when(F.col("l_linenumber") == 2, s("s", F.col("l_orderkey") % 1000)).when(F.col("l_linenumber") == 3, item).otherwise(s("a", F.col("l_partkey")))
    links = li.filter((F.col("l_suppkey") % 5 != 0) | (q > 2)).select(s("p", F.col("l_suppkey")).alias("from_id"), target.alias("target_id"), F.when(q == 1, "Missing").when(q == 2, "WrongKind:page").otherwise("Resolved").alias("resolution")).distinct()
    return catalog.run_maintenance(runs, scopes, evidence, asserted.unionByName(pages), depends, links).withColumn("place", F.col("place").cast("long"))


IDENTITY_SQL = f"""{ASSERTIONS_SQL}, k AS (SELECT s_suppkey AS k, 'supplier_' || s_suppkey AS s, 'supplier_' || (s_suppkey + 1) AS n FROM supplier WHERE s_suppkey % 2 = 1),
rq AS (SELECT k AS request, ['merge', 'split', 'alias'][k // 2 % 3 + 1] AS action, [s] AS sources, CASE k // 2 % 3 WHEN 0 THEN [n] WHEN 1 THEN [n, s || '_b'] ELSE []::VARCHAR[] END AS targets FROM k),
need AS (SELECT request, action, id AS assertion_id, 'subject' AS side, targets FROM assertions JOIN rq ON subject_id = sources[1] WHERE action <> 'alias'),
rm AS (SELECT request, assertion_id, side, CASE WHEN request % 20 = 7 THEN 'nobody' ELSE targets[length(assertion_id) % len(targets) + 1] END AS new FROM need WHERE request % 20 <> 9 OR length(assertion_id) % 4 <> 0
  UNION ALL SELECT request, 'x>y', 'object', targets[1] FROM rq WHERE request % 20 = 1 AND action <> 'alias' UNION ALL SELECT request, 'x>z', 'object', 'z' FROM rq WHERE request % 20 = 5 AND action = 'alias')"""


@query(
    "identity_requests",
    f"""WITH {IDENTITY_SQL}, why AS (SELECT request, 'missing' AS r FROM need WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.request = need.request AND rm.assertion_id = need.assertion_id AND rm.side = need.side)
  UNION SELECT request, 'alias' FROM rm JOIN rq USING (request) WHERE action = 'alias'
  UNION SELECT request, 'not a reference' FROM rm JOIN rq USING (request) WHERE action <> 'alias' AND NOT EXISTS (SELECT 1 FROM need WHERE rm.request = need.request AND rm.assertion_id = need.assertion_id AND rm.side = need.side)
  UNION SELECT request, 'not a target' FROM rm JOIN rq USING (request) WHERE action <> 'alias' AND NOT list_contains(targets, new)),
jd AS (SELECT request, coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM why WHERE why.request = rq.request), '') AS reasons FROM rq)
SELECT 'request' AS what, request::VARCHAR AS id, reasons AS subject_id, NULL AS object_id, NULL AS status FROM jd
UNION ALL SELECT 'assertion', a.id, new, object_id, CASE WHEN status = 'accepted' THEN 'proposed' ELSE status END FROM rm JOIN jd USING (request) JOIN assertions a ON a.id = assertion_id WHERE reasons = ''""",
)
def identity_requests(spark, sf):
    """Every other supplier is merged into the next, split or given an alias; some remaps are incomplete, name others or go astray."""
    k = F.col("s_suppkey")
    s = lambda c: F.concat(F.lit("supplier_"), c.cast("string"))
    action = F.element_at(F.array(*[F.lit(a) for a in ("merge", "split", "alias")]), (F.floor(k / 2) % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    requests = model.table(spark, sf, "supplier").filter("s_suppkey % 2 = 1").select(k.alias("request"), action.alias("action"), F.array(s(k)).alias("sources"), F.when(F.floor(k / 2) % 3 == 0, F.array(s(k + 1))).when(F.floor(k / 2) % 3 == 1, F.array(s(k + 1), F.concat(s(k), F.lit("_b")))).otherwise(none).alias("targets"))
    assertions = model.assertions(spark, sf)
    need = assertions.join(requests.filter("action <> 'alias'"), F.col("subject_id") == F.get("sources", F.lit(0))).select("request", F.col("id").alias("assertion_id"), F.lit("subject").alias("side"), "targets")
    size, r = F.length("assertion_id"), F.col("request")
    remap = need.filter((r % 20 != 9) | (size % 4 != 0)).select("request", "assertion_id", "side", F.when(r % 20 == 7, "nobody").otherwise(F.get("targets", size % F.size("targets"))).alias("new"))
    stray = lambda ident, cond, new: requests.filter(cond).select("request", F.lit(ident).alias("assertion_id"), F.lit("object").alias("side"), new.alias("new"))
    remap = remap.unionByName(stray("x>y", "request % 20 = 1 and action <> 'alias'", F.get("targets", F.lit(0)))).unionByName(stray("x>z", "request % 20 = 5 and action = 'alias'", F.lit("z")))
    judged, moved = catalog.identity_requests(requests, remap, assertions)
    null = F.lit(None).cast("string")
    out = judged.select(F.lit("request").alias("what"), F.col("request").cast("string").alias("id"), F.col("reasons").alias("subject_id"), null.alias("object_id"), null.alias("status"))
    return out.unionByName(moved.select(F.lit("assertion").alias("what"), "id", "subject_id", "object_id", "status"))


@query("snapshot_members", "SELECT 'space' || l_suppkey % 3 AS space, 'snap' || l_shipdate::DATE AS snapshot, count(*) AS members, count(DISTINCT l_partkey) AS inputs FROM lineitem GROUP BY ALL")
def snapshot_members(spark, sf):
    """Memberships of units by space and snapshot, and the distinct inputs that they have."""
    li = model.table(spark, sf, "lineitem")
    day = F.concat(F.lit("snap"), F.col("l_shipdate").cast("date").cast("string"))
    return li.groupBy(F.concat(F.lit("space"), (F.col("l_suppkey") % 3).cast("string")).alias("space"), day.alias("snapshot")).agg(F.count("*").alias("members"), F.countDistinct("l_partkey").alias("inputs"))


@query("record_errors", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'date,' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN 'decimal,' ELSE '' END || 'id' AS errors FROM orders")
def record_errors(spark, sf):
    k = F.col("o_orderkey")
    rows = model.table(spark, sf, "orders").select("o_orderkey", F.when(k % 6 == 0, "2024-02-30").otherwise("2024-02-29").alias("d"), F.when(k % 4 == 0, "01.5").otherwise("-1.50").alias("n"), F.lit("-bad").alias("i"))
    return rows.select("o_orderkey", scalars.errors(date=scalars.as_date(F.col("d")).isNotNull(), decimal=scalars.is_decimal(F.col("n")), id=scalars.is_record_id(F.col("i"))).alias("errors"))


@query("activation_gate", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'invalidated' ELSE 'retargeted' END AS reason FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 4")
def activation_gate(spark, sf):
    from tessera.operators import eligibility

    o = model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("current").alias("eligibility"), F.col("o_custkey").alias("target"))
    after = o.select("id", F.when(F.col("id") % 10 == 0, "invalid").otherwise("current").alias("eligibility"), F.when(F.col("id") % 15 == 4, F.col("target") + 1).otherwise(F.col("target")).alias("target"))
    return eligibility.newly_invalid(o, after)


@query("integrity", "SELECT doc_id AS id, doc_id % 8 <> 0 AND doc_id % 6 <> 0 AS ok FROM documents WHERE strlen(text) > 40")
def integrity(spark, sf):
    from tessera.operators import eligibility

    d, raw = F.col("doc_id"), F.col("text").cast("binary")
    quote = F.when(d % 6 == 0, F.lit("#never#")).otherwise(F.substring("text", 1, 12))
    rows = model.table(spark, sf, "documents").filter(F.octet_length("text") > 40)
    return eligibility.integrity(rows.select(d.alias("id"), raw.alias("content"), F.when(d % 8 == 0, "x").otherwise(F.sha2(raw, 256)).alias("hash"), quote.alias("quote"), F.lit(0).alias("start"), F.octet_length(quote).alias("end")))


@query("mentions_resolved", "SELECT o_orderkey AS assertion_id, CASE WHEN o_custkey % 5 = 4 OR o_orderkey % 5 = 4 THEN 'rejected' WHEN o_custkey % 5 IN (0, 1) AND o_orderkey % 5 IN (0, 1) THEN 'ready' ELSE 'pending' END AS state FROM orders")
def mentions_resolved(spark, sf):
    o = model.table(spark, sf, "orders")
    m = lambda c: F.concat(F.lit("m"), (F.col(c) % 5).cast("string"))
    mentions = spark.createDataFrame([(f"m{i}",) for i in range(5)], "mention string")
    resolutions = spark.createDataFrame([("m0", "create", None, None), ("m1", "bind", "e1", "h1"), ("m2", "bind", "e2", "old"), ("m4", "reject", None, None)], "mention string, action string, entity string, expected string")
    entities = spark.createDataFrame([("e1", "h1", "active"), ("e2", "h2", "active")], "id string, hash string, status string")
    return catalog.resolved_mentions(mentions, resolutions, entities, o.select(F.col("o_orderkey").alias("assertion_id"), m("o_custkey").alias("subject"), m("o_orderkey").alias("object")))


@query(
    "extraction_errors",
    """WITH q AS (SELECT doc_id AS id, text, CASE doc_id % 4 WHEN 1 THEN ' ' WHEN 2 THEN '#never#' ELSE substr(text, 1, 200) END AS quote FROM documents WHERE length(text) > 300),
r AS (SELECT id, CASE WHEN position(quote IN text) = 0 THEN 'no quote' WHEN position(quote IN substr(text, position(quote IN text) + 1)) > 0 THEN 'ambiguous quote' END AS reason FROM q)
SELECT id, reason FROM r WHERE reason IS NOT NULL UNION SELECT id, 'unknown reference' FROM q WHERE id % 6 = 0""",
)
def extraction_errors(spark, sf):
    d = F.col("doc_id")
    rows = model.table(spark, sf, "documents").filter(F.length("text") > 300)
    quote = F.when(d % 4 == 1, " ").when(d % 4 == 2, "#never#").otherwise(F.substring("text", 1, 200))
    packet = rows.select(d.alias("id"), d.alias("window"), quote.alias("quote"), F.array(F.when(d % 6 == 0, d + 1_000_000).otherwise(d)).alias("refs"))
    return catalog.extraction_errors(packet, rows.select(d.alias("window"), "text"))
