"""Queries of access by identity: unit eligibility, claims, source reads, citations, annotations, nominations, reviews, doctor."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import access, catalog, filters, search
from tessera.plans import indexes
from tessera.plans.q_search import _COLS, QUERY, TK_SQL, _index_bm25_sql
from tessera.plans.registry import query
from tessera.sources import model, store, vault
from tessera.sources.model import ASSERTIONS_SQL, DOCUMENTS_SQL

NORMAL = "coalesce(record_id, source_id) IS NOT NULL AND eligibility IN ('current', 'stale') AND coalesce(status, '') <> 'draft' AND trim(body) <> ''"


def _s(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def _md5(c):
    return F.md5(c.cast("string").cast("binary"))


@query("units_allowed", f"WITH {DOCUMENTS_SQL} SELECT vec_id AS unit_id FROM embeddings JOIN d ON doc_id = vec_id WHERE coalesce(record_id, source_id) IS NOT NULL AND kind IN ('page', 'entity') AND (({NORMAL}) OR (kind = 'entity' AND status <> 'deprecated' AND eligibility <> 'current'))")
def units_allowed(spark, sf):
    """Units whose owner passes the filters and the normal or the identity policy."""
    docs = indexes.documents(spark, sf).rows
    owners = docs.select(F.col("doc_id").alias("unit_id"), F.col("path").alias("owner"))
    units = model.units(spark, sf).select("unit_id").join(owners, "unit_id")
    policy = filters.normal_policy(F.col("blank")) | filters.identity_policy()
    return access.allowed_units(units, docs, filters.Filters(kinds=["page", "entity"]), policy).select("unit_id")


@query(
    "units_current",
    f"""WITH {DOCUMENTS_SQL}, u AS (SELECT 'u' || doc_id AS unit_id, path AS owner, md5(doc_id::VARCHAR) AS input_hash, doc_id, eligibility, kind FROM d)
SELECT unit_id, owner, input_hash FROM u WHERE doc_id % 13 <> 0 AND doc_id % 9 <> 0 AND eligibility = 'current' AND kind = 'page' AND unit_id > 'u2' ORDER BY unit_id LIMIT 128""",
)
def units_current(spark, sf):
    """A page of descriptors of units that were rendered from what their documents are now."""
    d, k = model.documents(spark, sf, body=False), F.col("doc_id")
    units = d.select(F.lit("p").alias("policy"), F.col("path").alias("owner"), _s("u", k).alias("unit_id"), _md5(k).alias("input_hash"))
    owners = d.select(F.lit("p").alias("policy"), F.col("path").alias("owner"), _md5(F.when(k % 9 == 0, -k).otherwise(k)).alias("source_hash"), (k % 13 == 0).alias("tombstone"))
    out = access.current_units(units, owners, d.withColumn("file_hash", _md5(k)))
    return catalog.keyset_page(out, "unit_id", "u2", 128)


@query("records_unregistered", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def records_unregistered(spark, sf):
    registry = model.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")).distinct()
    return access.unregistered(model.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), registry)


def _identity(spark, sf):
    """Ids of records, of claims, of endpoints, of link keys and of facts, and the ids that are asked for."""
    asked = model.table(spark, sf, "orders").select(_s("id", F.col("o_orderkey")).alias("id"))
    claims = model.table(spark, sf, "customer").select(_s("id", F.col("c_custkey") * 2).alias("id"), _s("claim/", F.col("c_custkey")).alias("path"))
    records = model.table(spark, sf, "part").select(_s("id", F.col("p_partkey") * 3).alias("id"), _s("record/", F.col("p_partkey")).alias("path"))
    return asked, claims, records


@query(
    "identity_claims",
    "WITH a AS (SELECT 'id' || o_orderkey AS id FROM orders) SELECT id, 'claim/' || c_custkey AS path, 'claim' AS claimed_by FROM customer JOIN a ON id = 'id' || (c_custkey * 2) UNION SELECT id, 'record/' || p_partkey, 'record' FROM part JOIN a ON id = 'id' || (p_partkey * 3)",
)
def identity_claims(spark, sf):
    return access.claims_of(*_identity(spark, sf))


@query(
    "identity_reserved",
    """WITH a AS (SELECT 'id' || o_orderkey AS id FROM orders), p AS (SELECT 0 AS n, 'claim' AS name, 'id' || (c_custkey * 2) AS id FROM customer UNION ALL SELECT 1, 'record', 'id' || (p_partkey * 3) FROM part
  UNION ALL SELECT 2, 'edge', 'id' || (s_suppkey * 5) FROM supplier UNION ALL SELECT 3, 'link', 'id' || (o_custkey * 7) FROM orders UNION ALL SELECT 4, 'fact', 'id' || (n_nationkey * 11) FROM nation)
SELECT id, arg_min(name, n) AS taken_by FROM p JOIN a USING (id) GROUP BY id""",
)
def identity_reserved(spark, sf):
    asked, claims, records = _identity(spark, sf)
    of = lambda t, c, n: model.table(spark, sf, t).select(_s("id", F.col(c) * n).alias("id"))
    return access.reserved(asked, {"claim": claims, "record": records, "edge": of("supplier", "s_suppkey", 5), "link": of("orders", "o_custkey", 7), "fact": of("nation", "n_nationkey", 11)})


@query(
    "sources_read",
    """WITH c AS (SELECT conv_id::VARCHAR AS source_id, conv_id || '-' || turn AS revision, turn, CASE WHEN turn % 4 <> 3 THEN text END AS text, max(turn) OVER (PARTITION BY conv_id) AS last, conv_id % 10 = 0 AS withdrawn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
q AS (SELECT 's' || source_id AS request, 0 AS start, * FROM c WHERE turn = last UNION ALL SELECT 'r' || revision, 5, * FROM c WHERE turn = 1)
SELECT request, source_id, revision, CASE WHEN withdrawn THEN 'withdrawn' WHEN text IS NULL THEN 'unsupported' WHEN turn <> last THEN 'historical' ELSE 'current' END AS state,
  CASE WHEN text IS NULL THEN NULL WHEN strlen(text) <= start THEN '' ELSE substr(text, start + 1, 40) END AS text, coalesce(start + 40 < strlen(text), false) AS more FROM q WHERE text IS NULL OR regexp_full_match(text, '[\\x00-\\x7F]*')
UNION ALL SELECT 'x', NULL, NULL, 'missing', NULL, false""",
)
def sources_read(spark, sf):
    """The head of every source's current revision, a slice of every source's second turn, and an id that isn't there; texts in ASCII, which SQL can slice."""
    c = model.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    c = c.withColumn("text", F.when(F.col("turn") % 4 != 3, F.col("text"))).withColumn("source_id", F.col("conv_id").cast("string")).withColumn("revision", F.concat("source_id", F.lit("-"), F.col("turn").cast("string")))
    sources = c.groupBy("conv_id", "source_id").agg(F.max("turn").alias("last")).select("source_id", F.when(F.col("conv_id") % 10 == 0, "withdrawn").otherwise("active").alias("status"), F.concat("source_id", F.lit("-"), F.col("last").cast("string")).alias("current_revision"))
    heads = sources.select(F.concat(F.lit("s"), "source_id").alias("request"), F.col("source_id").alias("id"), F.lit(0).cast("long").alias("start"))
    second = c.filter("turn = 1").select(F.concat(F.lit("r"), "revision").alias("request"), F.col("revision").alias("id"), F.lit(5).cast("long").alias("start"))
    none = spark.createDataFrame([("x", "nowhere", 0)], "request string, id string, start long")
    out = access.read_source(heads.unionByName(second).unionByName(none), sources, c.select("revision", "source_id", "text"), 40)
    plain = c.filter(F.col("text").isNull() | F.col("text").rlike(r"^[\x00-\x7F]*$")).select("revision")
    return out.join(plain.withColumn("ok", F.lit(True)), "revision", "left").filter("ok or state = 'missing'").select("request", "source_id", "revision", "state", "text", "more")


@query(
    "excerpts_cited",
    f"""WITH {DOCUMENTS_SQL}, e AS (SELECT path, eligibility, source_id, substr(body, 1, 40) || CASE WHEN doc_id % 6 = 0 THEN '!' ELSE '' END AS excerpt, doc_id FROM d WHERE length(body) > 50)
SELECT path, 0::BIGINT AS start, strlen(excerpt) AS "end", sha256(excerpt) AS hash, source_id IS NOT NULL AND eligibility IN ('current', 'stale') AND doc_id % 6 <> 0 AS citable FROM e""",
)
def excerpts_cited(spark, sf):
    """Excerpts of notes; every sixth ends with a mark and its note has had another one put in that place since, so that it isn't what the note says."""
    d = model.documents(spark, sf)
    part = F.concat(F.substring("body", 1, 40), F.when(F.col("doc_id") % 6 == 0, "!").otherwise(""))
    e = d.filter(F.length("body") > 50).select("path", F.lit(0).cast("long").alias("start"), F.octet_length(part).cast("long").alias("end"), part.alias("excerpt"))
    since = F.when(F.col("doc_id") % 6 == 0, F.concat(F.substring("body", 1, 40), F.lit("?"), F.expr("substring(body, 41)"))).otherwise(F.col("body"))
    return access.cited(e, d.withColumns({"verified": F.col("source_id").isNotNull(), "body": since})).drop("excerpt")


@query("annotations_found", "SELECT 'cap/' || o_orderkey AS path, 'ann/' || o_orderkey AS annotation_path, 'ea' || o_orderkey AS annotation_id, 'er' || o_orderkey AS raw_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 40 % 10 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0")
def annotations_found(spark, sf):
    """Annotations of orders; each condition of the eight joins fails for some of them."""
    o, k = model.table(spark, sf, "orders"), F.col("o_orderkey")
    src, rev = _s("src_", k % 40), _s("rev_", k)
    rows = o.select(_s("ann/", k).alias("annotation_path"), _md5(k).alias("annotation_hash"), src.alias("source_id"), rev.alias("revision_id"), _md5(-k).alias("source_raw_hash"), _s("raw/", k).alias("raw_path"), _md5(_s("g", k)).alias("generation_hash"))
    documents = o.select(_s("cap/", k).alias("path"), _md5(F.when(k % 7 == 0, 0).otherwise(-k)).alias("file_hash"), src.alias("source_id"), rev.alias("owner_revision"), F.lit("current").alias("eligibility"))
    state = lambda bad: F.when(bad, "withdrawn").otherwise("current").alias("eligibility")
    number = F.substring("id", 5, 9).cast("int")
    records = o.select(src.alias("id")).distinct().select("id", F.lit("source").alias("kind"), F.concat(F.lit("p/"), "id").alias("path"), _md5(F.col("id")).alias("hash"), state(number % 10 == 0))
    records = records.unionByName(o.select(rev.alias("id"), F.lit("revision").alias("kind"), F.concat(F.lit("p/"), rev).alias("path"), _md5(rev).alias("hash"), state(k % 11 == 0)))
    event = lambda name, path, hash_: o.select(_s(name, k).alias("id"), F.lit("run_event").alias("kind"), path.alias("path"), hash_.alias("hash"), F.lit("current").alias("eligibility"))
    records = records.unionByName(event("ea", _s("ann/", k), _md5(k))).unionByName(event("er", _s("raw/", k), _md5(F.when(k % 5 == 0, "old").otherwise(_s("g", k)))))
    needs = lambda ident: o.select(_s("ann/", k).alias("annotation_path"), F.concat(F.lit("p/"), ident).alias("path"), _md5(F.when(k % 13 == 0, "old").otherwise(ident)).alias("expected_hash"))
    return access.annotations(rows, documents, records, needs(src).unionByName(needs(rev)))


@query(
    "paths_connected",
    f"""WITH {ASSERTIONS_SQL}, s AS (SELECT id, subject_id, object_id FROM assertions WHERE predicate = 'located_in'), n AS (SELECT id, subject_id, object_id FROM assertions WHERE predicate = 'part_of')
SELECT s.id AS path_id, length(s.id) % 3 <> 0 AND length(s.id) % 7 <> 0 AS connected FROM s JOIN n ON s.object_id = n.subject_id""",
)
def paths_connected(spark, sf):
    """Paths of two steps from where customers and suppliers are to a region; some go the wrong way and some don't end at their target."""
    a = model.assertions(spark, sf)
    s = a.filter("predicate = 'located_in'").select("id", F.col("object_id").alias("nation"))
    n = a.filter("predicate = 'part_of'").select(F.col("id").alias("up"), F.col("subject_id").alias("nation"))
    step = lambda i, d: F.struct(i.alias("id"), d.alias("direction"))
    wrong = F.length("id") % 3 == 0
    paths = s.join(n, "nation").select(F.col("id").alias("path_id"), F.when(F.length("id") % 7 == 0, F.col("id")).otherwise(F.col("up")).alias("target"), F.array(step(F.col("id"), F.when(wrong, "incoming").otherwise("outgoing")), step(F.col("up"), F.lit("outgoing"))).alias("steps"))
    return access.connected_paths(paths, a)


@query("relations_nominated")
def relations_nominated(spark, sf):
    """Dependencies of the rules of each source, eight orders' lines each, from its first one."""
    li = model.table(spark, sf, "lineitem")
    source, node = F.floor(F.col("l_orderkey") / 8), F.concat(F.lit("n"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("s"))
    rows = one.select(source.alias("source"), node.alias("node"), (F.col("s.l_partkey") * 7 % 4000).alias("start"), F.col("s.l_quantity").cast("long").alias("size"), "l_orderkey", "l_linenumber")
    nodes = rows.select("source", "node", "start", (F.col("start") + F.col("size") * 24).alias("end"))
    to = F.concat(F.lit("n"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(F.col("l_orderkey") - 1).cast("string"), F.lit("_"), (F.col("l_linenumber") % 3 + 1).cast("string"))
    edges = rows.select("source", F.col("node").alias("node_from"), to.alias("node_to"), F.col("l_linenumber").cast("long").alias("ordinal"), (F.col("start") + 5000).alias("start"), (F.col("start") + 5000 + F.col("size")).alias("end"))
    anchors = rows.filter("l_linenumber <= 2").select("source", "node", F.col("l_linenumber").alias("rank"))
    return access.nominate(anchors, nodes, edges.join(nodes.select("source", F.col("node").alias("node_to")), ["source", "node_to"], "left_semi"), text_bytes=4000)


@query(
    "reviews_planned",
    """WITH e AS (SELECT l_orderkey AS a, l_linenumber AS n, CASE WHEN min(l_returnflag) = 'R' THEN 'contradicts' ELSE 'supports' END AS stance, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
c AS (SELECT *, CASE p % 5 WHEN 0 THEN NULL WHEN 1 THEN 'insufficient' WHEN 2 THEN 'contradicts' ELSE stance END AS assessment FROM e),
s AS (SELECT a, count(*) FILTER (n <> 7 AND assessment IS NULL) AS open, count(*) FILTER (n <> 7 AND assessment = stance) AS unchanged, count(*) FILTER (n <> 7 AND assessment <> stance) AS retract, count(*) FILTER (n <> 7 AND assessment <> stance AND assessment <> 'insufficient') AS successors,
  count(*) FILTER (n <> 7 AND assessment = 'supports') AS support, count(*) FILTER (n = 7 AND assessment IS NOT NULL) AS stray FROM c GROUP BY a)
SELECT a AS assertion_id, CASE WHEN stray > 0 THEN 'unknown evidence' WHEN open > 0 THEN 'uncovered' WHEN a % 2 = 0 AND support = 0 THEN 'needs support' WHEN a % 2 = 0 THEN 'accept' ELSE 'reject' END AS outcome, unchanged, retract, successors FROM s""",
)
def reviews_planned(spark, sf):
    """Reviews of orders as assertions, with their lines as evidence; the seventh line is retracted."""
    e = model.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.when(F.min("l_returnflag") == "R", "contradicts").otherwise("supports").alias("stance"), F.min("l_partkey").alias("p"))
    e = e.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumnRenamed("l_orderkey", "assertion_id").withColumn("status", F.when(F.col("l_linenumber") == 7, "retracted").otherwise("active"))
    p = F.col("p") % 5
    checks = e.select("id", F.when(p == 0, None).when(p == 1, "insufficient").when(p == 2, "contradicts").otherwise(F.col("stance")).alias("assessment")).filter("assessment is not null")
    decisions = e.select("assertion_id").distinct().withColumn("decision", F.when(F.col("assertion_id") % 2 == 0, "accept").otherwise("reject"))
    return access.review_plan(decisions, e.select("id", "assertion_id", "stance", "status"), checks)


@query("submissions_taken", "WITH s AS (SELECT user_id AS packet, event_id AS ordinal, event_type AS hash FROM events) SELECT packet, ordinal, CASE WHEN row_number() OVER w = 1 THEN 'consumed' WHEN hash = first(hash) OVER w THEN 'unchanged' ELSE 'conflict' END AS outcome FROM s WINDOW w AS (PARTITION BY packet ORDER BY ordinal)")
def submissions_taken(spark, sf):
    return access.submissions(model.ledger(spark, sf).select(F.col("user_id").alias("packet"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("hash")))


@query("fallback_lexical", f"WITH {DOCUMENTS_SQL}, {TK_SQL}, {_index_bm25_sql(QUERY, _COLS, 'b')} SELECT path, round(score, 6) AS score, 'lexical' AS mode, 'offline' AS reason FROM b ORDER BY round(score, 6), path LIMIT 20")
def fallback_lexical(spark, sf):
    """A semantic search whose service is offline: the lexical one answers and says so."""

    def semantic():
        raise access.Unavailable("offline")

    def lexical():
        scored = search.bm25_index_form(indexes.documents(spark, sf), QUERY, search.DOCUMENT_WEIGHTS).withColumn("score", F.round("score", 6))
        return scored.orderBy("score", "path").limit(20)

    return access.search_or_fall_back(semantic, lexical)


@query(
    "doctor",
    f"""WITH {DOCUMENTS_SQL}, c AS (SELECT 'index' AS "check", 0::BIGINT AS found UNION ALL SELECT 'duplicate ids', count(*) FROM (SELECT doc_id % 900 FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL
  SELECT 'orders without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) UNION ALL SELECT 'withdrawn or invalid', count(*) FROM d WHERE eligibility IN ('withdrawn', 'invalid'))
SELECT "check", found, found = 0 AS ok FROM c""",
)
def doctor(spark, sf):
    from tessera.sources.index import unmatched

    d = F.col("doc_id")
    docs = model.table(spark, sf, "documents").select(_s("id-", d % 900).alias("record_id"), _s("p/", d).alias("path"))
    lost = model.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).join(model.table(spark, sf, "customer").filter("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("id")), "id", "left_anti")
    gone = model.documents(spark, sf, body=False).filter(F.col("eligibility").isin("withdrawn", "invalid"))
    return access.doctor({"index": unmatched(indexes.documents(spark, sf)), "duplicate ids": catalog.duplicate_ids(docs), "orders without customer": lost, "withdrawn or invalid": gone})


@query("decision_sets", "SELECT user_id AS id, array_to_string(list_sort(list_distinct(list_filter(list(event_id % 20), lambda x: x % 3 = 0))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(list(event_id % 20), lambda x: x % 3 = 1))), ',') AS extra FROM events GROUP BY user_id")
def decision_sets(spark, sf):
    """Decisions' expected and actual ids, compared both ways: every third id is missing from the actual ones and every third was not expected."""
    e = model.ledger(spark, sf).withColumn("x", F.col("event_id") % 20).groupBy("user_id").agg(F.collect_set(F.when(F.col("x") % 3 != 1, F.col("x"))).alias("expected"), F.collect_set(F.when(F.col("x") % 3 != 0, F.col("x"))).alias("actual"))
    return catalog.set_differences(e.withColumnRenamed("user_id", "id"))


@query("documents_joined_records", f"WITH {DOCUMENTS_SQL} SELECT path, 'rec-' || p_partkey AS record, p_brand AS kind FROM d LEFT JOIN part ON record_id = 'rec-' || p_partkey AND p_partkey % 5 <> 0")
def documents_joined_records(spark, sf):
    """All documents, with their canonical record where there is one."""
    records = model.table(spark, sf, "part").filter("p_partkey % 5 <> 0").select(_s("rec-", F.col("p_partkey")).alias("record"), F.col("p_brand").alias("kind"))
    d = model.documents(spark, sf, body=False).select("path", "record_id")
    return d.join(records, F.col("record_id") == F.col("record"), "left").select("path", "record", "kind")


@query("source_map", "SELECT page_id, len(list_filter(list_transform(string_split(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS mapped, true AS same FROM pages WHERE mapped > 0")
def source_map(spark, sf):
    """Readable runs of pages, each mapped back to the bytes that it came from, and whether they are the same."""
    p = model.table(spark, sf, "pages").select("page_id", "html")
    out = text.mapped(p, _html_runs, ("html",), RUNS, ("page_id", "html")).filter(F.size("runs") > 0)
    return out.select("page_id", F.size("runs").cast("long").alias("mapped"), _same("html").alias("same"))


#: A text's readable runs as one row, so that the text goes along once and isn't repeated and grouped again for each run.
RUNS = "runs array<struct<run:string,start:bigint,end:bigint>>"


def _html_runs(html):
    return [(text.readable(html),)]


def _markdown_runs(note):
    return [(text.readable_markdown(note),)]


def _same(of):
    """Whether every one of the runs is the bytes of its span."""
    return F.forall("runs", lambda x: text.byte_slice(F.col(of), x["start"], x["end"]) == x["run"])


@query("citations_declared", "SELECT doc_id, source AS source_id, 'r' || (doc_id % 9) AS revision, doc_id % 50 AS start, doc_id % 50 + 10 AS \"end\" FROM documents WHERE doc_id % 4 = 0 AND source IS NOT NULL")
def citations_declared(spark, sf):
    """Citations of pages made of documents: every fourth has one block, the others none, two or a broken one."""
    d = F.col("doc_id")
    line = F.to_json(F.struct(F.col("source").alias("source_id"), _s("r", d % 9).alias("revision"), (d % 50).alias("start"), (d % 50 + 10).alias("end")))
    block = F.concat(F.lit("<!-- citations\n"), line, F.lit("\n-->"))
    page = F.when(d % 4 == 0, F.concat("text", F.lit("\n"), block)).when(d % 4 == 1, F.concat(block, F.lit("\n"), "text", F.lit("\n"), block)).when(d % 4 == 2, F.concat(F.lit("<!-- citations\n{oops\n-->"), "text")).otherwise(F.col("text"))
    rows = model.table(spark, sf, "documents").filter("source is not null").select("doc_id", page.alias("page"))
    return text.mapped(rows, text.page_citations, ("page",), "source_id string, revision string, start long, end long", ("doc_id",))


@query("captures_published", "WITH c AS (SELECT doc_id AS id, source AS source_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 AS g, doc_id % 13 = 0 AS bad FROM documents WHERE source IS NOT NULL) SELECT id, source_id, g::BIGINT AS \"group\", CASE WHEN bad THEN 'unsupported' ELSE 'complete' END AS outcome FROM c")
def captures_published(spark, sf):
    """Captures of each source in groups of four, each group published whole and twice with the same result; an item that can't be read fails alone."""
    from tessera.streaming import ledger

    d = F.col("doc_id")
    raw = F.when(d % 13 == 0, F.concat(F.lit(b"\xff"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    rows = model.table(spark, sf, "documents").filter("source is not null").select(d.alias("id"), F.col("source").alias("source_id"), raw.alias("bytes"))
    grouped = ledger.groups(rows, ["id"])
    states = catalog.capture(grouped).select("id", F.col("status").alias("outcome"))
    batch = grouped.select("id", "source_id", "group").join(states, "id")
    root = f"{store.shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    put = ledger.publisher(root, "id")
    for number in (0, 1, 1):  # the second batch is repeated
        put(batch.filter(F.col("group") % 2 == number), number)
    return spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(root)


@query("progress_lines", "SELECT '{\"type\":\"progress\",\"run\":' || user_id || ',\"done\":' || count(*) || '}' AS value FROM events GROUP BY user_id")
def progress_lines(spark, sf):
    """A progress stream's lines: a JSON object for each run."""
    from tessera.streaming import ledger

    return ledger.progress(model.ledger(spark, sf).groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("done")), "progress")


@query("manifest_resumed", "SELECT page_id AS ordinal, 'p/' || page_id || '.html' AS path, strlen(html) AS byte_len FROM pages WHERE page_id > 40 AND page_id <= 140")
def manifest_resumed(spark, sf):
    """A manifest of the pages as JSON lines, read again from where a batch of a hundred items stopped."""
    p, k = model.table(spark, sf, "pages"), F.col("page_id")
    items = p.select(F.lit("item").alias("type"), k.alias("ordinal"), F.concat(F.lit("p/"), k.cast("string"), F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("byte_len"))
    root = f"{store.shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    items.write.json(root)
    return vault.manifest_page(vault.manifest(spark, root), 40, 100).select("ordinal", "path", "byte_len")


@query(
    "journal_checked",
    "WITH j AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id, count(*) OVER (PARTITION BY user_id) AS c FROM events), f AS (SELECT *, n + CASE WHEN event_id % 37 = 0 THEN 1000 ELSE 0 END AS sequence, event_id % 29 = 0 AS torn FROM j), b AS (SELECT *, lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence) AS before, lead(sequence) OVER (PARTITION BY run_id ORDER BY sequence) IS NULL AS last FROM f) SELECT run_id::VARCHAR AS run_id, sequence, CASE WHEN torn AND NOT last THEN 'checksum' ELSE 'gap' END AS reason FROM b WHERE (torn AND NOT last) OR sequence <> coalesce(before + 1, 1)",
)
def journal_checked(spark, sf):
    """The events as frames of a journal, written and read again: broken checksums and gaps."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = model.ledger(spark, sf).withColumn("sequence", n + F.when(F.col("event_id") % 37 == 0, 1000).otherwise(0)).withColumn("payload", F.col("event_type"))
    frames = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("sequence").cast("long").alias("sequence"), "event_type", F.when(F.col("event_id") % 29 == 0, "x").otherwise(F.sha2("payload", 256)).alias("checksum"), "payload")
    root = f"{store.shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    frames.write.json(root)
    return vault.journal_errors(vault.journal(spark, root))


@query("delta_applied", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN upper(c_name) || '!!' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 10 NOT IN (2, 3) OR c_custkey % 20 = 3")
def delta_applied(spark, sf):
    """A base and three deltas of affected rows alone: writes, deletes, and a deleted row that comes back."""
    root = f"{store.shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    c = model.table(spark, sf, "customer").select("c_custkey", "c_name")
    keys = lambda cond: c.filter(cond).select("c_custkey")
    store.publish(c, root, 1)
    loud = lambda mark: c.filter("c_custkey % 10 = 1").select("c_custkey", F.concat(F.upper("c_name"), F.lit(mark)).alias("c_name"))
    store.put_delta(loud("!"), keys("c_custkey % 10 in (2, 3)"), root, 1, 1)
    store.put_delta(loud("!!"), keys("false"), root, 1, 2)
    store.put_delta(c.filter("c_custkey % 20 = 3"), keys("false"), root, 1, 3)
    return store.with_deltas(spark, root, "c_custkey")


@query("rebuilt_beside", "SELECT n_nationkey, lower(n_name) AS n_name, 2 AS gen FROM nation")
def rebuilt_beside(spark, sf):
    """A rebuild into a generation beside the published one, which is checked before the pointer moves; one that fails its check leaves it."""
    root = f"{store.shared_dir(spark)}/rebuilt-{uuid.uuid4().hex}"
    n = model.table(spark, sf, "nation").select("n_nationkey", "n_name")
    lower = n.select("n_nationkey", F.lower("n_name").alias("n_name"))
    store.publish(n, root, 1)
    store.rebuild(spark, root, lambda: lower, lambda rows: rows.count() == n.count())
    try:
        store.rebuild(spark, root, lambda: lower.limit(3), lambda rows: rows.count() == n.count())
    except ValueError:
        pass
    g, rows = store.published(spark, root)
    return rows.select("n_nationkey", "n_name").withColumn("gen", F.lit(int(g)))


@query("lifecycle_states", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_orderkey % 40 = 0 THEN 'withdrawn' WHEN l_linenumber = 1 AND l_tax < 0.02 THEN 'historical' WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN 'unsupported' WHEN l_returnflag = 'R' THEN 'historical' ELSE 'current' END AS state FROM lineitem")
def lifecycle_states(spark, sf):
    from tessera.operators import eligibility

    li, n = model.table(spark, sf, "lineitem"), F.col("l_linenumber")
    rows = li.select(F.col("l_orderkey").alias("id"), n.alias("line"), F.when(n == 1, "revision").when(n == 2, "assertion").otherwise("page").alias("kind"), F.when(F.col("l_returnflag") == "A", "proposed").when(F.col("l_returnflag") == "R", "superseded").otherwise("active").alias("status"), (F.col("l_orderkey") % 40 == 0).alias("withdrawn"), (F.col("l_tax") < 0.02).alias("older"))
    return rows.select("id", "line", eligibility.lifecycle().alias("state"))


@query("packets_handed")
def packets_handed(spark, sf):
    """Each run's research packet: explicit ranges first, spans around others in their place."""
    li = model.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("s"))
    start = F.col("s.l_partkey") * 17 % 600
    p = li.select(F.floor(F.col("l_orderkey") / 16).alias("run"), (F.col("l_orderkey") % 4).alias("owner"), start.alias("start"), (start + F.col("s.l_quantity").cast("long") * 16).alias("end"), (F.col("l_linenumber") == 5).alias("explicit"), (F.col("s.l_partkey") % 50).alias("rank"))
    return access.research_packet(p, 12, 6000)


@query(
    "records_decoded",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not a record' WHEN o_orderkey % 13 = 0 THEN 'too large' WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'day,kind' WHEN o_orderkey % 7 = 0 THEN 'day' WHEN o_orderkey % 5 = 0 THEN 'kind' ELSE '' END AS errors, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_custkey END AS customer, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey % 28 + 1 END AS day FROM orders",
)
def records_decoded(spark, sf):
    """Orders as stored JSON rows, decoded into a typed record: some are broken, too large, of an unknown kind or of a day that isn't there."""
    from tessera.functions import scalars

    k = F.col("o_orderkey")
    day = F.when(k % 7 == 0, "2024-02-30").otherwise(F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
    made = F.to_json(F.struct(F.when(k % 5 == 0, "other").otherwise("order").alias("kind"), day.alias("day"), F.col("o_custkey").alias("customer")))
    json = F.when(k % 11 == 0, F.lit("{oops")).when(k % 13 == 0, F.concat(made, F.repeat(F.lit(" "), 400))).otherwise(made)
    checks = {"kind": F.col("record.kind") == "order", "day": scalars.as_date(F.col("record.day")).isNotNull()}
    out = access.decoded(model.table(spark, sf, "orders").select("o_orderkey", json.alias("json")), "kind string, day string, customer long", checks, 300)
    return out.select("o_orderkey", "errors", F.col("record.customer").alias("customer"), F.dayofmonth(scalars.as_date(F.col("record.day"))).cast("long").alias("day"))


@query(
    "evidence_created",
    """WITH q AS (SELECT doc_id, source, text, CASE doc_id % 4 WHEN 0 THEN substr(text, 10, 40) WHEN 1 THEN 'the' WHEN 2 THEN '#never#' ELSE substr(text, 1, 60) END AS quote, doc_id % 9 = 5 AS gone FROM documents WHERE length(text) > 80),
p AS (SELECT *, CASE WHEN NOT gone AND position(quote IN text) > 0 AND position(quote IN substr(text, position(quote IN text) + 1)) = 0 THEN strlen(substr(text, 1, position(quote IN text) - 1)) END AS place FROM q)
SELECT doc_id AS id, CASE WHEN gone THEN 'no source' WHEN place IS NOT NULL THEN '' WHEN contains(text, quote) THEN 'ambiguous quote' ELSE 'no quote' END AS error, place AS span_start, place + strlen(quote) AS span_end, CASE WHEN place IS NOT NULL THEN sha256(quote) END AS quote_hash FROM p""",
)
def evidence_created(spark, sf):
    """Evidence records of quotes: some stand once, some often, some never, some in sources that aren't there."""
    d, k = model.table(spark, sf, "documents").filter(F.length("text") > 80), F.col("doc_id")
    quote = F.when(k % 4 == 0, F.substring("text", 10, 40)).when(k % 4 == 1, "the").when(k % 4 == 2, "#never#").otherwise(F.substring("text", 1, 60))
    claims = d.select(k.alias("id"), _s("a", k).alias("assertion_id"), k.alias("source_id"), F.lit("supports").alias("stance"), quote.alias("quote"))
    revisions = d.filter("doc_id % 9 <> 5").select(k.alias("source_id"), F.lit(1).alias("revision"), "text")
    return catalog.new_evidence(claims, revisions).select("id", "error", "span_start", "span_end", "quote_hash")


@query("pages_put", "SELECT 'p' || page_id AS path, CASE WHEN page_id % 10 = 3 THEN 'conflict' WHEN page_id % 10 = 4 THEN 'unchanged' ELSE 'held' END AS outcome FROM pages WHERE page_id % 2 = 0 OR page_id % 10 = 3")
def pages_put(spark, sf):
    """Guarded writes: a writer that saw other bytes conflicts, which holds the batch's other writes."""
    p, k = model.table(spark, sf, "pages"), F.col("page_id")
    pages = p.filter("page_id % 10 <> 8").select(_s("p", k).alias("path"), F.col("html").alias("text"))
    seen = F.when(k % 10 == 3, "other").when(k % 10 != 8, F.sha2(F.col("html").cast("binary"), 256))
    writes = p.filter("page_id % 2 = 0 or page_id % 10 = 3").select(_s("p", k).alias("path"), seen.alias("expected"), F.when(k % 10 == 4, F.col("html")).otherwise(F.concat("html", F.lit("!"))).alias("text"))
    return store.put_pages(pages, writes)


@query(
    "replies_checked",
    """WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN -1 ELSE 0 END::BIGINT AS start, CASE doc_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 4 WHEN 3 THEN strlen(text) + 1 ELSE strlen(text) END::BIGINT AS "end" FROM documents WHERE strlen(text) > 30)
SELECT doc_id AS key, start, "end", CASE WHEN doc_id % 7 = 0 THEN 'not shown' WHEN doc_id % 6 = 0 THEN 'empty' WHEN doc_id % 6 IN (2, 3) THEN 'outside' WHEN doc_id % 6 = 4 THEN 'twice' END AS reason FROM r WHERE doc_id % 6 <> 1 AND (doc_id % 7 = 0 OR doc_id % 6 <> 5)""",
)
def replies_checked(spark, sf):
    """Ranges of replies against the originals that were shown; a range inside a text, which may cut a character, is left to a test."""
    from tessera.operators import context

    d, k = model.table(spark, sf, "documents").filter(F.octet_length("text") > 30), F.col("doc_id")
    size = F.octet_length("text").cast("long")
    start = F.when(k % 6 == 0, 5).when(k % 6 == 1, 7).when(k % 6 == 2, -1).otherwise(0).cast("long")
    end = F.when(k % 6 == 0, F.lit(5).cast("long")).when(k % 6 == 1, F.lit(20).cast("long")).when(k % 6 == 2, F.lit(4).cast("long")).when(k % 6 == 3, size + 1).otherwise(size)
    replies = d.filter("doc_id % 6 <> 1").select(F.lit(1).alias("request"), k.alias("key"), start.alias("start"), end.alias("end"))
    replies = replies.unionByName(replies.filter("key % 6 = 4"))
    return context.reply_errors(replies, d.filter("doc_id % 7 <> 0").select(F.lit(1).alias("request"), k.alias("key"), "text")).drop("request")


@query("markdown_mapped", "SELECT doc_id, true AS same, true AS found FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def markdown_mapped(spark, sf):
    """Readable runs of notes of Markdown: each is the bytes of its span, and what was put between marks is found without them."""
    note = F.concat(F.lit("# Head *one* #\n- see [a label](far/away.md) and [[n1|other]]\n```\ncode line\n```\n<b>bold</b> "), "text")
    rows = model.table(spark, sf, "documents").filter(~F.col("text").rlike(r"^[ \t\n\x0B\f\r]*$")).select("doc_id", note.alias("note"))
    out = text.mapped(rows, _markdown_runs, ("note",), RUNS, ("doc_id", "note"))
    want = ["Head", "one", "see", "a label", "and", "other", "code line", "bold"]
    runs = F.transform(F.slice("runs", 1, len(want)), lambda x: x["run"])  # they come in order
    return out.select("doc_id", _same("note").alias("same"), (runs == F.array(*[F.lit(w) for w in want])).alias("found"))
