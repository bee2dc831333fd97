"""Queries of text functions: stems, function words, spans, quotes, segments, blocks, excerpts, links, readable HTML, notes, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.operators import render
from tessera.plans.q_search import GRAPH_ROWS_SQL
from tessera.plans.registry import query
from tessera.sources import model
from tessera.sources.model import ASSERTIONS_SQL, ENTITIES_SQL, TOKENS_SQL

STEM_SQL = """CASE WHEN NOT regexp_full_match(t, '[\\x00-\\x7F]{5,}') THEN t ELSE regexp_replace(s, '^(.{4,})e$', '\\1') END"""


@query(
    "term_stems",
    f"""WITH w AS (SELECT DISTINCT unnest({TOKENS_SQL.format("text")}) AS t FROM documents),
b AS (SELECT t, CASE WHEN regexp_full_match(t, '.{{4,}}ing') THEN left(t, length(t) - 3) WHEN regexp_full_match(t, '.{{4,}}ed') THEN left(t, length(t) - 2) WHEN regexp_full_match(t, '.{{3,}}[^s]s') THEN left(t, length(t) - 1) ELSE t END AS s FROM w)
SELECT t AS term, {STEM_SQL} AS stem FROM b""",
)
def term_stems(spark, sf):
    w = model.table(spark, sf, "documents").select(F.explode(model.tokens("text")).alias("term")).distinct()
    return w.select("term", text.term_key(F.col("term")).alias("stem"))


@query("function_words", f"WITH w AS (SELECT unnest({TOKENS_SQL.format('text')}) AS t FROM documents) SELECT t IN ({', '.join(repr(x) for x in sorted(text.FUNCTION_WORDS))}) AS function_word, count(*) AS n FROM w GROUP BY 1")
def function_words(spark, sf):
    w = model.table(spark, sf, "documents").select(F.explode(model.tokens("text")).alias("t"))
    return w.groupBy(text.is_function_word(F.col("t")).alias("function_word")).agg(F.count("*").alias("n"))


def _docs(spark, sf):
    return model.table(spark, sf, "documents").select("doc_id", "text")


@query("token_spans", "WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS ts FROM documents) SELECT doc_id, len(ts) AS tokens, strlen(text) - strlen(regexp_extract(text, '[^\\p{L}\\p{N}]*$')) AS last, list_sum(list_transform(ts, lambda x: strlen(x)))::BIGINT AS bytes FROM t WHERE len(ts) > 0")
def token_spans(spark, sf):
    out = text.mapped(_docs(spark, sf), text.token_spans, ("text",), "token string, start long, end long", ("doc_id",))
    return out.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


CHARS_SQL = """ch AS MATERIALIZED (SELECT doc_id, c, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE strlen(text) > 0)),
size AS (SELECT doc_id, max(e) AS size FROM ch GROUP BY doc_id)"""


def _windows_sql(capacity: int, cut: str) -> str:
    """Pieces of texts (doc_id, ordinal, start, stop), one after the other: each ends at the last character that fits, or where `cut` is of those that fit."""
    return f"""WITH RECURSIVE {CHARS_SQL}, w(doc_id, ordinal, start, stop) AS (SELECT doc_id, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM size UNION ALL
  SELECT w.doc_id, w.ordinal + 1, w.stop, CASE WHEN max(ch.e) = size THEN size ELSE coalesce({cut}, max(ch.e)) END FROM w JOIN size USING (doc_id) JOIN ch ON ch.doc_id = w.doc_id AND ch.e > w.stop AND ch.e <= w.stop + {capacity} GROUP BY w.doc_id, w.ordinal, w.stop, size)
SELECT doc_id, ordinal, start, stop FROM w WHERE ordinal >= 0"""


@query("segments", _windows_sql(2000, "max(ch.e) FILTER (ch.c = chr(10) AND ch.e = w.stop + 1)") + " UNION ALL SELECT doc_id, 0, 0, 0 FROM documents WHERE coalesce(text, '') = ''")
def segments(spark, sf):
    """Whole texts in segments of at most 2000 bytes. These texts have no headings to be cut at, and no blank lines but the rest of a line that a cut leaves behind."""
    out = text.mapped(_docs(spark, sf), _cut, ("text",), "ordinal long, start long, end long, headings array<string>", ("doc_id",))
    return out.select("doc_id", "ordinal", "start", F.col("end").alias("stop"))


def _cut(t):
    return text.segments(t, 2000)


@query("blocks")
def blocks(spark, sf):
    return text.mapped(_docs(spark, sf), _blocks, ("text",), "kind string, start long, end long", ("doc_id",)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("end").alias("last"))


def _blocks(t):
    return text.teaching_blocks(text.blocks(t), 4000)


@query("excerpts")
def excerpts(spark, sf):
    """The best excerpt of each document that has a term, with its span and what it has of the query."""
    return text.mapped(_docs(spark, sf), _excerpt, ("text",), "excerpt string, start long, end long, matches long", ("doc_id",))


def _excerpt(t):
    return text.excerpt(t, "thing license tion", 300)


@query("literal_places", "WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, 'the'), 1) AS n, string_split(text, 'the') AS parts FROM documents WHERE contains(text, 'the')) SELECT doc_id, count(*) AS places, max(strlen(array_to_string(parts[1:n], 'the'))) AS last FROM p WHERE n < len(parts) AND n <= 64 GROUP BY doc_id")
def literal_places(spark, sf):
    """How many places of a literal, of at most 64, and where the last one of them begins, in bytes."""
    found = _docs(spark, sf).filter(F.contains("text", F.lit("the"))).select("doc_id", text.literal_starts(F.col("text"), "the").alias("at"))
    return found.select("doc_id", F.size("at").cast("long").alias("places"), F.element_at("at", -1).alias("last"))


@query("unique_quotes", "SELECT doc_id, strlen(substr(text, 1, position('License' IN text) - 1)) AS start FROM documents WHERE contains(text, 'License') AND position('License' IN substr(text, position('License' IN text) + 1)) = 0")
def unique_quotes(spark, sf):
    return _docs(spark, sf).select("doc_id", text.unique_start(F.col("text"), F.lit("License")).alias("start")).filter("start is not null")


@query("byte_slices", "SELECT doc_id, decode(encode(text)[11:60]) AS part FROM documents WHERE regexp_full_match(text[:100], '[\\x00-\\x7F]*') AND strlen(text) > 100")
def byte_slices(spark, sf):
    d = _docs(spark, sf).filter(F.substring("text", 1, 100).rlike(r"^[\x00-\x7F]*$") & (F.octet_length("text") > 100))
    return d.select("doc_id", text.byte_slice(F.col("text"), F.lit(10), F.lit(60)).alias("part"))


@query(
    "readable_html",
    """WITH r AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS runs FROM pages)
SELECT page_id, len(runs) AS runs, list_sum(list_transform(runs, lambda x: strlen(x)))::BIGINT AS bytes FROM r WHERE len(runs) > 0""",
)
def readable_html(spark, sf):
    p = model.table(spark, sf, "pages").select("page_id", "html")
    out = text.mapped(p, text.readable, ("html",), "run string, start long, end long", ("page_id",))
    return out.groupBy("page_id").agg(F.count("*").alias("runs"), F.sum(F.octet_length("run")).cast("long").alias("bytes"))


@query(
    "links_found",
    """SELECT doc_id, 4::BIGINT AS start, 'n' || (doc_id + 1) AS target, 'next' AS label FROM documents UNION ALL
SELECT doc_id, 4 + strlen('[[n' || (doc_id + 1) || '|next]] and '), 'd/n' || doc_id || '.md', 'it' FROM documents""",
)
def links_found(spark, sf):
    """Links of notes made of documents: a plain, a labelled, an escaped one and one in code. The SQL is for documents without brackets, as the tables have them; a test has others."""
    n = F.concat(F.lit("see [[n"), (F.col("doc_id") + 1).cast("string"), F.lit("|next]] and [it](d/n"), F.col("doc_id").cast("string"), F.lit(".md) not \\[[no]] nor `[[code]]`\n"), "text")
    d = model.table(spark, sf, "documents").select("doc_id", n.alias("text"))
    return text.mapped(d, text.links, ("text",), "start long, target string, label string", ("doc_id",))


@query("notes_parsed", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'record' WHEN 1 THEN 'plain' WHEN 2 THEN 'invalid' ELSE 'invalid' END AS state, CASE doc_id % 4 WHEN 2 THEN 'unterminated' WHEN 3 THEN 'repeated key' END AS error, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS fields FROM documents")
def notes_parsed(spark, sf):
    head = F.when(F.col("doc_id") % 4 == 0, "---\nkind: page\ntitle: x\n---\n").when(F.col("doc_id") % 4 == 2, "---\nkind: page\n").when(F.col("doc_id") % 4 == 3, "---\nkind: a\nkind: b\n---\n").otherwise("")
    d = model.table(spark, sf, "documents").select("doc_id", F.concat(head, F.regexp_replace("text", "---", "")).alias("text"))
    return text.mapped(d, _note, ("text",), "state string, error string, fields int", ("doc_id",))


def _note(t):
    return [(state, error, len(fields)) for state, fields, _, error in text.parse_note(t)]


@query(
    "units_rendered",
    "SELECT doc_id, md5('Title: ' || to_json(regexp_extract(text, '^(\\S+ \\S+)', 1))::VARCHAR || chr(10) || 'Headings: []' || chr(10) || chr(10) || text) AS hash, strlen(text) > 4000 AS long FROM documents",
)
def units_rendered(spark, sf):
    """Every note's unit; that of a long one is rendered for its segments put together, as SQL can't cut them."""
    title = F.to_json(F.array(F.regexp_extract("text", r"^(\S+ \S+)", 1)))
    cut = text.mapped(_docs(spark, sf), _cut_long, ("text",), "ordinal long, start long, end long, part string", ("doc_id", "text"))
    whole = cut.groupBy("doc_id", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "part"))), lambda x: x["part"]), "").alias("body"), F.count("*").alias("parts"))
    body = F.concat(F.lit("Title: "), F.substring(title, F.lit(2), F.length(title) - 2), F.lit("\nHeadings: []\n\n"), "body")
    return whole.select("doc_id", F.md5(body.cast("binary")).alias("hash"), (F.col("parts") > 1).alias("long"))


def _cut_long(t):
    raw = t.encode()
    return [(n, a, b, raw[a:b].decode()) for n, a, b, _ in text.segments(t, 4000)]


@query(
    "graph_rows_rendered",
    f"WITH {GRAPH_ROWS_SQL} SELECT target_id, target_kind, title, name, aliases, endpoints, predicate, qualifiers, description FROM gr",
)
def graph_rows_rendered(spark, sf):
    from tessera.plans import indexes

    return indexes.graph_rows(spark, sf).withColumn("aliases", F.array_join("aliases", " "))


@query("dates_checked", "SELECT DISTINCT l_shipdate::DATE::VARCHAR AS d, l_shipdate::DATE AS day, true AS ok FROM lineitem")
def dates_checked(spark, sf):
    li = model.table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")).distinct()
    day = scalars.as_date(F.col("d"))
    return li.select("d", day.alias("day"), (day.isNotNull() & scalars.is_interval(day, F.date_add(day, 1))).alias("ok"))


@query("json_canonical", "SELECT event_id, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' AS json FROM events")
def json_canonical(spark, sf):
    raw = F.concat(F.lit('{ "b" : "'), "event_type", F.lit('", "a": '), F.col("event_id").cast("string"), F.lit(" }"))
    return model.ledger(spark, sf).select("event_id", scalars.canonical_json(raw).alias("json"))


@query(
    "entity_units_rendered",
    """SELECT 'supplier_' || s_suppkey AS target_id, 'Entity: ' || to_json(s_name)::VARCHAR || chr(10) || 'Type: supplier' || chr(10) || 'Aliases: ["alt ' || (s_suppkey % 3) || '","' || lower(s_name) || '"]' || chr(10) || 'Status: active' AS utf8 FROM supplier""",
)
def entity_units_rendered(spark, sf):
    s = model.table(spark, sf, "supplier")
    alt = F.concat(F.lit("alt "), (F.col("s_suppkey") % 3).cast("string"))
    rows = s.select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.lit("supplier").alias("entity_type"), F.array(F.lower("s_name"), alt, alt).alias("aliases"), F.lit(None).cast("string").alias("description"))
    return render.entity_units(rows)


@query(
    "assertion_units_rendered",
    f"""WITH {ENTITIES_SQL}, {ASSERTIONS_SQL} SELECT a.id AS target_id, 'Subject: {{"id":"' || subject_id || '","title":' || to_json(s.title)::VARCHAR || '}}' || chr(10) || 'Predicate: ' || predicate || chr(10) ||
  'Object: {{"id":"' || object_id || '","title":' || to_json(o.title)::VARCHAR || '}}' || chr(10) || 'Negated: ' || negated || chr(10) || 'Modality: asserted' AS utf8 FROM assertions a JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id""",
)
def assertion_units_rendered(spark, sf):
    a = model.assertions(spark, sf)
    return render.assertion_units(a, model.entities(spark, sf))


@query("packet_windows", _windows_sql(12_000, "max(ch.e) FILTER (ch.c = chr(10))"))
def packet_windows(spark, sf):
    """Windows of extraction packets over whole texts, cut after the last newline that fits."""
    out = text.mapped(_docs(spark, sf), _windows, ("text",), "ordinal long, start long, end long, headings array<string>", ("doc_id",))
    return out.select("doc_id", "ordinal", "start", F.col("end").alias("stop"))


def _windows(t):
    return text.packet_windows(t, 12_000, max(16, len((t or "").encode()) // 1000))


@query("links_rewritten", "SELECT doc_id, '[[m' || doc_id || '|x]] `[[n' || doc_id || ']]` [n' || doc_id || '](m' || doc_id || ')' AS text FROM documents")
def links_rewritten(spark, sf):
    n = F.concat(F.lit("n"), F.col("doc_id").cast("string"))
    d = model.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("[["), n, F.lit("|x]] `[["), n, F.lit("]]` ["), n, F.lit("]("), n, F.lit(")")).alias("note"), n.alias("old"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("new"))
    return text.mapped(d, _rewritten, ("note", "old", "new"), "text string", ("doc_id",))


def _rewritten(t, old, new):
    return [(text.rewrite_links(t, old, new),)]


@query("citations_compacted", "WITH s AS (SELECT conv_id AS revision, turn * 40 AS a, turn * 40 + 30 + (turn % 3) * 10 AS b FROM conversations), g AS (SELECT *, CASE WHEN a > max(b) OVER w THEN 1 WHEN max(b) OVER w IS NULL THEN 1 ELSE 0 END AS gap FROM s WINDOW w AS (PARTITION BY revision ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(gap) OVER (PARTITION BY revision ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT revision, min(a) AS start, max(b) AS \"end\", count(*) AS parts FROM i GROUP BY revision, k")
def citations_compacted(spark, sf):
    """Direct quotes of a revision that overlap or touch become one span."""
    from tessera.operators.intervals import merge_overlapping

    c = model.table(spark, sf, "conversations")
    spans = c.select(F.col("conv_id").alias("revision"), (F.col("turn") * 40).alias("start"), (F.col("turn") * 40 + 30 + F.col("turn") % 3 * 10).alias("end"))
    return merge_overlapping(spans, ["revision"])
