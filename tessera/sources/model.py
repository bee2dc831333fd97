"""The catalog's tables, derived from the driver's: documents, records, entities, assertions, evidence, units, ledger events.

Every function is lazy, reads only the columns it needs and is free of shuffles except where it says distinct.
"""

from __future__ import annotations

import unicodedata
from itertools import zip_longest

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Eligibility states, and the kinds that documents take in turn.
STATES = ("current", "stale", "historical", "unsupported", "withdrawn", "invalid")
KINDS = ("page", "revision", "evidence", "entity")
STATUSES = ("draft", "reviewed", "deprecated")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turn(values: tuple[str, ...], by: str, n: int) -> Column:
    out = F.when(F.col(by) % n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(by) % n == i, v)
    return out


def fold_char(c: str) -> str:
    """A character without its diacritics; nothing for a mark that combines."""
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)))


def _folded() -> tuple[str, str]:
    """Characters that fold to another one, and what to; marks, which go, come last. Of all planes with letters but the ideographs' and Hangul's, which have none."""
    codes = [*range(0xC0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0xFFFE), *range(0x10000, 0x13000), *range(0x16A00, 0x17000), *range(0x1BC00, 0x1F000)]
    pairs = [(c, fold_char(c)) for c in map(chr, codes) if unicodedata.category(c)[0] in "LMN"]
    changed = [(c, f) for c, f in pairs if f != c and len(f) == 1]
    gone = [c for c, f in pairs if not f]
    return "".join(c for c, _ in changed) + "".join(gone), "".join(f for _, f in changed)


FOLD = _folded()
_TABLE = {ord(c): f for c, f in zip_longest(*FOLD, fillvalue=None)}
#: A token: a letter or digit, and what letters, digits and marks follow it.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def fold(text: str) -> str:
    """Lower case without diacritics: what both the index and a query are folded by, character by character, so that Hangul in parts stays in parts."""
    return text.lower().translate(_TABLE)


def tokens_of(text: str) -> list[str]:
    """tokens() of one text."""
    return regex.findall(TOKEN, fold(text))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits without diacritics, in order, marks that remain inside them; an empty array for null."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    folded = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *FOLD))  # ASCII has nothing to fold
    return F.regexp_extract_all(folded, F.lit(f"({TOKEN})"), F.lit(1))


def spaced(text: Column | str) -> Column:
    """The tokens of a text as one text, each between two spaces: those of two texts, one behind the other, are the two put together, and a phrase of
    tokens is found as text. An empty text for no tokens."""
    found = tokens(text)
    return F.when(F.size(found) > 0, F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))).otherwise(F.lit(""))


def headings(body: Column | str) -> Column:
    """Titles of the sections of a Markdown text: lines of one to six # and a text."""
    body = F.col(body) if isinstance(body, str) else body
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+)$"), F.lit(1))


def documents(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """path, record_id, kind, status, title, aliases, headings, tags, source_id, eligibility and, if asked for, body.

    Eligibility: toxic documents are withdrawn, those of low quality historical, all others current.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
    d = d.select(
        "doc_id",
        F.concat(F.lit("doc/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("rec-"), F.col("doc_id").cast("string"))).alias("record_id"),
        _turn(KINDS, "doc_id", 4).alias("kind"),
        _turn(STATUSES, "doc_id", 3).alias("status"),
        F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("title"),
        F.array(F.concat(F.lit("alias "), (F.col("doc_id") % 50).cast("string"))).alias("aliases"),
        headings("text").alias("headings"),
        F.array("lang", "source").alias("tags"),
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("source_id"),
        F.when(F.col("toxic") == 1, "withdrawn").when(F.col("quality") == 0, "historical").otherwise("current").alias("eligibility"),
        F.col("text").alias("body"),
    )
    return d if body else d.drop("body")


DOCUMENTS_SQL = """d AS (
  SELECT doc_id, 'doc/' || lang || '/' || doc_id AS path, CASE WHEN doc_id % 7 <> 0 THEN 'rec-' || doc_id END AS record_id,
    CASE doc_id % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'revision' WHEN 2 THEN 'evidence' ELSE 'entity' END AS kind,
    CASE doc_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'reviewed' ELSE 'deprecated' END AS status,
    regexp_extract(text, '^(\\S+ \\S+)', 1) AS title, ['alias ' || (doc_id % 50)] AS aliases, regexp_extract_all(text, '(?m)^#{1,6}[ \\t]+([^\\n]+)$', 1) AS headings, [lang, source] AS tags,
    CASE WHEN doc_id % 11 <> 0 THEN source END AS source_id,
    CASE WHEN toxic = 1 THEN 'withdrawn' WHEN quality = 0 THEN 'historical' ELSE 'current' END AS eligibility, text AS body
  FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)
)"""

TOKENS_SQL = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, title of the five star tables' rows."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda n, key, name: t(n).select(F.concat(F.lit(f"{n}_"), F.col(key).cast("string")).alias("id"), F.lit(n).alias("entity_type"), F.col(name).alias("title"))
    out = one("region", "r_regionkey", "r_name")
    for n, key, name in (("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        out = out.unionByName(one(n, key, name))
    return out


ENTITIES_SQL = """entities AS (
  SELECT 'region_' || r_regionkey AS id, 'region' AS entity_type, r_name AS title FROM region UNION ALL
  SELECT 'nation_' || n_nationkey, 'nation', n_name FROM nation UNION ALL
  SELECT 'customer_' || c_custkey, 'customer', c_name FROM customer UNION ALL
  SELECT 'supplier_' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL
  SELECT 'part_' || p_partkey, 'part', p_name FROM part
)"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subject_id, predicate, object_id, negated, status: nation part_of region, customer and supplier located_in nation,
    supplier uses part (distinct). One supplier in ten has negated assertions; those of parts 3, 13, ... are proposed."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    uses = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    no, yes = F.lit(False), F.lit("accepted")
    parts = [
        t("nation").select(s("nation_", "n_nationkey").alias("subject_id"), F.lit("part_of").alias("predicate"), s("region_", "n_regionkey").alias("object_id"), no.alias("negated"), yes.alias("status")),
        t("customer").select(s("customer_", "c_custkey"), F.lit("located_in"), s("nation_", "c_nationkey"), no, yes),
        t("supplier").select(s("supplier_", "s_suppkey"), F.lit("located_in"), s("nation_", "s_nationkey"), no, yes),
        uses.select(s("supplier_", "l_suppkey"), F.lit("uses"), s("part_", "l_partkey"), F.col("l_suppkey") % 10 == 0, F.when(F.col("l_partkey") % 10 == 3, "proposed").otherwise("accepted")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.concat("subject_id", F.lit(">"), "object_id").alias("id"), "*")


ASSERTIONS_SQL = """assertions AS (
  SELECT subject_id || '>' || object_id AS id, * FROM (
    SELECT 'nation_' || n_nationkey AS subject_id, 'part_of' AS predicate, 'region_' || n_regionkey AS object_id, false AS negated, 'accepted' AS status FROM nation UNION ALL
    SELECT 'customer_' || c_custkey, 'located_in', 'nation_' || c_nationkey, false, 'accepted' FROM customer UNION ALL
    SELECT 'supplier_' || s_suppkey, 'located_in', 'nation_' || s_nationkey, false, 'accepted' FROM supplier UNION ALL
    SELECT DISTINCT 'supplier_' || l_suppkey, 'uses', 'part_' || l_partkey, l_suppkey % 10 = 0, CASE WHEN l_partkey % 10 = 3 THEN 'proposed' ELSE 'accepted' END FROM lineitem
  )
)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, assertion_id, source_id, revision, stance, status, older: one row for each line item.

    Returned items contradict; items of tax 0.08 are retracted; sources are orders' keys modulo 40, of which each
    tenth is withdrawn; the revision of an item shipped before 1995 is an older one.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_tax", "l_shipdate")
    return li.select(
        F.concat(F.lit("ev_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"), F.lit(">part_"), F.col("l_partkey").cast("string")).alias("assertion_id"),
        F.concat(F.lit("src_"), (F.col("l_orderkey") % 40).cast("string")).alias("source_id"),
        F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("stance"),
        F.when(F.col("l_tax") > 0.075, "retracted").otherwise("active").alias("status"),
        (F.col("l_orderkey") % 40 % 10 == 0).alias("withdrawn"),
        (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("older"),
    )


EVIDENCE_SQL = """evidence AS (
  SELECT 'ev_' || l_orderkey || '_' || l_linenumber AS id, 'supplier_' || l_suppkey || '>part_' || l_partkey AS assertion_id, 'src_' || (l_orderkey % 40) AS source_id,
    CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS stance, CASE WHEN l_tax > 0.075 THEN 'retracted' ELSE 'active' END AS status,
    l_orderkey % 40 % 10 = 0 AS withdrawn, l_shipdate < TIMESTAMP '1995-01-01' AS older
  FROM lineitem
)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, owner, embedding: several units to an owner."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("owner"), "embedding")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event ledger: (ts, event_id) is its order, user_id its task, event_type its payload's kind."""
    return table(spark, sf_dir, "events")
