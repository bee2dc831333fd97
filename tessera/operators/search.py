"""Literal search, BM25 in its three forms, five-leg tiering and complete-phrase witnesses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.filters import MOST_CANDIDATES, checked_query, top
from tessera.sources.index import Index
from tessera.sources.model import tokens_of
from tessera.sources.store import written

#: Weights of the indexed columns, in their order, and of graph rows by the kind of target.
DOCUMENT_WEIGHTS = {"title": 8.0, "aliases": 6.0, "headings": 3.0, "tags": 2.0, "body": 1.0}
ENTITY_WEIGHTS = {"name": 8.0, "aliases": 6.0, "endpoints": 0.0, "predicate": 0.0, "qualifiers": 0.0, "description": 1.0}
ASSERTION_WEIGHTS = {"name": 0.0, "aliases": 0.0, "endpoints": 4.0, "predicate": 6.0, "qualifiers": 2.0, "description": 1.0}
MOST_BODY, MOST_BODIES = 1 << 20, 16 << 20
K1, B = 1.2, 0.75
MOST_TERMS_JOINED = 4096
FIRST = 32  # chunks that give the threshold


def tie() -> Column:
    """What equal scores are ordered by, before the path."""
    return F.coalesce("record_id", "path")


def phrases(query: str) -> list[list[str]]:
    """Each whitespace term of a query as the tokens that a phrase match needs in a row, folded as the index is."""
    return [p for p in (tokens_of(t) for t in dict.fromkeys(checked_query(query))) if p]


def phrase_hits(index: Index, wanted: Sequence[Sequence[str]], fields: Sequence[str] | None = None) -> DataFrame:
    """(phrase, key, field, size, len, n): how often each phrase, by its number, stands in each field of each row that has it.

    The query's terms, at most MOST_TERMS_JOINED, are broadcast to the postings of their buckets. A phrase of several
    terms is where all of them have the same start: position less place in the phrase. Keys are unique in an index.
    """
    asked = [(i, j, t, len(p)) for i, p in enumerate(wanted) for j, t in enumerate(p)]
    if len(asked) > MOST_TERMS_JOINED:
        raise ValueError(f"more than {MOST_TERMS_JOINED} terms")
    spark = index.rows.sparkSession
    found = index.of_terms(sorted({t for _, _, t, _ in asked}))
    if fields is not None:
        found = found.filter(F.col("field").isin(*fields))
    found = found.join(F.broadcast(spark.createDataFrame(asked, "phrase int, place int, term string, terms int")), "term")
    by = ["phrase", index.key, "field", "size", "len"]
    single = found.select(*by, F.col("n").cast("long").alias("n"))
    if max(len(p) for p in wanted) == 1:
        return single
    several = found.filter("terms > 1")
    # rows without a phrase's rarest term aren't opened
    known = index.frequencies([t for p in wanted if len(p) > 1 for t in p], fields or index.fields)
    rarest = F.create_map(*[x for i, p in enumerate(wanted) if len(p) > 1 for x in (F.lit(i), F.lit(min(p, key=lambda t: (known[t], t))))])[F.col("phrase")]
    several = several.join(several.filter(F.col("term") == rarest).select("phrase", index.key, "field"), ["phrase", index.key, "field"], "left_semi")
    several = several.select(*by, "terms", "place", F.explode("positions").alias("position"))
    several = several.groupBy(*by, "terms", (F.col("position") - F.col("place")).alias("start")).agg(F.count("*").alias("c")).filter("c = terms").groupBy(*by).agg(F.count("*").alias("n"))
    return several if min(len(p) for p in wanted) > 1 else found.filter("terms = 1").select(*by, F.col("n").cast("long").alias("n")).unionByName(several)


def _score(index: Index, matched: DataFrame, idf: dict[int, float], size: str, average: float, sign: int) -> DataFrame:
    """(key, score) from (phrase, key, f, size) rows and the weight of each phrase."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(size) / F.lit(average))
    part = F.create_map(*[x for p, w in idf.items() for x in (F.lit(p), F.lit(w))])[F.col("phrase")] * F.col("f") * (K1 + 1) / (F.col("f") + norm) * sign
    return matched.groupBy(index.key).agg(F.sum(part).alias("score"))


def frequencies(index: Index, wanted: Sequence[Sequence[str]], fields: Sequence[str]) -> dict[int, int]:
    """In how many rows each phrase is, in one of the fields: of single terms the index knows it, of others their rows are counted."""
    known = index.frequencies([p[0] for p in wanted if len(p) == 1], fields)
    found = {i: known[p[0]] for i, p in enumerate(wanted) if len(p) == 1}
    name = lambda i: " ".join([*wanted[i], *sorted(fields)])
    several = [i for i, p in enumerate(wanted) if len(p) > 1]
    new = [i for i in several if name(i) not in index.counted]
    if new:
        hits = phrase_hits(index, [wanted[i] for i in new], fields).select("phrase", index.key).distinct().groupBy("phrase").count()
        got = {r["phrase"]: r["count"] for r in hits.collect()}  # a row for each phrase
        if len(index.counted) > MOST_TERMS_JOINED:
            index.counted.clear()
        index.counted |= {name(i): got.get(j, 0) for j, i in enumerate(new)}
    return found | {i: index.counted[name(i)] for i in several}


def full_text_idf(n: int, count: int) -> float:
    return max(log((count - n + 0.5) / (n + 0.5)), 1e-6)


def unit_idf(n: int, count: int) -> float:
    return log(1 + (count - n + 0.5) / (n + 0.5))


def bm25_index_form(index: Index, query: str, weights: dict[str, float], only: Sequence[str] | None = None) -> DataFrame:
    """(key, score) of matching rows, lower is better: a full-text index's built-in BM25 with field weights.

    score = -sum over phrases of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg)); f is the sum of weight * hits, len
    the tokens of all indexed fields, idf = max(ln((N - n + 0.5) / (n + 0.5)), 1e-6) with n the rows that match the
    phrase (inside the fields `only`, if given). N, n and avg are over all rows: filter afterwards.
    """
    fields = [c for c in weights if c in index.fields and (only is None or c in only)]
    weight = F.create_map(*[x for c in fields for x in (F.lit(c), F.lit(float(weights[c])))])[F.col("field")]
    wanted = phrases(query)
    idf = {p: full_text_idf(n, index.count) for p, n in frequencies(index, wanted, fields).items() if n}
    matched = phrase_hits(index, wanted, fields)
    if not idf:
        return matched.select(index.key, F.lit(0.0).alias("score")).limit(0)
    matched = matched.repartition(index.key)  # once, for both sums and for a join by the key
    return _score(index, matched.groupBy("phrase", index.key, "len").agg(F.sum(weight * F.col("n")).alias("f")), idf, "len", index.average(), -1)


@dataclass
class Scan:
    """All rows of a table that no index is stored for, with how often each phrase of one query stands in each field.

    rows: key, the kept columns, len (tokens of all fields), h_<field>, an array by phrase, and hits, the sum of these; count and tokens are those of all rows, matching the rows that have each phrase.
    """

    rows: DataFrame
    key: str
    fields: tuple[str, ...]
    query: str
    count: int
    tokens: int
    matching: list[int]


def _times(text: Column, phrase: Sequence[str]) -> Column:
    """How often a phrase of tokens stands in a spaced() text, places that overlap included."""
    if any(phrase[:n] == phrase[-n:] for n in range(1, len(phrase))):  # may overlap itself
        words = F.split(F.trim(text), "  ")
        return F.size(F.filter(words, lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + j) == t, F.lit(False)) for j, t in enumerate(phrase)])))
    found = f" {'  '.join(phrase)} "
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(found), F.lit("")))) / len(found.encode())).cast("int")


def scanned(df: DataFrame, key: str, fields: Sequence[str], query: str, keep: Sequence[str] = ()) -> Scan:
    """df's rows held against a query in one pass, as an index costs many of them. Fields are spaced() texts or null; null keys don't count."""
    wanted = phrases(query)
    texts = {f: F.coalesce(f, F.lit("")) for f in fields}
    size = sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) for t in texts.values()), F.lit(0))
    counted = [F.array(*[_times(t, p) for p in wanted]).cast("array<int>").alias(f"h_{f}") for f, t in texts.items()]
    rows = df.filter(F.col(key).isNotNull()).select(key, *keep, (size / 2).cast("int").alias("len"), *counted)
    hits = F.array(*[sum((F.col(f"h_{f}")[i] for f in fields), F.lit(0)) for i in range(len(wanted))]).cast("array<int>")
    rows = written(rows.withColumn("hits", hits), "scanned")
    one = rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), *[F.count_if(F.col("hits")[i] > 0) for i in range(len(wanted))]).first()
    return Scan(rows, key, tuple(fields), query, one[0], one[1], list(one[2:]))


def bm25_scan_form(scan: Scan, weights: dict[str, float], of: DataFrame | None = None) -> DataFrame:
    """bm25_index_form() of a scan's query, with all fields of the weights; of those of its rows that `of` has, with their other columns, if it is given."""
    fields = [c for c in weights if c in scan.fields]
    if set(fields) != set(scan.fields):
        raise ValueError("a scan has counted the rows of all its fields")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(scan.tokens / max(scan.count, 1)))
    score, some = F.lit(0.0), F.lit(False)
    for i, n in enumerate(scan.matching):
        if n:
            # little code for a phrase: the JVM doesn't compile large methods
            f, has = sum((F.lit(float(weights[c])) * F.col(f"h_{c}")[i] for c in fields if weights[c]), F.lit(0.0)), F.col("hits")[i] > 0
            score, some = score + F.when(has, F.lit(-full_text_idf(n, scan.count)) * f * (K1 + 1) / (f + norm)).otherwise(F.lit(0.0)), some | has
    if of is None:
        return scan.rows.filter(some).select(scan.key, score.alias("score"))
    return of.filter(some).withColumn("score", score)


def bm25_rows(source: Index | Scan, query: str, weights: dict[str, float], of: DataFrame) -> DataFrame:
    """(key, score) by bm25_index_form() of the rows `of`, which are some of the source's, from a stored index or from a scan for this query."""
    if isinstance(source, Index):
        return bm25_index_form(source, query, weights).join(of.select(source.key), source.key)
    if source.query != query:
        raise ValueError("the scan is of another query")
    return bm25_scan_form(source, weights, of).select(source.key, "score")


def bm25_unit_form(index: Index, terms: Sequence[str], field: str = "body") -> DataFrame:
    """(key, score) of units that have a term, higher is better; idf = ln(1 + (N - df + 0.5) / (df + 0.5)), over all units."""
    wanted = [[t] for t in dict.fromkeys(terms)]
    idf = {p: unit_idf(n, index.count) for p, n in frequencies(index, wanted, [field]).items() if n}
    matched = phrase_hits(index, wanted, [field]).select("phrase", index.key, F.col("n").cast("double").alias("f"), "size")
    if not idf:
        return matched.select(index.key, F.lit(0.0).alias("score")).limit(0)
    return _score(index, matched, idf, "size", index.average([field]), 1)


def bm25_top(index: Index, terms: Sequence[str], k: int, field: str = "body", allowed: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(key, score, rank) of the k best units by bm25_unit_form(), and of how many chunks of rows the postings were scored.

    The index has a row for each term and chunk of rows with the most hits and the shortest field there, which bounds what a row of the chunk can score for
    the term; the sum over terms bounds its whole score. The FIRST chunks of the highest bounds are scored; the k-th best of their rows
    (of those in `allowed`, keys, if given) is a threshold, and of the other chunks only those whose bound reaches it are scored. Equal scores go by key.
    """
    wanted = [t for t in dict.fromkeys(terms)]
    idf = {wanted[p]: unit_idf(n, index.count) for p, n in frequencies(index, [[t] for t in wanted], [field]).items() if n}
    average = index.average([field])
    weight = F.create_map(*[x for t, w in (idf or {"": 0.0}).items() for x in (F.lit(t), F.lit(w))])[F.col("term")]
    norm = lambda size: F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(size) / F.lit(average))
    blocks = index.of_terms(list(idf), index.blocks).filter(F.col("field") == field)
    blocks = blocks.groupBy("chunk", "term").agg(F.max("most").alias("most"), F.min("shortest").alias("shortest"))
    bound = F.sum(weight * F.col("most") * (K1 + 1) / (F.col("most") + norm("shortest"))) * (1 + 1e-9)
    chunks = blocks.groupBy("chunk").agg(bound.alias("bound"))
    chunks = written(chunks, "bounds")

    def scored(which: Column | DataFrame) -> DataFrame:
        found = index.of_terms(list(idf)).filter(F.col("field") == field)
        found = found.filter(which) if isinstance(which, Column) else found.join(which.select("chunk"), "chunk", "left_semi")
        out = found.groupBy(index.key).agg(F.sum(weight * F.col("n") * (K1 + 1) / (F.col("n") + norm("size"))).alias("score"))
        return out if allowed is None else out.join(allowed.select(index.key), index.key, "left_semi")

    order = [F.col("score").desc(), F.col(index.key)]
    first = [r["chunk"] for r in chunks.orderBy(F.col("bound").desc(), "chunk").limit(FIRST).collect()]
    best = written(scored(F.col("chunk").isin(first)).orderBy(*order).limit(k), "best")
    least = best.agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
    rest = chunks.filter(~F.col("chunk").isin(first))
    if least["n"] == k:
        rest = rest.filter(F.col("bound") >= least["least"])
    more = rest.count()
    both = best.unionByName(scored(rest)) if more else best
    report = {"chunks": chunks.count(), "first": len(first), "second": more}
    return top(both, order, k), report


def literal(docs: DataFrame, needle: str, keep: Sequence[str], k: int = MOST_CANDIDATES) -> DataFrame:
    """The first k documents that contain the bytes of needle, case and all, by coalesce(record_id, path), path."""
    return top(docs.filter(F.contains("body", F.lit(needle))).select(*keep), [tie(), F.col("path")], k)


def literal_count(docs: DataFrame, needle: str) -> DataFrame:
    """Documents and non-overlapping places of needle, neither capped."""
    import re

    found = docs.filter(F.contains("body", F.lit(needle)))
    return found.agg(F.count("*").alias("documents"), F.sum(F.regexp_count("body", F.lit(re.escape(needle)))).cast("long").alias("places"))


def five_legs(index: Index, query: str, policy: Column, k: int = MOST_CANDIDATES) -> DataFrame:
    """Candidates by tier: exact id 0; exact title, exact alias 1; text BM25, identity BM25 2.

    Each leg ranks what passes the policy and is cut at k; a path keeps its least (tier, score) and the rank of
    every leg that has it. Order: tier, score, coalesce(record_id, path), path.
    """
    narrow = ["path", "record_id"]
    ok = index.rows.filter(policy)
    low = query.lower()
    allowed = ok.select(*narrow)
    exact = lambda leg, tier, cond: ok.filter(cond).select(*narrow, F.lit(tier).alias("tier"), F.lit(0.0).alias("score"), F.lit(leg).alias("leg"))
    scored = lambda leg, only: bm25_index_form(index, query, DOCUMENT_WEIGHTS, only).join(allowed, "path").select(*narrow, F.lit(2).alias("tier"), "score", F.lit(leg).alias("leg"))
    legs = [
        exact("exact_id", 0, F.col("record_id") == query),
        exact("exact_title", 1, F.lower("title") == low),
        exact("exact_alias", 1, F.exists("aliases", lambda a: F.lower(a) == low)),
        scored("lexical", None),
        scored("identity_lexical", ["title", "aliases"]),
    ]
    ranked = reduce(DataFrame.unionByName, [top(leg, [F.col("score"), tie(), F.col("path")], k) for leg in legs])  # 5 * k rows at most from here
    best = ranked.groupBy("path", "record_id").agg(F.min(F.struct("tier", "score")).alias("b"), *[F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"rank_{leg}") for leg in ("exact_id", "exact_title", "exact_alias", "lexical", "identity_lexical")])
    best = best.select("path", "record_id", F.col("b.tier").alias("tier"), F.col("b.score").alias("score"), *[c for c in best.columns if c.startswith("rank_")])
    return top(best, [F.col("tier"), F.col("score"), tie(), F.col("path")], k)


def complete_phrase_first(ranked: DataFrame, index: Index, query: str) -> DataFrame:
    """Stable preference, inside tier 2, for bodies that have all the query's tokens in a row.

    Only a query of several tokens has witnesses, and none is looked for if a candidate's body is larger than
    MOST_BODY or all of them together than MOST_BODIES.
    """
    phrase = [t for p in phrases(query) for t in p]
    ranked = ranked.join(F.broadcast(index.rows.join(F.broadcast(ranked.select("path")), "path").select("path", "bytes")), "path")  # k rows
    small = (F.max("bytes").over(Window.partitionBy()) <= MOST_BODY) & (F.sum("bytes").over(Window.partitionBy()) <= MOST_BODIES)
    if len(phrase) > 1:
        having = phrase_hits(index, [phrase], ["body"]).select("path", F.lit(True).alias("having")).join(F.broadcast(ranked.select("path")), "path", "left_semi")
        ranked = ranked.join(F.broadcast(having), "path", "left")
    else:
        ranked = ranked.withColumn("having", F.lit(False))
    witness = F.coalesce("having", F.lit(False)) & (F.col("tier") == 2) & F.col("rank_identity_lexical").isNull() & small
    flagged = ranked.withColumn("witness", witness).drop("having", "bytes")
    return flagged.withColumn("rank", F.row_number().over(Window.orderBy("tier", ~F.col("witness"), "rank")))


def graph_seeds(index: Index | Scan, query: str, allowed: DataFrame | Column, strategy: str = "combined", k: int = MOST_CANDIDATES) -> DataFrame:
    """(target_id, target_kind, score, channels, rank): rows of the graph to begin a walk at.

    strategy entity or relationship takes one kind, combined both. For each kind, exact id, exact title, exact alias and
    BM25 over its fields rank what is allowed (target_id, or a condition on the rows) and are cut at k; a row's score is the sum of 1 / (60 + rank), its
    channels are told; rows with equal scores go by id.
    """
    kinds = {"entity": ["entity"], "relationship": ["assertion"], "combined": ["entity", "assertion"]}[strategy]
    found = []
    for kind in kinds:
        ok = index.rows.filter(F.col("target_kind") == kind)
        ok = ok.filter(allowed) if isinstance(allowed, Column) else ok.join(allowed.select("target_id"), "target_id", "left_semi")
        weights = ENTITY_WEIGHTS if kind == "entity" else ASSERTION_WEIGHTS
        none = F.lit(0.0).alias("score")
        legs = {
            "exact_id": ok.filter(F.col("target_id") == query).select("target_id", none),
            "exact_title": ok.filter(F.col("title") == query).select("target_id", none),
            "exact_alias": ok.filter(F.array_contains("aliases", query)).select("target_id", none),
            "graph_lexical": bm25_rows(index, query, weights, ok),
        }
        ranked = [top(leg, [F.col("score"), F.col("target_id")], k).select("target_id", "rank", F.lit(f"{kind}_{name}").alias("channel")) for name, leg in legs.items()]
        fused = reduce(DataFrame.unionByName, ranked).groupBy("target_id").agg(F.sum(1.0 / (60.0 + F.col("rank"))).alias("score"), F.array_join(F.sort_array(F.collect_list("channel")), ",").alias("channels"))
        found.append(top(fused.withColumn("score", F.round("score", 9)), [F.col("score").desc(), F.col("target_id")], k).withColumn("target_kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, found).select("target_id", "target_kind", "score", "channels", "rank")


def page(ranked: DataFrame, offset: int, size: int) -> DataFrame:
    """One page by ranks; a row past the end tells that there is more."""
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + size + 1)).withColumn("more", F.col("rank") > offset + size)


def cursor(query: str, snapshot: str, offset: int) -> str:
    """A page's cursor: hexadecimal JSON bound to query and snapshot."""
    import hashlib
    import json

    bound = hashlib.sha256(json.dumps([query, snapshot]).encode()).hexdigest()
    return json.dumps({"at": offset, "of": bound}, sort_keys=True).encode().hex()


def opened(cursor_: str, query: str, snapshot: str) -> int:
    """The offset of a cursor; refuses one of another query or snapshot."""
    import json

    at = json.loads(bytes.fromhex(cursor_))["at"]
    if cursor(query, snapshot, at) != cursor_:
        raise ValueError("the cursor belongs to another query or snapshot")
    return at
