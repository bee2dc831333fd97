"""Filters and policies of the catalog: predicates as columns, so that they reach the scan before any cap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The caps of a query's plan and filters.
MOST_VALUES = 80
MOST_HITS, MOST_CANDIDATES, MOST_EXCERPT = 50, 80, 2048
MOST_QUERY_BYTES, MOST_TERMS = 16 * 1024, 256
OPERATIONAL_KINDS = ("extraction_packet", "extraction", "run", "run_event", "change")


@dataclass(frozen=True)
class Filters:
    kinds: Sequence[str] = ()
    tags: Sequence[str] = ()
    statuses: Sequence[str] = ()
    sources: Sequence[str] = ()
    path_prefix: str = ""

    def normalised(self) -> Filters:
        """Lists sorted without repeats, the prefix stripped; refuses empty or too many values."""

        def clean(values: Sequence[str]) -> tuple[str, ...]:
            if any(not v.strip() for v in values):
                raise ValueError("a filter value is empty")
            out = tuple(sorted(set(values)))
            if len(out) > MOST_VALUES:
                raise ValueError(f"more than {MOST_VALUES} filter values")
            return out

        return replace(self, kinds=clean(self.kinds), tags=clean(self.tags), statuses=clean(self.statuses), sources=clean(self.sources), path_prefix=self.path_prefix.strip())


def checked_query(text: str) -> list[str]:
    """The whitespace terms of a query; refuses a blank one, a NUL, and more bytes or terms than a query may have."""
    if not text.strip() or "\0" in text:
        raise ValueError("a query needs text without NUL")
    if len(text.encode()) > MOST_QUERY_BYTES or len(text.split()) > MOST_TERMS:
        raise ValueError("the query is too long")
    return text.split()


def checked_plan(hits: int, candidates: int, excerpt_bytes: int) -> None:
    for n, most in ((hits, MOST_HITS), (candidates, MOST_CANDIDATES), (excerpt_bytes, MOST_EXCERPT)):
        if not 1 <= n <= most:
            raise ValueError(f"{n} is not in 1..{most}")


def adopted(d: str = "record_id", s: str = "source_id") -> Column:
    """Only documents with an owner take part in any query."""
    return F.coalesce(d, s).isNotNull()


def matches(f: Filters) -> Column:
    """kind and status in lists, every tag, path prefix; an absent filter is true and folds away."""
    f = f.normalised()
    out = adopted()
    if f.kinds:
        out &= F.col("kind").isin(*f.kinds)
    for t in f.tags:
        out &= F.array_contains("tags", t)
    if f.path_prefix:
        out &= F.startswith("path", F.lit(f.path_prefix))
    if f.statuses:
        out &= F.col("status").isin(*f.statuses)
    return out


def in_sources(docs: DataFrame, sources: Sequence[str], evidence: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Documents of a source: their own, the source's record itself, a record whose source_id, or one of whose source_ids, it is, or one with evidence from it.

    evidence (source_id, assertion_id) and records (id, kind, source_id, source_ids) are filtered by the sources first; what they find is joined by record once.
    """
    hits = evidence.filter(F.col("source_id").isin(*sources)).select(F.col("assertion_id").alias("record_id"))
    if records is not None:
        of = ((F.col("kind") == "source") & F.col("id").isin(*sources)) | F.col("source_id").isin(*sources) | F.arrays_overlap("source_ids", F.array(*[F.lit(s) for s in sources]))
        hits = hits.unionByName(records.filter(of).select(F.col("id").alias("record_id")))
    hits = hits.distinct().withColumn("cited", F.lit(True))
    return docs.join(hits, "record_id", "left").filter(F.col("source_id").isin(*sources) | F.coalesce("cited", F.lit(False))).drop("cited")


def normal_policy(blank: Column | None = None) -> Column:
    """What a plain search may show: current or stale text that is no draft, of no operational kind, not blank (a column of an index's rows, else by the body)."""
    full = F.trim("body") != "" if blank is None else ~blank
    return adopted() & F.col("eligibility").isin("current", "stale") & (F.coalesce("status", F.lit("")) != "draft") & ~F.coalesce("kind", F.lit("")).isin(*OPERATIONAL_KINDS) & ~F.coalesce("path", F.lit("")).rlike("(^|/)\\.") & full


def identity_policy() -> Column:
    """Entities whose identity is current though their text is not."""
    return (F.col("kind") == "entity") & (F.col("status") != "deprecated") & (F.col("eligibility") != "current")


def context_policy(current: bool = True) -> Column:
    """What may be packed into context: captured text that is not invalid (current scope: current), reviewed pages, current entities."""
    page = (F.col("kind") == "page") & ((F.col("status") == "reviewed") & (F.col("eligibility") == "current") if current else F.col("status") != "draft")
    captured = (F.col("kind") == "revision") & (F.col("eligibility") == "current" if current else F.col("eligibility") != "invalid")
    return page | captured | ((F.col("kind") == "entity") & (F.col("eligibility") == "current"))


def graph_policy(proposed: bool = False, historical: bool = False) -> Column:
    """Assertions that a walk may use: current ones, and on request proposed and historical ones."""
    states = ["current", *(["historical", "stale"] if historical else [])]
    return F.col("eligibility").isin(*states) & F.col("status").isin("accepted", *(["proposed"] if proposed else []))


def embeddable() -> Column:
    """Documents whose text is embedded."""
    return (F.col("eligibility") == "current") & (F.col("kind").isNull() | (F.col("kind") == "page"))


def top(candidates: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows by a total order, ranked; a top-k in each task, then one over those."""
    import pyspark.sql.window as w

    return candidates.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(w.Window.orderBy(*order)))


def late(candidates: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Fetches wide columns for at most MOST_CANDIDATES narrow rows: that many rows are broadcast."""
    return payload.join(F.broadcast(candidates.limit(MOST_CANDIDATES + 1)), key)
