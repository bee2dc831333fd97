"""Whether the references between records hold: typed and listed ones, owners of revisions, retained heads, and chains of successors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import release, written

#: Fields whose list holds references, and the kind that a reference must be of, any if null.
LISTS = {"revisions": "revision", "source_ids": "source", "source_revision_ids": "revision", "input_ids": None, "output_ids": None}
#: What an evidence record has in common with the one that it supersedes; with an equal revision the span as well.
SAME_CHAIN, SAME_SPAN = ("assertion_id", "source_id"), ("locator_kind", "span_start", "span_end", "quote_hash")


def reference_reasons(records: DataFrame, references: DataFrame) -> DataFrame:
    """(id, reason) of records (id, kind, link, and the fields below) whose references don't hold, each reason once.

    invalid_reference:<field>: a reference (id, field, target, kind, companion) isn't the id of a record of the kind, or its companion, if it has one, isn't
    that record's link; or an entry of a list isn't. duplicate_reference:<field>: a list has an id twice. revision_ownership_mismatch: a source lists
    a revision of another. head_not_retained: a source's current_revision isn't one of its revisions. extraction_ownership_set_mismatch: an
    extraction's source_ids are not the owners of its source_revision_ids. packet_revision_ownership_mismatch: a packet's source_revision isn't of its
    source_id. evidence_successor_chain_disagreement: evidence differs from the one it supersedes in SAME_CHAIN, or has its revision but another of SAME_SPAN.

    All are equi-joins with the records by id and aggregates by record; lists are exploded, so a long one isn't one task's.
    """
    by_id = records.select(F.col("id").alias("target"), F.col("kind").alias("is"), F.col("link").alias("target_link"), F.col("source_id").alias("of"))
    typed = references.join(by_id, "target", "left")
    wrong = F.col("is").isNull() | (F.col("is") != F.col("kind")) | (F.col("companion").isNotNull() & ~F.col("companion").eqNullSafe(F.col("target_link")))
    reasons = [typed.filter(wrong).select("id", F.concat(F.lit("invalid_reference:"), "field").alias("reason"))]

    lists = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("list"), F.lit(k).cast("string").alias("wanted")) for f, k in LISTS.items()])).alias("l")
    entries = records.select("id", "kind", "source_ids", lists).select("id", "kind", "source_ids", "l.field", "l.wanted", F.explode("l.list").alias("target"))
    entries = entries.join(by_id, "target", "left")
    bad = F.col("is").isNull() | (F.col("wanted").isNotNull() & (F.col("is") != F.col("wanted")))
    reasons.append(entries.filter(bad).select("id", F.concat(F.lit("invalid_reference:"), "field").alias("reason")))
    twice = entries.groupBy("id", "field", "target").agg(F.count("*").alias("n")).filter("n > 1")
    reasons.append(twice.select("id", F.concat(F.lit("duplicate_reference:"), "field").alias("reason")))
    other = F.col("is").isNotNull() & ~F.col("of").eqNullSafe(F.col("id"))
    reasons.append(entries.filter((F.col("kind") == "source") & (F.col("field") == "revisions") & other).select("id", F.lit("revision_ownership_mismatch").alias("reason")))
    kept = F.coalesce(F.array_contains("revisions", F.col("current_revision")), F.lit(False))
    reasons.append(records.filter((F.col("kind") == "source") & ~kept).select("id", F.lit("head_not_retained").alias("reason")))

    # the two sets are equal if no member of one is missing in the other
    said = records.filter("kind = 'extraction'").select("id", F.explode("source_ids").alias("source")).distinct().withColumn("said", F.lit(1))
    owned = entries.filter("kind = 'extraction' and field = 'source_revision_ids' and of is not null").select("id", F.col("of").alias("source")).distinct().withColumn("owned", F.lit(1))
    reasons.append(said.join(owned, ["id", "source"], "full").filter("said is null or owned is null").select("id", F.lit("extraction_ownership_set_mismatch").alias("reason")))

    packets = records.filter("kind = 'extraction_packet'").select("id", "source_id", F.col("source_revision").alias("target")).join(by_id, "target")
    reasons.append(packets.filter(~F.col("of").eqNullSafe(F.col("source_id"))).select("id", F.lit("packet_revision_ownership_mismatch").alias("reason")))

    fields = ("source_revision", *SAME_CHAIN, *SAME_SPAN)
    before = records.select(F.col("id").alias("supersedes_id"), *[F.col(c).alias(f"p_{c}") for c in fields])
    after = records.filter("kind = 'evidence'").select("id", "supersedes_id", *fields).join(before, "supersedes_id")
    same = lambda names: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in names])
    disagrees = ~same(SAME_CHAIN) | (same(["source_revision"]) & ~same(SAME_SPAN))
    reasons.append(after.filter(disagrees).select("id", F.lit("evidence_successor_chain_disagreement").alias("reason")))
    return reduce(DataFrame.unionByName, reasons).distinct()


def chains(records: DataFrame, most: int = 64) -> DataFrame:
    """(id, first, place, cyclic, forked) of records (id, supersedes_id): the first record of its chain and how many steps it is away.

    Pointers are doubled: each round a record takes the pointer of the one it points to, so a chain of n records takes log2(n) rounds. Nothing is
    first in a cycle: what is on one, or leads to one, is cyclic and has neither first nor place. A round that settles none ends it, as chains have records at
    every distance. A predecessor that isn't there ends a chain. forked: several records supersede this one.
    """
    known = records.select("id").distinct()
    link = records.select("id", "supersedes_id").distinct().join(known.withColumnRenamed("id", "supersedes_id"), "supersedes_id", "left_semi")
    at = known.join(link, "id", "left").select("id", F.coalesce("supersedes_id", "id").alias("to"), F.when(F.col("supersedes_id").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("supersedes_id").isNull().alias("done"))
    at = written(at, "chains")
    left = at.filter("not done").count()
    for _ in range(most):
        if not left:
            break
        jump = at.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("place").alias("more"), F.col("done").alias("ended"))
        step = at.filter("not done").join(jump, "to").select("id", F.col("further").alias("to"), (F.col("place") + F.col("more")).alias("place"), F.col("ended").alias("done"))
        before, at = at, written(at.filter("done").unionByName(step), "chains")
        release(before)
        now = at.filter("not done").count()
        if now == left:
            break
        left = now
    forked = link.groupBy(F.col("supersedes_id").alias("id")).agg((F.count("*") > 1).alias("forked"))
    out = at.join(forked, "id", "left")
    return out.select("id", F.when(F.col("done"), F.col("to")).alias("first"), F.when(F.col("done"), F.col("place")).alias("place"), (~F.col("done")).alias("cyclic"), F.coalesce("forked", F.lit(False)).alias("forked"))
