"""Derived states: lifecycles, evidence, support, opposition, the dependency fixpoint and the activation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import OPPOSITION_KEY, opposition_columns, reach
from tessera.sources.store import written


def lifecycle(kind: str = "kind", status: str = "status", withdrawn: str = "withdrawn", older: str = "older") -> Column:
    """A record's own state: withdrawn sources and what hangs on them, older revisions, then statuses by kind."""
    s, k = F.col(status), F.col(kind)
    return (
        F.when(F.coalesce(F.col(withdrawn), F.lit(False)), "withdrawn")
        .when((k == "revision") & F.coalesce(F.col(older), F.lit(False)), "historical")
        .when((k == "assertion") & (s == "proposed"), "unsupported")
        .when(s.isin("superseded", "deprecated", "rejected", "retracted"), "historical")
        .otherwise("current")
    )


def evidence_state() -> Column:
    """Retracted before withdrawn before older revision."""
    return F.when(F.col("status") == "retracted", "historical").when(F.col("withdrawn"), "withdrawn").when(F.col("older"), "historical").otherwise("current")


def support(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assertions with eligibility and disputed: any current support makes one current, support by older revisions alone stale, else it is unsupported.

    A current contradiction disputes it, which takes no support away. One partial aggregation by assertion.
    """
    e = evidence.withColumn("state", evidence_state())
    sup, con = F.col("stance") == "supports", F.col("stance") == "contradicts"
    sums = e.groupBy("assertion_id").agg(
        F.bool_or(sup & (F.col("state") == "current")).alias("current"), F.bool_or(sup & F.col("older") & (F.col("status") == "active") & ~F.col("withdrawn")).alias("stale"), F.bool_or(con & (F.col("state") == "current")).alias("disputed")
    )
    rows = assertions.join(sums, assertions["id"] == sums["assertion_id"], "left").drop("assertion_id")
    state = F.when(F.coalesce("current", F.lit(False)), "current").when(F.coalesce("stale", F.lit(False)), "stale").otherwise("unsupported")
    return rows.select(*assertions.columns, state.alias("eligibility"), F.coalesce("disputed", F.lit(False)).alias("disputed"))


def mark_opposed(assertions: DataFrame, key: tuple[str, ...] = OPPOSITION_KEY) -> DataFrame:
    """disputed also where current, accepted assertions of equal key have both polarities; nulls in keys are equal."""
    given, assertions = assertions.columns, opposition_columns(assertions)
    live = assertions.filter("eligibility = 'current' and status = 'accepted'")
    both = live.groupBy(*key).agg((F.bool_or("negated") & F.bool_or(~F.col("negated"))).alias("both")).filter("both").select(*[F.col(c).alias(f"k_{c}") for c in key])
    same = None
    for c in key:
        e = F.col(c).eqNullSafe(F.col(f"k_{c}"))
        same = e if same is None else same & e
    hit = assertions.join(both.withColumn("opposed", F.lit(True)), same, "left")
    mark = F.coalesce("opposed", F.lit(False)) & (F.col("eligibility") == "current") & (F.col("status") == "accepted")
    return hit.select(*[c for c in given if c != "disputed"], (F.col("disputed") | mark).alias("disputed"))


def own_badness(records: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, bad) of records, or of those of some ids, that are bad by themselves: 2 if invalid or a declared dependency (id, depends_on) is missing, 1 if not current."""
    known = records.select("id")
    if ids is not None:
        records, edges = records.join(ids, "id", "left_semi"), edges.join(ids, "id", "left_semi")
    missing = edges.select("id", "depends_on").join(records.select("id"), "id", "left_semi").join(known.withColumnRenamed("id", "depends_on"), "depends_on", "left_anti").select("id", F.lit(2).alias("bad"))
    own = records.filter("eligibility <> 'current'").select("id", F.when(F.col("eligibility") == "invalid", 2).otherwise(1).alias("bad"))
    return missing.unionByName(own).groupBy("id").agg(F.max("bad").alias("bad"))


def badness(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, bad) of all records whose bad is above 0: own_badness(), spread from dependencies to what depends on them by a frontier."""
    back = edges.select(F.col("depends_on").alias("a"), F.col("id").alias("b")).join(records.select(F.col("id").alias("b")), "b", "left_semi")
    return reach(back, own_badness(records, edges), "bad")


def judged(records: DataFrame, bad: DataFrame) -> DataFrame:
    """(id, eligibility) of records by their badness: one that isn't current is left as it is, except that it may become invalid."""
    new = F.when(F.col("bad") == 2, "invalid").when((F.col("bad") == 1) & (F.col("eligibility") == "current"), "stale").otherwise(F.col("eligibility"))
    return records.select("id", "eligibility").join(bad, "id", "left").select("id", new.alias("eligibility"))


def dependency_fixpoint(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, eligibility) after declared dependencies (id, depends_on): a missing or invalid one makes a record invalid, any other non-current one stale."""
    return judged(records, badness(records, edges))


def refreshed_badness(before: DataFrame, records: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, bad) of the records that a change may touch, 0 where they are good now; of all others `before`, the badness() before it, holds.

    records and edges are those after the change, changed has the ids of records that were put, changed or removed and of those with an
    edge put or removed. First badness that may rest on what changed is taken back: from records that are less bad by themselves
    than they were, against dependencies, as long as a record was as bad as the one it depends on. Then it is derived again for these from
    what they are by themselves and from dependencies that kept theirs, and what rises, there or at a changed record, goes on.
    Cycles are no danger: what only supports itself is taken back as a whole.
    """
    before = before.select("id", F.col("bad").alias("was"))
    edges = edges.select("id", "depends_on").join(records.select("id"), "id", "left_semi")
    dependents = edges.join(changed.select(F.col("id").alias("depends_on")).distinct(), "depends_on", "left_semi").select("id")
    first = written(changed.select("id").unionByName(dependents).distinct(), "changed")
    back = written(edges.select(F.col("depends_on").alias("a"), F.col("id").alias("b")), "edges")
    start = first.join(before, "id").join(own_badness(records, edges, first), "id", "left").filter(F.col("was") > F.coalesce("bad", F.lit(0))).select("id", "was")
    # values don't change on the way: only an edge between records that were as bad takes it on
    was = lambda side: before.select(F.col("id").alias(side), F.col("was").alias(f"{side}_was"))
    same = back.join(was("a"), "a").join(was("b"), "b").filter("a_was = b_was")
    gone = written(reach(same, start, "was").select("id"), "gone")
    kept = before.join(gone, "id", "left_anti").select("id", F.col("was").alias("bad"))
    again = written(gone.unionByName(first).distinct(), "again")
    rests = edges.join(again, "id", "left_semi").join(kept.withColumnRenamed("id", "depends_on"), "depends_on").select("id", "bad")
    risen = reach(back, own_badness(records, edges, again).unionByName(rests), "bad", known=kept)
    touched = again.unionByName(risen.select("id")).distinct().join(records.select("id"), "id", "left_semi")
    stands = touched.join(kept, "id").select("id", "bad")
    now = risen.unionByName(stands).groupBy("id").agg(F.max("bad").alias("bad"))
    return touched.join(now, "id", "left").select("id", F.coalesce("bad", F.lit(0)).alias("bad"))


def propagate_invalid(records: DataFrame, references: DataFrame) -> DataFrame:
    """(id, invalid) over typed references (id, target, identity_only): what refers to an invalid record becomes invalid.

    An entity's identity survives the failure of its description: references that need the identity only don't pass it on.
    """
    back = references.filter(~F.col("identity_only")).join(records.select("id"), "id", "left_semi").select(F.col("target").alias("a"), F.col("id").alias("b"))
    hit = reach(written(back, "edges"), records.filter("invalid").select("id", F.lit(1).alias("hit")), "hit")
    return records.select("id").join(hit, "id", "left").select("id", F.col("hit").isNotNull().alias("invalid"))


def dual_channel(entities: DataFrame) -> DataFrame:
    """identity and description eligibility of entities (eligibility, identity_invalid): a description may fail alone."""
    identity = F.when(F.col("identity_invalid"), "invalid").when(F.col("status") == "superseded", "historical").otherwise("current")
    return entities.withColumn("identity_eligibility", identity).withColumn("description_eligibility", F.when(identity == "invalid", "invalid").otherwise(F.col("eligibility")))


def check_references(references: DataFrame, records: DataFrame) -> DataFrame:
    """(id, field, reason) of typed references (id, field, target, kind, owner) that don't hold: missing, wrong kind, or a revision of another owner."""
    r = records.select(F.col("id").alias("target"), F.col("kind").alias("is"), F.col("owner").alias("of"))
    rows = references.join(r, "target", "left")
    reason = F.when(F.col("is").isNull(), "missing").when(F.col("is") != F.col("kind"), "kind").when((F.col("is") == "revision") & ~F.col("of").eqNullSafe(F.col("owner")), "owner")
    return rows.select("id", "field", reason.alias("reason")).filter("reason is not null")


def apply_decisions(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(id, eligibility, reasons) of active decisions (id, action, inputs, outputs) against the records' statuses.

    accept and reject need assertions with that status; merge needs superseded inputs and one active output that they
    name; split superseded inputs and active outputs; correct superseded or retracted inputs, and of evidence a successor (a
    record that is one of the outputs) that names it as its predecessor, in a column predecessor if there is one. Decisions that
    have a status other than active don't count. A mismatch is invalid.
    """
    if "status" in decisions.columns:
        decisions = decisions.filter("status = 'active'")
    if "predecessor" not in records.columns:
        records = records.withColumn("predecessor", F.lit(None).cast("string")).withColumn("kind", F.lit(None).cast("string"))
    one = lambda side: decisions.select("id", "action", F.lit(side).alias("side"), F.explode(side).alias("record"), F.size("outputs").alias("n"), F.get("outputs", F.lit(0)).alias("first"), "inputs")
    rows = one("inputs").unionByName(one("outputs")).join(records.select(F.col("id").alias("record"), F.col("status"), "superseded_by", "predecessor", "kind"), "record", "left")
    s, a, inp = F.col("status"), F.col("action"), F.col("side") == "inputs"
    wrong = (
        F.when(s.isNull(), "missing")
        .when((a == "accept") & inp & (s != "accepted"), "not accepted")
        .when((a == "reject") & inp & (s != "rejected"), "not rejected")
        .when((a == "merge") & inp & ((s != "superseded") | ~F.col("superseded_by").eqNullSafe(F.col("first"))), "not merged")
        .when((a == "merge") & (F.col("n") != 1), "several outputs")
        .when((a == "split") & inp & (s != "superseded"), "not superseded")
        .when(a.isin("merge", "split") & ~inp & (s != "active"), "not active")
        .when((a == "correct") & inp & ~s.isin("superseded", "retracted"), "not replaced")
        .when((a == "correct") & ~inp & (F.col("kind") == "evidence") & ~F.coalesce(F.array_contains("inputs", F.col("predecessor")), F.lit(False)), "names no predecessor")
    )
    out = rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(wrong)), ",").alias("reasons"))
    return decisions.select("id").join(out, "id", "left").select("id", F.when(F.coalesce("reasons", F.lit("")) == "", "current").otherwise("invalid").alias("eligibility"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def integrity(captured: DataFrame) -> DataFrame:
    """(id, ok) of captured bytes (id, content, hash, quote, start, end): the hash holds, and the quote is the slice."""
    same = F.sha2("content", 256) == F.col("hash")
    quote = F.col("quote").isNull() | (F.substring(F.col("content"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) == F.col("quote").cast("binary"))
    return captured.select("id", (same & quote).alias("ok"))


def newly_invalid(before: DataFrame, after: DataFrame) -> DataFrame:
    """The activation gate: ids that a proposal would make invalid, and assertions whose endpoints it would change."""
    rows = before.select("id", F.col("eligibility").alias("was"), F.col("target").alias("from")).join(after.select("id", "eligibility", "target"), "id")
    bad = F.when((F.col("was") != "invalid") & (F.col("eligibility") == "invalid"), "invalidated").when(~F.col("from").eqNullSafe(F.col("target")), "retargeted")
    return rows.select("id", bad.alias("reason")).filter("reason is not null")
