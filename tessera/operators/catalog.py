"""Catalog upkeep: health, identity claims, inventories, source lifecycle, deltas, links, research hand-over, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.store import written

#: Caps of a hand-over's passages and bytes, and of the maintenance queue.
PASSAGES, PASSAGE_BYTES, QUEUE = 32, 64 * 1024, 128


def health(diagnostics: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: diagnostics, documents excluded from search, documents to be inspected only."""
    a = diagnostics.agg(F.count("*").alias("diagnostics"))
    b = documents.agg(F.count_if(F.col("eligibility").isin("withdrawn", "invalid")).alias("excluded"), F.count_if(F.col("record_id").isNull() & F.col("source_id").isNull()).alias("inspection_only"))
    return a.join(b)  # one row each


def duplicate_ids(claims: DataFrame) -> DataFrame:
    """(record_id, paths, n): ids that more than one path claims."""
    rows = claims.select("record_id", "path").distinct().groupBy("record_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    return rows.filter("n > 1").select("record_id", "paths", "n")


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def exists(*probes: DataFrame) -> DataFrame:
    """One row: whether any probe has a row."""
    return reduce(DataFrame.unionByName, [p.select(F.lit(1).alias("x")).limit(1) for p in probes]).agg((F.count("*") > 0).alias("found"))


def inventory(objects: DataFrame) -> DataFrame:
    """(class, objects, bytes, distinct_contents, duplicate_bytes) of stored objects (class, hash, bytes)."""
    by = objects.groupBy("class", "hash").agg(F.count("*").alias("n"), F.max("bytes").alias("b"))
    return by.groupBy("class").agg(F.sum("n").alias("objects"), F.sum(F.col("n") * F.col("b")).alias("bytes"), F.count("*").alias("distinct_contents"), F.sum((F.col("n") - 1) * F.col("b")).alias("duplicate_bytes"))


def omissions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("record", "path", "reason").agg(F.sum("count").alias("count"))


def matching_revision(captures: DataFrame, revisions: DataFrame) -> DataFrame:
    """(capture_id, revision): the retained revision of least ordinal with the same source, original and content hash (null equals null) and extractor.

    Each key's least ordinal is found first, so that a capture meets one row however many revisions are alike.
    """
    key = ["source_id", "original_hash", "content_hash", "extractor"]
    least = revisions.groupBy(*key).agg(F.min("ordinal").alias("revision")).select(*[F.col(k).alias(f"r_{k}") for k in key], "revision")
    same = (F.col("source_id") == F.col("r_source_id")) & (F.col("original_hash") == F.col("r_original_hash")) & F.col("content_hash").eqNullSafe(F.col("r_content_hash")) & (F.col("extractor") == F.col("r_extractor"))
    return captures.join(least, same, "left").select("capture_id", "revision")


def capture(objects: DataFrame) -> DataFrame:
    """(id, status, content, hash): bytes that are UTF-8 become content, others are unsupported and have none."""
    ok = F.is_valid_utf8(F.col("bytes").cast("string"))
    return objects.select("id", F.when(ok, "complete").otherwise("unsupported").alias("status"), F.when(ok, F.col("bytes").cast("string")).alias("content"), F.sha2("bytes", 256).alias("hash"))


def withdrawal(source: str, revisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, id) that a withdrawal affects: the source's revisions and the distinct assertions with evidence from it."""
    a = revisions.filter(F.col("source_id") == source).select(F.lit("revision").alias("kind"), F.col("id"))
    b = evidence.filter(F.col("source_id") == source).select(F.lit("assertion").alias("kind"), F.col("assertion_id").alias("id")).distinct()
    return a.unionByName(b)


def new_evidence(claims: DataFrame, revisions: DataFrame) -> DataFrame:
    """(id, assertion_id, source_id, revision, stance, span_start, span_end, quote_hash, error) of claims (id, assertion_id, source_id, stance, quote) on
    the sources' current revisions (source_id, revision, text): a record where the quote stands exactly once, else the error: no source, no quote, ambiguous quote."""
    from tessera.functions.text import unique_start

    rows = claims.join(revisions.select("source_id", "revision", "text"), "source_id", "left").withColumn("at", unique_start(F.col("text"), F.col("quote")))
    error = F.when(F.col("text").isNull(), "no source").when(F.col("at").isNotNull(), "").when(F.contains("text", F.col("quote")) & (F.length("quote") > 0), "ambiguous quote").otherwise("no quote")
    ok = lambda c: F.when(F.col("at").isNotNull(), c)
    return rows.select("id", "assertion_id", "source_id", "revision", "stance", F.col("at").alias("span_start"), ok(F.col("at") + F.octet_length("quote")).alias("span_end"), ok(F.sha2(F.col("quote").cast("binary"), 256)).alias("quote_hash"), error.alias("error"))


def revalidate(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """(id, state, start): evidence (id, source_id, revision, quote) against the sources' current revisions (source_id, revision, text).

    kept on the current revision; moved with its new byte start where the quote stands once in the newer text; else lost.
    """
    rows = evidence.join(current.select("source_id", F.col("revision").alias("now"), "text"), "source_id", "left")
    once = F.contains(F.col("text"), F.col("quote")) & F.expr("locate(quote, text, instr(text, quote) + 1) = 0")
    start = F.octet_length(F.expr("substring(text, 1, instr(text, quote) - 1)"))
    state = F.when(F.col("revision") == F.col("now"), "kept").when(F.coalesce(once, F.lit(False)), "moved").otherwise("lost")
    return rows.select("id", state.alias("state"), F.when(state == "moved", start).cast("long").alias("start"))


def resolve_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(from_path, target, resolution, to_path) of untyped links: exact path, then path.md, then the union of stems and aliases; several hits are ambiguous."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    exact = documents.select(F.col("path").alias("k"), "path", F.lit(0).alias("tier"))
    noted = documents.filter(F.col("path").endswith(".md")).select(F.expr("left(path, length(path) - 3)").alias("k"), "path", F.lit(1).alias("tier"))
    loose = documents.select(stem.alias("k"), "path", F.lit(2).alias("tier")).unionByName(documents.select(F.explode("aliases").alias("k"), "path", F.lit(2).alias("tier")))
    keys = exact.unionByName(noted).unionByName(loose)
    # one row for each key, its best tier: an alias that many documents have is one as well
    tiers = keys.groupBy("k", "tier").agg(F.min("path").alias("path"), F.max("path").alias("other"))
    keys = tiers.groupBy("k").agg(F.min(F.struct("tier", "path", "other")).alias("best")).select("k", "best.path", (F.col("best.path") != F.col("best.other")).alias("several"))
    out = links.select("from_path", "target").distinct().join(keys, F.col("target") == F.col("k"), "left")
    return out.select("from_path", "target", F.when(F.col("k").isNull(), "missing").when(F.col("several"), "ambiguous").otherwise("resolved").alias("resolution"), F.when(~F.col("several"), F.col("path")).alias("to_path"))


def typed_links(links: DataFrame, records: DataFrame) -> DataFrame:
    """(from_path, target_id, resolution) of links with an id, an expected kind and a companion path: missing, kind, conflict, stale or resolved."""
    r = records.select(F.col("id").alias("target_id"), F.col("kind").alias("is"), F.col("path").alias("at"), F.col("eligibility").alias("e"))
    rows = links.join(r, "target_id", "left")
    out = F.when(F.col("is").isNull(), "missing").when(F.col("is") != F.col("kind"), "kind").when(F.col("companion").isNotNull() & (F.col("companion") != F.col("at")), "conflict").when(F.col("e") != "current", "stale").otherwise("resolved")
    return rows.select("from_path", "target_id", out.alias("resolution"))


def affected_links(link_keys: DataFrame, changed_keys: DataFrame) -> DataFrame:
    """(from_path, byte_start) of links that share a match key (id, path, basename or alias) with what changes."""
    return link_keys.select("from_path", "byte_start", F.explode("keys").alias("key")).join(changed_keys.select("key").distinct(), "key", "left_semi").select("from_path", "byte_start").distinct()


def merge_entities(assertions: DataFrame, remap: DataFrame) -> DataFrame:
    """Assertions with endpoints remapped (old, new); an accepted one that changes returns to proposed."""
    s, o = remap.select(F.col("old").alias("subject_id"), F.col("new").alias("_s")), remap.select(F.col("old").alias("object_id"), F.col("new").alias("_o"))
    rows = assertions.join(s, "subject_id", "left").join(o, "object_id", "left")
    moved = F.col("_s").isNotNull() | F.col("_o").isNotNull()
    status = F.when(moved & (F.col("status") == "accepted"), "proposed").otherwise(F.col("status"))
    return rows.select("id", F.coalesce("_s", "subject_id").alias("subject_id"), "predicate", F.coalesce("_o", "object_id").alias("object_id"), status.alias("status"))


def remap_errors(remap: DataFrame, assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """(reason, id) of a remap (assertion_id, side, old, new) of merged sources (id): every reference must be listed, once, and no other."""
    one = lambda side: assertions.select(F.col("id").alias("assertion_id"), F.lit(side).alias("side"), F.col(f"{side}_id").alias("old"))
    full = one("subject").unionByName(one("object")).join(sources.select(F.col("id").alias("old")), "old", "left_semi").select("assertion_id", "side", "old")
    given = remap.select("assertion_id", "side", "old")
    ident = F.concat_ws(":", "assertion_id", "side")
    missing = full.join(given, ["assertion_id", "side", "old"], "left_anti").select(F.lit("missing").alias("reason"), ident.alias("id"))
    extra = given.join(full, ["assertion_id", "side", "old"], "left_anti").select(F.lit("not a reference").alias("reason"), ident.alias("id"))
    twice = given.groupBy("assertion_id", "side").count().filter("count > 1").select(F.lit("twice").alias("reason"), ident.alias("id"))
    return missing.unionByName(extra).unionByName(twice)


#: How many entities a request merges, and how many it splits one into.
MERGED, SPLIT = (1, 16), (2, 16)


def identity_requests(requests: DataFrame, remap: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request, reasons) of merge, split and alias requests, and (id, subject_id, object_id, status) of the assertions that sound ones change.

    requests (request, action, sources, targets): a merge takes 1 to 16 sources to one target that is none of them, a split one source to 2 to 16
    targets, an alias changes nothing. remap (request, assertion_id, side, new) must name every reference to a source once and no other, each to a target of
    its request, and nothing for an alias. An entity is in one request only. A reference that changes takes an accepted assertion back to
    proposed. Reasons: counts, target, scopes, missing, not a reference, twice, not a target, alias.
    """
    n, m = F.size("sources"), F.size("targets")
    act = F.col("action")
    counts = F.when(act == "merge", n.between(*MERGED) & (m == 1)).when(act == "split", (n == 1) & m.between(*SPLIT)).when(act == "alias", n == 1).otherwise(False)
    own = requests.select("request", F.when(~counts, "counts").alias("reason")).unionByName(requests.select("request", F.when((act != "alias") & F.arrays_overlap("sources", "targets"), "target").alias("reason")))
    scope = requests.select("request", F.explode(F.array_union("sources", "targets")).alias("entity")).distinct()
    crowded = scope.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    own = own.unionByName(scope.join(crowded, "entity", "left_semi").select("request", F.lit("scopes").alias("reason")))
    sources = requests.filter("action <> 'alias'").select("request", F.explode("sources").alias("old"))
    side = lambda name: assertions.select(F.col("id").alias("assertion_id"), F.lit(name).alias("side"), F.col(f"{name}_id").alias("old"))
    need = side("subject").unionByName(side("object")).join(sources, "old").select("request", "assertion_id", "side").distinct()
    given = remap.select("request", "assertion_id", "side", "new")
    place = ["request", "assertion_id", "side"]
    own = own.unionByName(need.join(given, place, "left_anti").select("request", F.lit("missing").alias("reason")))
    known = given.join(requests.select("request", "action", "targets"), "request")
    own = own.unionByName(known.filter("action = 'alias'").select("request", F.lit("alias").alias("reason")))
    own = own.unionByName(known.filter("action <> 'alias'").join(need, place, "left_anti").select("request", F.lit("not a reference").alias("reason")))
    own = own.unionByName(known.filter(~F.array_contains("targets", F.col("new"))).filter("action <> 'alias'").select("request", F.lit("not a target").alias("reason")))
    own = own.unionByName(given.groupBy(*place).count().filter("count > 1").select("request", F.lit("twice").alias("reason")))
    found = own.filter("reason is not null").groupBy("request").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    judged = requests.select("request").join(found, "request", "left").select("request", F.coalesce("reasons", F.lit("")).alias("reasons"))
    sound = given.join(judged.filter("reasons = ''"), "request", "left_semi").groupBy("assertion_id").agg(F.min(F.when(F.col("side") == "subject", F.col("new"))).alias("s"), F.min(F.when(F.col("side") == "object", F.col("new"))).alias("o"))
    moved = assertions.join(sound, F.col("id") == F.col("assertion_id"))
    status = F.when(F.col("status") == "accepted", "proposed").otherwise(F.col("status"))
    return judged, moved.select("id", F.coalesce("s", "subject_id").alias("subject_id"), F.coalesce("o", "object_id").alias("object_id"), status.alias("status"))


#: Kinds of maintenance, in their order, and how many tasks a run shows.
MAINTENANCE = ("revalidate_report_citations", "review_report_for_synthesis", "refresh_research_packet", "review_contradiction", "repair_evidence_navigation", "repair_page_support", "repair_navigation")
MOST_TASKS = 128
BROKEN = ("Missing", "Ambiguous", "WrongKind", "CompanionConflict")
#: Bits of a bitmap (those of Spark's functions, 4 KB), how many bitmaps are broadcast at most (64 MB), and sources whose first tasks are merged at a time.
BITS, SMALL_BITS, LISTED = 32_768, 16_384, 256


def run_maintenance(runs: DataFrame, scopes: DataFrame, evidence: DataFrame, records: DataFrame, depends: DataFrame, links: DataFrame) -> DataFrame:
    """(run, place, kind, id, omitted): what each research run leaves to repair, in the order of MAINTENANCE and id, at most MOST_TASKS of it; omitted counts the rest.

    runs (run, has_report, fresh, claims, packet_stale), scopes (run, source_id): the sources of a run's scope, captures and citations. What a run is about are
    assertions with evidence (id, source_id, assertion_id) of its sources. Rules: a report whose citations aren't current, one with claims, a stale packet; an
    assertion that is disputed or whose evidence link is at fault (records: id, kind, status, eligibility, disputed, link_fault); a reviewed page that depends (id,
    depends_on) on one and isn't current; and one that depends on one or links (from_id, target_id, resolution) to one, to its evidence or to a source, and has a
    broken link. What a source leaves to repair is found once for each source; a run has the union of its sources' tasks, which are shown from the first
    MOST_TASKS of each and counted by OR of bitmaps, so that no row stands for a run and an evidence record. An id is in records once.
    """
    task = lambda rows, kind: rows.select("source_id", F.lit(MAINTENANCE.index(kind)).alias("o"), F.col("id").cast("string").alias("id")).distinct()
    scopes = written(scopes.select("run", "source_id").distinct(), "scopes")
    of_source = evidence.select("source_id", F.col("id").alias("evidence_id"), "assertion_id").join(scopes.select("source_id").distinct(), "source_id", "left_semi")
    about = written(of_source.select("source_id", "assertion_id").distinct(), "about")
    asserted = about.join(records.filter("kind = 'assertion' and (disputed or link_fault)").select(F.col("id").alias("assertion_id"), "disputed", "link_fault"), "assertion_id").withColumnRenamed("assertion_id", "id")
    pages = records.filter("kind = 'page' and status = 'reviewed'").select("id", "eligibility")
    at_fault = F.split("resolution", ":").getItem(0).isin(*BROKEN)
    broken = links.filter(at_fault).select(F.col("from_id").alias("id")).join(pages.select("id"), "id", "left_semi").distinct()
    relevant = depends.join(pages, "id").select("id", "eligibility", F.col("depends_on").alias("assertion_id")).join(about, "assertion_id").select("source_id", "id", "eligibility").distinct()
    linked = links.select(F.col("from_id").alias("id"), "target_id").distinct().join(broken, "id", "left_semi")
    named = about.withColumnRenamed("assertion_id", "target_id").unionByName(of_source.select("source_id", F.col("evidence_id").alias("target_id"))).unionByName(scopes.select("source_id", F.col("source_id").alias("target_id")).distinct())
    near = relevant.select("source_id", "id").join(broken, "id", "left_semi").unionByName(linked.join(named, "target_id").select("source_id", "id").distinct())
    tasks = [task(asserted.filter("disputed"), MAINTENANCE[3]), task(asserted.filter("link_fault"), MAINTENANCE[4]), task(relevant.filter("eligibility <> 'current'"), MAINTENANCE[5]), task(near, MAINTENANCE[6])]
    by_source = written(reduce(DataFrame.unionByName, tasks), "tasks")
    # the first tasks of a run are among the first ones of its sources; a run's sources are taken LISTED at a time
    first = by_source.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("o", "id"))).filter(F.col("n") <= MOST_TASKS)
    first = first.groupBy("source_id").agg(F.collect_list(F.concat("o", "id")).alias("first"))  # as text, whose copies an array drops by hash; a kind is one digit
    merged = lambda col: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(col)))), 1, MOST_TASKS).alias("first")
    some = F.floor((F.row_number().over(Window.partitionBy("run").orderBy("source_id")) - 1) / LISTED).alias("some")
    shown = scopes.select("run", "source_id", some).join(first, "source_id").groupBy("run", "some").agg(merged("first")).groupBy("run").agg(merged("first"))
    # each task has a bit of a chunk; a source has a bitmap of each chunk
    items = by_source.select("o", "id").distinct()
    parts = items.count() // (BITS * 3 // 4) + 1
    items = items.withColumn("part", F.pmod(F.xxhash64("o", "id"), F.lit(parts))).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("o", "id")) - 1)
    numbered = by_source.join(items.select("o", "id", F.struct("part", F.floor(F.col("n") / BITS).alias("more")).alias("chunk"), (F.col("n") % BITS).cast("long").alias("bit")), ["o", "id"])
    bits = written(numbered.groupBy("source_id", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits")), "bits")
    if bits.count() <= SMALL_BITS:
        bits = F.broadcast(bits)
    counted = scopes.repartition("run").join(bits, "source_id").groupBy("run", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("run").agg(F.sum("n").alias("total"))
    own = F.array(F.when(F.expr("has_report and not fresh"), F.lit(0)), F.when(F.expr("has_report and claims > 0"), F.lit(1)), F.when(F.col("packet_stale"), F.lit(2)))
    own = runs.select("run", F.transform(F.array_compact(own), lambda o: F.concat(o, F.col("run").cast("string"))).alias("first"))
    all_ = own.select("run", "first", F.size("first").cast("long").alias("total")).unionByName(shown.join(counted, "run").select("run", "first", "total"))
    rows = all_.groupBy("run").agg(merged("first"), F.sum("total").alias("total"))
    kind = F.element_at(F.array(*[F.lit(k) for k in MAINTENANCE]), F.substring("task", 1, 1).cast("int") + 1)
    rows = rows.select("run", "total", F.posexplode("first").alias("n", "task"))
    return rows.select("run", (F.col("n") + 1).alias("place"), kind.alias("kind"), F.expr("substring(task, 2)").alias("id"), F.greatest(F.col("total") - MOST_TASKS, F.lit(0)).alias("omitted"))


def set_differences(rows: DataFrame) -> DataFrame:
    """(id, missing, extra) of rows (id, expected, actual: arrays): what one has and the other hasn't, in order, joined by commas."""
    listed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return rows.select("id", listed("expected", "actual").alias("missing"), listed("actual", "expected").alias("extra"))


def review(evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, outcome) of reviewed evidence (id, stance): same assessment unchanged, another stance retract and succeed, insufficient retract; uncovered if it has no answer; of several answers the least counts."""
    rows = evidence.join(answers.groupBy("id").agg(F.min("assessment").alias("assessment")), "id", "left")
    out = F.when(F.col("assessment").isNull(), "uncovered").when(F.col("assessment") == F.col("stance"), "unchanged").when(F.col("assessment") == "insufficient", "retract").otherwise("retract and succeed")
    return rows.select("id", out.alias("outcome"))


def extraction_errors(packet: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, reason) of extracted items (id, window, quote, refs): ids used once, references known, quotes exactly once in their window (overlaps counted)."""
    twice = packet.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("reason"))
    refs = packet.select("id", F.explode("refs").alias("ref")).join(packet.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("id", F.lit("unknown reference").alias("reason"))
    rows = packet.join(windows.select("window", "text"), "window", "left")
    at = F.expr("instr(text, quote)")
    state = F.when(F.col("text").isNull(), "unknown window").when(at == 0, "no quote").when(F.expr("locate(quote, text, instr(text, quote) + 1) > 0"), "ambiguous quote")
    return twice.unionByName(refs).unionByName(rows.select("id", state.alias("reason")).filter("reason is not null")).distinct()


def resolved_mentions(mentions: DataFrame, resolutions: DataFrame, entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """(assertion_id, state): ready when subject and object mentions are resolved to an active entity of the expected hash or to a new one, rejected if either is, else pending."""
    r = resolutions.join(entities.select(F.col("id").alias("entity"), F.col("hash").alias("is"), "status"), "entity", "left")
    ok = (F.col("action") == "create") | ((F.col("action") == "bind") & (F.col("status") == "active") & (F.col("is") == F.col("expected")))
    state = mentions.join(r.select("mention", F.when(F.col("action") == "reject", "rejected").when(F.coalesce(ok, F.lit(False)), "resolved").otherwise("pending").alias("m")), "mention", "left").select("mention", F.coalesce("m", F.lit("pending")).alias("m"))
    two = assertions.join(state.select(F.col("mention").alias("subject"), F.col("m").alias("s")), "subject", "left").join(state.select(F.col("mention").alias("object"), F.col("m").alias("o")), "object", "left")
    out = F.when((F.col("s") == "rejected") | (F.col("o") == "rejected"), "rejected").when((F.col("s") == "resolved") & (F.col("o") == "resolved"), "ready").otherwise("pending")
    return two.select("assertion_id", out.alias("state"))


def hand_over(passages: DataFrame, most: int = PASSAGES, most_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """(passage, owner, start, end): explicit ranges first, repeats and contained spans dropped, cut by running bytes; p1, p2, ... in order.

    passages: id, owner, start, end, explicit, rank. At most `most` rows reach the one task that numbers them.
    """
    from tessera.operators.intervals import contained

    once = passages.groupBy("owner", "start", "end").agg(F.min(F.struct(~F.col("explicit"), "rank", "id")).alias("b")).select("owner", "start", "end", F.col("b.rank").alias("rank"), F.col("b.id").alias("id"), F.col("b.col1").alias("late"))
    kept = once.join(contained(once.select("id", "owner", "start", "end")).select("id"), "id", "left_anti")
    first = kept.orderBy("late", "rank", "id").limit(most)
    w = Window.orderBy("late", "rank", "id")
    return first.withColumn("n", F.row_number().over(w)).withColumn("sum", F.sum(F.col("end") - F.col("start")).over(w)).filter(F.col("sum") <= most_bytes).select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("passage"), "owner", "start", "end")


def maintenance(*sources: tuple[str, DataFrame], most: int = QUEUE) -> DataFrame:
    """(task, id) of the queue: kinds in the order given, then id; at most `most`."""
    rows = [df.select(F.lit(i).alias("o"), F.lit(name).alias("task"), F.col("id").cast("string").alias("id")).distinct() for i, (name, df) in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).orderBy("o", "id").limit(most).select("task", "id")


def relations_admitted(relations: DataFrame, seeds: DataFrame, most_bytes: int) -> DataFrame:
    """(seed, rule, role, bytes): conditions and exceptions of a nominated rule are admitted together, or none of them if they are too large."""
    rows = relations.join(seeds.select(F.col("id").alias("rule")), "rule", "left_semi")
    total = rows.groupBy("rule").agg(F.sum("bytes").alias("total"))
    return rows.join(total, "rule").filter(F.col("total") <= most_bytes).select("rule", "role", "target", "bytes")


def recall_and_ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, ndcg) at k of ranked (query, doc, rank) against relevant (query, doc), binary gains."""
    gain: Column = 1 / F.log2(F.col("rank") + 1)
    hit = ranked.filter(F.col("rank") <= k).join(relevant, ["query", "doc"]).groupBy("query").agg(F.count("*").alias("hits"), F.sum(gain).alias("dcg"))
    n = relevant.groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = n.join(hit, "query", "left")
    return rows.select("query", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def complete_evidence(required: DataFrame, citations: DataFrame) -> DataFrame:
    """(question, required, covered, complete): how many of the evidence records that a question requires are covered by its citations, and whether all are.

    required (question, evidence_id, source_id, revision, start, end) is covered by a citation (question, evidence_id, source_id, revision,
    start, end) that names it, or whose span of the same source and revision contains its own; a citation has one of the two. Containment is a running
    maximum: a span is contained in one that starts no later and ends no earlier, so that the spans of a source are sorted once
    and no two are paired. Repeated rows count once; questions that require nothing are not among the rows.
    """
    need = required.select("question", "evidence_id", "source_id", "revision", "start", "end").distinct()
    named = citations.filter("evidence_id is not null").select("question", "evidence_id", F.lit(True).alias("named")).distinct()
    place = ["question", "source_id", "revision"]
    spans = citations.filter("evidence_id is null").groupBy(*place, "start").agg(F.max("end").alias("until")).withColumn("need", F.lit(None).cast("struct<evidence_id:string,end:long>"))
    both = spans.unionByName(need.select(*place, "start", F.lit(None).cast("long").alias("until"), F.struct(F.col("evidence_id").cast("string").alias("evidence_id"), F.col("end").cast("long").alias("end")).alias("need")))
    so_far = F.max("until").over(Window.partitionBy(*place).orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("so_far", so_far).filter("need is not null").select("question", F.col("need.evidence_id").alias("evidence_id"), F.coalesce(F.col("so_far") >= F.col("need.end"), F.lit(False)).alias("inside"))
    rows = found.join(named, ["question", "evidence_id"], "left").withColumn("hit", F.col("inside") | F.coalesce("named", F.lit(False)))
    sums = rows.groupBy("question").agg(F.count("*").alias("required"), F.count_if("hit").alias("covered"))
    return sums.select("*", (F.col("covered") == F.col("required")).alias("complete"))
