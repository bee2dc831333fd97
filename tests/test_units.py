"""Functions and operators on small tables with the awkward cases: bytes and characters, ties, caps, nulls, empty tables."""

from __future__ import annotations

import bisect
import dataclasses
import itertools
import json
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.operators import access, catalog, context, dense, eligibility, filters, graph, intervals, ledger, search
from tessera.plans import catalogue
from tessera.sources import index, model, store, vault
from tessera.streaming import ledger as streams

TEXTS = st.text(alphabet="ab é日\n#- `\r[]|", max_size=120)


@given(TEXTS, st.integers(4, 40))
@settings(max_examples=150, deadline=None)
def test_segments_cover_the_text_at_characters(t, capacity):
    raw, at = t.encode(), 0
    for n, start, end, _ in text.segments(t, capacity):
        assert start == at and end - start <= capacity and (n == 0 or end > start)
        raw[start:end].decode()
        at = end
    assert at == len(raw)


def test_segments_prefer_headings_then_blank_lines():
    t = "intro\n\nmore text here\n# A\nbody of a\n\n## B\nend"
    cut = [(t.encode()[a:b].decode(), h) for _, a, b, h in text.segments(t, 30)]
    assert cut == [("intro\n\nmore text here\n", []), ("# A\nbody of a\n\n## B\nend", ["A"])]
    assert [(a, h) for _, a, _, h in text.segments(t, 18)][-2:] == [(22, ["A"]), (37, ["A", "B"])]


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_token_spans_are_their_bytes(t):
    raw = t.encode()
    for token, a, b in text.token_spans(t):
        assert text.fold(raw[a:b].decode()) == token


@given(TEXTS, TEXTS)
@settings(max_examples=150, deadline=None)
def test_unique_quote_equals_brute_force(t, q):
    raw, quote = t.encode(), q.encode()
    at = [i for i in range(len(raw)) if quote and raw.startswith(quote, i)]
    assert text.unique_quote(t, q) == ((at[0], at[0] + len(quote)) if len(at) == 1 else None)


def test_literal_spans_do_not_overlap_and_are_capped():
    assert text.literal_spans("aaaa", "aa") == [(0, 2), (2, 4)] and len(text.literal_spans("é" * 200, "é")) == 64 and text.literal_spans(None, "a") == []


def test_query_matches_prefer_the_phrase_then_the_heaviest_window():
    t = "alpha " * 30 + "x " * 200 + "rare alpha beta"
    (a, b), *_ = text.query_matches(t, "alpha beta", 60)
    assert t[a:b] == "alpha beta"
    first = text.query_matches("alpha " * 30 + "y " * 200 + "beta z rare q alpha", "alpha rare beta", 60)[0]
    assert first[0] > 300
    assert text.excerpt("nothing here", "absent", 50) == [] and text.excerpt(None, "a", 10) == []


def test_readable_html_keeps_byte_ranges():
    t = "<p>é one</p><!-- <b>no</b> --><script>x<y</script><STYLE>p{}</STYLE>two <b>three</b>"
    runs = text.readable(t)
    assert [r for r, _, _ in runs] == ["é one", "two", "three"] and all(t.encode()[a:b].decode() == r for r, a, b in runs)


def test_links_skip_code_and_escapes():
    found = text.links("é [[A|b]] \\[[no]] `[[code]]` [t](p/q.md) ```\n[[x]]\n``` [[bad\nline]]")
    assert found == [(3, "A", "b"), (28, "p/q.md", "t")] or [f[1:] for f in found] == [("A", "b"), ("p/q.md", "t")]


def test_notes():
    assert text.parse_note("﻿---\r\na: 1\r\n---\r\nbody")[0][:2] == ("record", [("a", "1")])
    assert text.parse_note("---\na: 1\nno end")[0][3] == "unterminated" and text.parse_note("---\na: 1\na: 2\n---\n")[0][3] == "repeated key" and text.parse_note(None)[0][0] == "plain"


@given(st.lists(st.tuples(st.sampled_from(["prose", "code", "list", "heading"]), st.sampled_from([5, 48, 49, 90])), max_size=12), st.sampled_from([40, 100, 300, 9999]))
@settings(max_examples=300, deadline=None)
def test_teaching_blocks_follow_their_rule(parts, capacity):
    """Groups are runs of whole blocks; a group of several begins with prose or code, fits, and is one that the rule allows."""
    ends = list(itertools.accumulate(n for _, n in parts))
    found = [(k, end - n, end) for (k, n), end in zip(parts, ends, strict=True)]
    groups = text.teaching_blocks(found, capacity)
    assert [g[1:] for g in groups] == list(zip([0, *[g[2] for g in groups][:-1]], [g[2] for g in groups], strict=True)) if found else groups == []
    of = lambda g: [k for k, a, b in found if g[1] <= a and b <= g[2]]
    for n, g in enumerate(groups):
        kinds = of(g)
        assert sum(b - a for _, a, b in found if g[1] <= a and b <= g[2]) == g[2] - g[1]
        assert len(kinds) == 1 or g[2] - g[1] <= capacity and kinds[0] in ("prose", "code") and "heading" not in kinds
        assert "list" not in kinds[:-1] and kinds.count("list") + kinds.count("code") <= 10
        if kinds == ["prose"] and n + 1 < len(groups) and of(groups[n + 1])[0] in ("code", "list"):
            first = next(b for _, a, b in found if a == groups[n + 1][1])
            assert first - g[1] > capacity  # else it would have gone with that


def naive_segments(t: str, capacity: int) -> list[tuple]:
    raw, at, out = t.encode(), 0, []
    starts = [0, *[m.end() for m in re.finditer(rb"\n", raw)]]
    title = lambda i: re.match(r"(#{1,6}) (.*)", raw[i:].split(b"\n")[0].decode().rstrip("\r"))
    while at < len(raw) or not out:
        end = min(at + capacity, len(raw))
        while 0 < end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end < len(raw):
            heads = [i for i in starts if at < i < end and title(i)]
            blank = [i for i in range(at + 1, end + 1) if (raw[i - 1 : i] == b"\n" or i == end) and not raw[max(at, starts[bisect.bisect_left(starts, i) - 1]) : i].strip(b"\r\n")]
            end = heads[-1] if heads else blank[-1] if blank else end
        above: list = []
        for i in starts:
            if i <= at and i < len(raw) and title(i):
                above = [x for x in above if len(x[1]) < len(title(i)[1])] + [title(i)]
        out.append((len(out), at, end, [m[2].strip().rstrip("#").strip() for m in above]))
        at = end
        if not raw:
            break
    return out


@given(TEXTS, st.integers(4, 40))
@settings(max_examples=300, deadline=None)
def test_segments_equal_brute_force(t, capacity):
    assert text.segments(t, capacity) == naive_segments(t, capacity)


@given(st.text(alphabet="ab é.", max_size=90), st.sampled_from(["a", "a b", "b a é", "ab ab", "z"]), st.sampled_from([9, 20, 60]))
@settings(max_examples=300, deadline=None)
def test_query_matches_equal_brute_force(t, query, size):
    raw, spans, wanted = t.encode(), text.token_spans(t), [w for w, _, _ in text.token_spans(query)]
    whole = [(spans[i][1], spans[i + len(wanted) - 1][2]) for i in range(len(spans) - len(wanted) + 1) if [s[0] for s in spans[i : i + len(wanted)]] == wanted]
    whole = [(a, b) for a, b in whole if b - a <= size * 2 // 3] if len(wanted) > 1 else []
    hits = [s for s in spans if s[0] in wanted]
    best, most = None, 0
    for w, a, b in hits:
        lo, hi = text.excerpt_window(raw, a, size)
        inside = [h for h in hits if h[1] >= lo and h[2] <= hi]
        votes = sum(int((1 + math.log(len(spans) / sum(h[0] == x for h in hits))) * 1e6 + 0.5) for x in {h[0] for h in inside})
        if votes > most:
            best, most = [(a, b), *[h[1:] for h in inside if h[1:] != (a, b)]], votes
    assert text.query_matches(t, query, size) == (whole or best or [])[:64]


def test_blocks_group_teaching_text():
    t = "# H\n\nRun this command to see the whole list of things:\n\n```\nls\n```\n\nThen read on, as the rest explains what was meant.\n\n- a\n- b\n"
    kinds = [k for k, _, _ in text.blocks(t)]
    assert kinds == ["heading", "prose", "code", "prose", "list"]
    assert [k for k, _, _ in text.teaching_blocks(text.blocks(t), 1000)] == ["heading", "code", "list"]
    assert len(text.teaching_blocks(text.blocks(t), 10)) == 5


def test_content_terms_keep_identifiers():
    assert text.content_terms("how can I use `can` and object.is or the --with flag") == ["use", "can", "object", "is", "with", "flag"]
    assert text.content_terms("see .is.x now") == ["see", "x", "now"]
    assert text.content_terms("Is is() it. a/of can_do THE what-if") == ["is", "of", "can", "do", "what", "if"]


def test_stems(spark):
    words = ["running", "sing", "used", "classes", "glass", "cafés", "walked", "notes", "bed", "houses"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(text.term_key(F.col("w"))).collect()
    assert [r[0] for r in rows] == ["runn", "sing", "used", "class", "glass", "cafés", "walk", "note", "bed", "hous"]


def test_scalars(spark):
    df = spark.createDataFrame([("2024-02-29", "2024-01-01T00:00:00Z", "-0.50", "a.b-c", "x/y.md"), ("2023-02-29", "2024-01-01 00:00", "007", "-x", "../x"), (None, None, None, None, None)], "d string, t string, n string, i string, p string")
    rows = df.select(scalars.as_date(F.col("d")).isNotNull(), scalars.as_timestamp(F.col("t")).isNotNull(), scalars.is_decimal(F.col("n")), scalars.is_record_id(F.col("i")), scalars.is_vault_path(F.col("p")), scalars.stem(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, True, True, "y"), (False, False, False, False, False, "x"), (False, False, None, None, None, None)]
    assert spark.range(1).select(scalars.price(F.lit(10), F.lit(7), F.lit(3)).cast("long")).first()[0] == 24


def test_query_and_plan_checks():
    for bad in ("", " \n", "a\0b", "x " * 300, "y" * 20_000):
        with pytest.raises(ValueError):
            filters.checked_query(bad)
    with pytest.raises(ValueError):
        filters.checked_plan(51, 80, 10)
    with pytest.raises(ValueError):
        filters.Filters(kinds=[" "]).normalised()
    assert filters.Filters(tags=["b", "a", "b"], path_prefix=" p ").normalised() == filters.Filters((), ("a", "b"), (), (), "p")


def test_cursor_is_bound_to_its_query():
    c = search.cursor("q", "s1", 20)
    assert search.opened(c, "q", "s1") == 20
    for other in (("q", "s2"), ("r", "s1")):
        with pytest.raises(ValueError):
            search.opened(c, *other)


def test_phrase_hits_and_bm25_by_hand(spark):
    docs = spark.createDataFrame([("p1", "a b a b c"), ("p2", "b a"), ("p3", ""), ("p4", None), ("p5", "Á b"), (None, "a b")], "path string, body string")
    t = index.build(docs, "path", ["body"])
    assert (t.count, t.sums) == (5, {"body": 9})
    assert {r["path"]: r["n"] for r in search.phrase_hits(t, [["a", "b"]]).collect()} == {"p1": 2, "p5": 1}
    got = {r["path"]: r["score"] for r in search.bm25_unit_form(t, ["a"]).collect()}
    n, df, avg = 5, 3, 9 / 5
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    assert got == {p: pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / avg))) for p, f, size in (("p1", 2, 5), ("p2", 1, 2), ("p5", 1, 2))}
    low = {r["path"]: r["score"] for r in search.bm25_index_form(t, "c a,b", {"body": 1.0}).collect()}
    assert low["p1"] < low["p5"] <= 0 and set(low) == {"p1", "p5"}
    assert index.build(docs.limit(0), "path", ["body"]).count == 0


def test_index_reads_the_terms_buckets_and_knows_missing_postings(spark):
    docs = spark.createDataFrame([(i, f"common w{i} w{i % 7} aa aa", [f"t{i % 3}", "aa"]) for i in range(60)], "k int, body string, tags array<string>")
    t = index.build(docs, "k", ["body", "tags"])
    plan = t.of_terms(["w3"])._jdf.queryExecution().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*{index.bucket_of('w3', t.buckets)}", plan) and re.search(r"PushedFilters: \[[^]]*EqualTo\(term,w3\)", plan)
    twice = {r["k"]: r["n"] for r in search.phrase_hits(t, [["aa", "aa"]], ["body"]).collect()}
    assert twice == dict.fromkeys(range(60), 1)
    assert index.unmatched(t).count() == 0
    broken = dataclasses.replace(t, postings=t.postings.withColumn("n", F.expr("n - int(k = 5 and term = 'aa' and field = 'body')")).filter("k <> 6"), rows=t.rows.filter("k <> 7"))
    assert {(r["k"], r["field"], r["reason"]) for r in index.unmatched(broken).collect()} == {
        (5, "body", "postings are missing"), (6, "body", "no postings"), (6, "tags", "no postings"), (7, "body", "postings without a row"), (7, "tags", "postings without a row")
    }


def test_dense_order_and_zero_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 1, [1.0, 0.0]), (4, 2, [0.0, 0.0]), (5, 2, [-1.0, 0.0]), (6, None, [1.0, 0.0])]
    units = spark.createDataFrame(rows, "unit_id long, owner int, embedding array<float>")
    got = [(r["owner"], r["owner_rank"], r["unit_rank"], r["unit_id"]) for r in dense.dense_owners(units, [1.0, 0.0], 2).orderBy("owner_rank", "unit_rank").collect()]
    assert got == [(0, 1, 1, 1), (0, 1, 2, 2), (1, 2, 1, 3)]


def test_worklist_fills_batches_greedily(spark):
    sizes = {f"{i:03d}": (i * 7919) % 90_000 + 1 for i in range(120)}
    units = spark.createDataFrame([(k, v) for k, v in sizes.items()] * 2, "input_hash string, bytes long")
    have = spark.createDataFrame([("005",)], "input_hash string")
    rows = dense.worklist(units, have, 3).orderBy("shard", "input_hash").collect()
    assert len(rows) == 119
    for _, group in itertools.groupby(rows, lambda r: r["shard"]):
        batch = items = held = 0
        for r in group:
            if items and (items == dense.BATCH_ITEMS or held + r["bytes"] > dense.BATCH_BYTES):
                batch, items, held = batch + 1, 0, 0
            items, held = items + 1, held + r["bytes"]
            assert r["batch"] == batch


def packed_by_hand(rows: list[dict], most_bytes: int, excerpt: int, per_owner: int, header: int = 120) -> dict:
    """key -> (position, reason) by trying every packet each time."""
    total = sum(max(w for r in rows for t, w in zip(r["terms"], r["weights"], strict=True) if t == name) for name in {t for r in rows for t in r["terms"]}) or 1
    best = max([0, *(r["affinity"] for r in rows if r["affinity"] is not None)])
    covered, inside, out, queue = set(), [], {}, [(r, False) for r in rows]

    def worth(r: dict, child: bool) -> float:
        if child:
            return round(r["score"], 12)
        novel, local = sum(w for t, w in zip(r["terms"], r["weights"], strict=True) if t not in covered) / total, r["local"] / total
        if r["affinity"] is not None:
            x = (0.05 + ((max(r["affinity"], 0) / best) if best else 0) ** 4) * (1 + 0.25 * novel + 0.5 * local)
        else:
            x = (0.25 + 2 * novel + 0.5 * local + 0.05 * r["seed"]) * (0.15 if best else 1)
        return round(r["score"] * x * r["density"] * (0.7 if r["clipped"] else 1), 12)

    while queue:
        r, child = min(queue, key=lambda q: (-worth(*q), q[0]["key"], q[1]))
        queue.remove((r, child))
        a, b = (r["child_start"], r["child_end"]) if child else (r["start"], r["end"])
        if not child and any(o == r["owner"] and x <= a and b <= y for o, x, y, _ in inside):
            out[r["key"]] = (None, "contained")
            continue
        near = [x for x in inside if x[0] == r["owner"] and not (x[2] < a or x[1] > b)]
        trial = [x for x in inside if x not in near] + [(r["owner"], min([a, *(x[1] for x in near)]), max([b, *(x[2] for x in near)]), (b - a) * r["graph"] + sum(x[3] for x in near))]
        cost = sum(y - x + header for _, x, y, _ in trial)
        why = "passage too long" if any(y - x > excerpt for _, x, y, _ in trial) else "owner has enough" if any(sum(t[0] == o for t in trial) > per_owner for o, *_ in trial) else "does not fit" if cost > most_bytes else "graph has its share" if sum(t[3] for t in trial) > most_bytes / 2 else None
        if why is None:
            inside = trial
            out[r["key"]] = (1 + sum(v[0] is not None for v in out.values()), "child" if child else None)
            covered |= set() if child else set(r["terms"])
        elif not child and r["child_start"] is not None:
            queue.append((r, True))
        else:
            out[r["key"]] = (None, why)
    return out


def test_packing_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for request in range(6):
        for key in range(30):
            a, n, terms = int(rng.integers(0, 2500)), int(rng.integers(50, 900)), [f"t{j}" for j in rng.choice(6, rng.integers(0, 4), False)]
            child = rng.random() < 0.5
            rows.append({
                "request": request, "key": key, "owner": int(rng.integers(0, 4)), "start": a, "end": a + n, "score": 1 / (60 + int(rng.integers(0, 9))), "terms": terms, "weights": [100 + int(t[1]) * 10 for t in terms], "local": int(rng.integers(0, 60)),
                "density": 0.5, "affinity": float(rng.integers(-1, 5)) / 4 if request % 2 and rng.random() < 0.7 else None, "seed": bool(rng.random() < 0.3), "clipped": bool(rng.random() < 0.3), "graph": bool(rng.random() < 0.3),
                "child_start": float(a) if child else None, "child_end": float(a + n // 3) if child else None,
            })
    kinds = "request int, key int, owner int, start long, end long, score double, terms array<string>, weights array<long>, local long, density double, affinity double, seed boolean, clipped boolean, graph boolean, child_start double, child_end double"
    df = spark.createDataFrame([tuple(r[k.split()[0]] for k in kinds.split(", ")) for r in rows], kinds)
    for aware, per_owner in ((True, 4), (False, 2)):
        got = {(r["request"], r["key"]): (r["position"], r["reason"]) for r in context.pack(df, 3000, 750, 1200, source_aware=aware).collect()}
        want = {(n, k): v for n in range(6) for k, v in packed_by_hand([r for r in rows if r["request"] == n], 3000, 1200, per_owner).items()}
        assert got == want and {"contained", "child", "does not fit", None} <= {v[1] for v in want.values()}


def test_facility_location_is_greedy(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [-1.0, 0.0]]
    df = spark.createDataFrame([(1, i, 1.0, x) for i, x in enumerate(v)], "request int, key int, weight double, vector array<double>")
    got = [r["key"] for r in context.facility_location(df, 2, exchange=False).orderBy("position").collect()]
    sim = lambda a, b: max(0.0, float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))
    best = max(itertools.combinations(range(5), 2), key=lambda s: sum(max(sim(x, v[i]) for i in s) for x in v))
    gain = lambda s: sum(max(sim(x, v[i]) for i in s) for x in v)
    assert gain(got) >= (1 - 1 / np.e) * gain(best)
    after = [r["key"] for r in context.facility_location(df, 2).collect()]
    assert gain(after) >= gain(got) - 1e-9


def by_hand(rows: list[tuple], k: int, per_region: int = 2) -> list:
    """Keys that complementary chooses of (key, region, strength, {term: weight}) of one request."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))[: context.MOST_PACKETS]
    out: list[tuple] = []
    for r in rows:
        if r[2] > 0 and len(out) < k and sum(x[1] == r[1] for x in out) < per_region:
            out.append(r)
    while len(out) < k:
        had = {t for r in out for t in r[3]}
        gain, _, best = max(((sum(w for t, w in r[3].items() if t not in had), -r[0], r) for r in rows if r not in out), key=lambda x: x[:2], default=(0, 0, None))
        if gain <= 0:
            break
        out.append(best)
    return [r[0] for r in out]


def test_complementary_equals_brute_force(spark):
    rows = [(q, i, i % 3, (i % 4 == 0) * (i % 5) / 5.0, sorted({f"t{(i * i + j * q) % 23}" for j in range(i % 6)})) for q in (1, 2) for i in range(30)]
    df = spark.createDataFrame([(q, i, g, s, t, [int(x[1:]) + 1 for x in t]) for q, i, g, s, t in rows], "request int, key int, region int, strength double, terms array<string>, weights array<long>")
    got = context.complementary(df, 9).orderBy("request", "position").collect()
    for q in (1, 2):
        mine = [(i, g, s, {x: int(x[1:]) + 1 for x in t}) for p, i, g, s, t in rows if p == q]
        assert [r["key"] for r in got if r["request"] == q] == by_hand(mine, 9)
    assert context.complementary(df.limit(0), 9).count() == 0


def test_context_queries_read_whole_tables(spark, tmp_path):
    """Documents of any id and terms from anywhere in a text count; similarity is that of whole vectors."""
    texts = [(i, "same words " * 40 + f"tail{i % 11} {'x' * (i % 7 + 1)}") for i in range(10, 3000, 30)] + [(5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["complementary_passages"](spark, str(tmp_path)).filter("request = 0").orderBy("position").collect()
    want = by_hand([(i, i % 6, i % 97 / 97.0 if i % 4 == 0 else 0.0, {w: len(w) for w in t.split()}) for i, t in texts if t and i % 10 == 0], 8)
    assert [r["key"] for r in got] == want and max(want) >= 400
    vectors = [(i, 1, [1.0] * 8 + [float(i % 3 == j) * 9 for j in range(3)]) for i in range(9)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["key"] for r in catalogue.QUERIES["facility_location"](spark, str(tmp_path)).filter("position <= 3").collect()}
    assert {i % 3 for i in got} == {0, 1, 2}


def test_handed_over_and_links_found_read_whole_tables(spark, tmp_path):
    """Spans of any owner and line count, and links anywhere in a text."""
    lines = [(o, o, n, 1, 10.0, 0.05) for o in (5, 25, 290) for n in (1, 2, 5)]
    lines = [(o, p + 40 * n, n, s, q, d) for o, p, n, s, q, d in lines]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["owner"], r["start"]) for r in catalogue.QUERIES["handed_over"](spark, str(tmp_path)).collect()}
    assert got == {(o // 32, p * 13 % 3000) for o, p, *_ in lines}
    spark.createDataFrame([(7, "plain " * 50 + "[[far|away]] end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["links_found"](spark, str(tmp_path)).collect()
    assert [r["label"] for r in found if r["target"] == "far"] == ["away"] and len(found) == 3


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(1, 20)), min_size=1, max_size=25))
@settings(max_examples=8, deadline=None)
def test_intervals_equal_brute_force(spark, spans):
    rows = [(i, k, a, a + n) for i, (k, a, n) in enumerate(spans)]
    df = spark.createDataFrame(rows, "id int, owner int, start long, end long")
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in rows for y in rows if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    got = intervals.overlap_join(df, df, "owner", 7).select("a_id", "b_id", "overlap").collect()
    assert sorted(map(tuple, got)) == want
    covered = {(k, i) for _, k, a, b in rows for i in range(a, b)}
    merged = intervals.merge_overlapping(df, ["owner"]).collect()
    assert {(r["owner"], i) for r in merged for i in range(r["start"], r["end"])} == covered and sum(r["end"] - r["start"] for r in merged) == len(covered)


def test_walk_respects_caps(spark):
    edges = [(f"s>{i}", "s", "uses", f"n{i:02d}") for i in range(40)] + [(f"n{i:02d}>m{j}", f"n{i:02d}", "uses", f"m{j}") for i in range(40) for j in range(3)]
    a = spark.createDataFrame(edges, "id string, subject_id string, predicate string, object_id string")
    seeds = spark.createDataFrame([("s", 1), ("n05", 2), ("gone", 3)], "id string, rank int")
    rows = graph.walk(graph.adjacency(a), seeds).collect()
    by = {s: [r for r in rows if r["seed"] == s] for s in ("s", "n05")}
    assert len(by["s"]) == 16 and all(r["hop"] == 1 for r in by["s"]) and {r["hop"] for r in by["n05"]} == {1, 2} and len(by["n05"]) <= 16
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and all(r["path"][-1] == r["id"] and len(r["path"]) == r["hop"] for r in rows)
    with pytest.raises(ValueError):
        graph.walk(graph.adjacency(a), seeds, depth=3)


def test_cycles_reach_and_chains_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    for n, m in ((12, 14), (25, 30), (40, 38), (5, 0)):
        edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))} | ({(0, 1), (1, 2), (2, 0), (3, 3)} if n > 12 else set())
        df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a int, b int")
        far = {a: {b for x, b in edges if x == a} for a in range(n)}
        for _ in range(n):
            far = {a: v | {c for b in v for c in far[b]} for a, v in far.items()}
        assert {r["id"] for r in graph.cycle_members(df).collect()} == {a for a in far if a in far[a]}
        seeds = {0: 3, 1: 1, 4: 2}
        got = {r["id"]: r["v"] for r in graph.reach(df.na.drop(), spark.createDataFrame([*seeds.items(), (0, 1)], "id int, v int"), "v").collect()}
        want = {x: max(v for s, v in seeds.items() if s == x or x in far[s]) for x in range(n) if any(s == x or x in far[s] for s in seeds)}
        assert got == want


def test_rate_window_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], int(t), float(i % 5)) for i, t in enumerate(rng.integers(0, 400, 120))]
    df = spark.createDataFrame(rows, "id int, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["requests"], r["amount"]) for r in ledger.rate_window(df, "k", "ts", "v").collect()}
    assert got == {i: (sum(k == y and t - 60 < u <= t for _, y, u, _ in rows), sum(w for _, y, u, w in rows if k == y and t - 60 < u <= t)) for i, k, t, _ in rows}


def test_topological_order(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a")], "a string, b string")
    assert graph.topological(edges, spark.createDataFrame([(x,) for x in "dcba"], "id string")) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        graph.topological(edges.union(spark.createDataFrame([("a", "c")], edges.schema)), spark.createDataFrame([(x,) for x in "abc"], "id string"))


def test_decisions(spark):
    records = spark.createDataFrame([("a", "accepted", None), ("m", "superseded", "o"), ("o", "active", None), ("x", "active", None)], "id string, status string, superseded_by string")
    d = spark.createDataFrame([("1", "accept", ["a"], []), ("2", "reject", ["a"], []), ("3", "merge", ["m"], ["o"]), ("4", "merge", ["x"], ["o"]), ("5", "split", ["m"], ["o", "gone"])], "id string, action string, inputs array<string>, outputs array<string>")
    got = {r["id"]: (r["eligibility"], r["reasons"]) for r in eligibility.apply_decisions(d, records).collect()}
    assert got == {"1": ("current", ""), "2": ("invalid", "not rejected"), "3": ("current", ""), "4": ("invalid", "not merged"), "5": ("invalid", "missing")}


def test_lifecycle(spark):
    rows = [("revision", "active", True, True), ("revision", "active", False, True), ("assertion", "proposed", False, False), ("entity", "superseded", None, None), ("page", "reviewed", None, None)]
    got = spark.createDataFrame(rows, "kind string, status string, withdrawn boolean, older boolean").select(eligibility.lifecycle()).collect()
    assert [r[0] for r in got] == ["withdrawn", "historical", "unsupported", "historical", "current"]


def test_ledger_rules(spark):
    e = spark.createDataFrame([(1, 1, "planned"), (1, 2, "running"), (1, 3, "completed"), (1, 4, "running"), (2, 1, "running"), (3, 1, "planned"), (3, 2, "planned")], "run int, seq int, state string")
    got = sorted((r["run"], r["seq"], r["reason"]) for r in ledger.violations(e, "run", ["seq"], "state", ledger.RUN_STATES, "planned").collect())
    assert got == [(1, 4, "not allowed"), (2, 1, "no genesis"), (3, 2, "second genesis")]
    high = ledger.clock_violations(spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 6)], "k int, seq int, ts int"), "k", "seq", "ts").collect()
    assert [r["seq"] for r in high] == [2]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.publish(df, str(tmp_path / "g"), 1)
    store.publish(df.filter("id = 2"), str(tmp_path / "g"), 2)
    g, rows = store.published(spark, str(tmp_path / "g"))
    assert g == 2 and [tuple(r) for r in rows.select("id", "v").collect()] == [(2, "b")]
    assert store.differences(df, df).count() == 0 and store.differences(df, df.union(df)).count() == 2
    assert store.written(df.limit(0), "none").count() == 0


def test_vault_and_manifest(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("---\nid: 1\n---\nbody é")
    (root / "sub/b.md").write_bytes(b"\xff\xfe")
    (root / "c.txt").write_text("text")
    rows = {r["path"]: r["text"] for r in vault.notes(spark, str(root)).collect()}
    assert rows == {"a.md": "---\nid: 1\n---\nbody é", "sub/b.md": None}
    with pytest.raises(ValueError):
        vault.notes(spark, str(root), most_files=1)
    assert {r["path"]: r["state"] for r in vault.parsed(vault.notes(spark, str(root))).collect()} == {"a.md": "record", "sub/b.md": "plain"}
    assert {r["path"] for r in vault.captured_files(spark, str(root)).collect()} == {"a.md", "sub/b.md", "c.txt"}
    lines = [{"type": "header", "version": "1"}, *[{"type": "item", "ordinal": i, "path": f"p/{i}.md", "original_hash": "h"} for i in range(5)], {"type": "footer", "items": 5}]
    m = tmp_path / "m.jsonl"
    m.write_text("\n".join(map(json.dumps, lines)))
    rows = vault.manifest(spark, str(m))
    assert vault.manifest_errors(rows).count() == 0 and [r["ordinal"] for r in vault.manifest_page(rows, 1, 2).orderBy("ordinal").collect()] == [2, 3]
    bad = rows.filter("ordinal is null or ordinal <> 3").union(rows.filter("type = 'header'"))
    assert {r[0] for r in vault.manifest_errors(bad).collect()} == {"header", "items", "ordinals"}
    assert vault.body_hash(rows).first() == vault.body_hash(rows.repartition(3)).first() != vault.body_hash(bad).first()


def test_journal(spark, tmp_path):
    import hashlib

    frame = lambda run, n, payload, ok=True: {"run_id": run, "sequence": n, "payload": payload, "checksum": hashlib.sha256(payload.encode()).hexdigest() if ok else "x"}
    p = tmp_path / "j.json"
    p.write_text("\n".join(json.dumps(f) for f in [frame("a", 1, "x"), frame("a", 2, "y", False), frame("b", 1, "x"), frame("b", 2, "y", False), frame("b", 3, "z"), frame("c", 1, "x"), frame("c", 3, "x")]))
    got = sorted((r["run_id"], r["sequence"], r["reason"]) for r in vault.journal_errors(vault.journal(spark, str(p))).collect())
    assert got == [("b", 2, "checksum"), ("c", 3, "gap")]


def test_stream_replay_is_idempotent(spark, tmp_path):
    from tessera.plans.q_stream import drained

    src = tmp_path / "in"
    rows = [("r", 1, "planned"), ("r", 2, "running"), ("r", 2, "running"), ("r", 3, "planned"), ("s", 1, "running")]
    df = spark.createDataFrame(rows, "run_id string, sequence long, state string")
    df.coalesce(1).write.json(str(src))
    out = drained(streams.replay(spark.readStream.schema(df.schema).json(str(src))), "test").collect()
    assert {(r["run_id"], r["state"], r["last"], r["refused"]) for r in out} == {("r", "running", 3, 1), ("s", "", 1, 1)}
    assert json.loads(streams.progress(df.limit(1), "started").first()[0]) == {"type": "started", "run_id": "r", "sequence": 1, "state": "planned"}
    assert streams.envelope(True, {"b": 1, "a": "é"}) == '{"data":{"a":"é","b":1},"ok":true}'
    put = streams.publisher(str(tmp_path / "out"), "sequence")
    put(df, 0)
    put(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_fallback(spark):
    rows = spark.createDataFrame([("a",)], "path string")

    def fails(reason):
        def run():
            raise access.Unavailable(reason)

        return run

    assert [tuple(r) for r in access.search_or_fall_back(lambda: rows, fails("offline")).collect()] == [("a", "semantic", None)]
    assert [tuple(r) for r in access.search_or_fall_back(fails("untrusted"), lambda: rows).collect()] == [("a", "lexical", "untrusted")]
    with pytest.raises(access.Unavailable):
        access.search_or_fall_back(fails("budget"), lambda: rows)


def test_research_packets_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for run in range(10):
        for rank in range(40):
            a, n = int(rng.integers(0, 300)), int(rng.integers(5, 120))
            rows.append((run, int(rng.integers(0, 2)), a, a + n, bool(rng.random() < 0.2), rank // 2))
    kinds = "run int, owner int, start long, end long, explicit boolean, rank int"
    got = access.research_packet(spark.createDataFrame(rows + rows[:9], kinds), 8, 500).collect()
    for run in range(10):
        mine = {}
        for _, o, a, b, x, k in [r for r in rows if r[0] == run]:
            mine[o, a, b] = min(mine.get((o, a, b), (True, 99)), (not x, k))
        packet: list[tuple] = []
        covers = lambda p, q: p[0] == q[0] and p[1] <= q[1] and p[2] >= q[2]
        for p, (late, _) in sorted(mine.items(), key=lambda m: (m[1], m[0])):
            if late and any(covers(q, p) or (not l and covers(p, q)) for q, l in packet):
                continue
            out = [x for x in packet if x[1] and (covers(p, x[0]) or (not late and covers(x[0], p)))]
            rest = [x for x in packet if x not in out]
            if out and sum(q[2] - q[1] for q, _ in rest) + p[2] - p[1] <= 500:
                at = packet.index(out[0])
                packet = [x for x in packet[:at] if x not in out] + [(p, late)] + [x for x in packet[at:] if x not in out]
            elif len(packet) < 8 and sum(q[2] - q[1] for q, _ in packet) + p[2] - p[1] <= 500:
                packet.append((p, late))
        found = sorted((int(r["passage"][1:]), r["owner"], r["start"], r["end"]) for r in got if r["run"] == run)
        assert found == [(i + 1, *p) for i, (p, _) in enumerate(packet)]


def test_parents_take_the_place_of_their_children(spark):
    rows = [(1, "a", 1, "P", 10, 50), (1, "b", 2, "Q", 10, 200), (1, "c", 3, "P", 10, 50), (1, "d", 4, None, 30, None), (1, "e", 5, "R", 5, 20), (2, "z", 1, "P", 10, 50)]
    df = spark.createDataFrame(rows, "request int, key string, position long, parent string, bytes long, parent_bytes long")
    got = sorted(tuple(r) for r in context.expand_parents(df, 110).collect())
    assert got == [(1, "a", 1, True), (1, "b", 2, False), (1, "d", 4, False), (1, "e", 5, True), (2, "z", 1, True)]


def test_transient_tables(spark):
    notes = spark.createDataFrame([("a.md", "---\nid: r1\nkind: page\ntags: [x, y]\nmeta:\n  by: me\n---\n# Top\nsee [[b|B]]\n", "h1"), ("b.md", "## Plain title ##\ntext", "h2"), ("c.md", "---\nid: 1\nid: 2\n---\nz", "h3")], "path string, text string, hash string")
    t = vault.transient(notes)
    got = {r["path"]: (r["record_id"], r["kind"], r["title"], r["eligibility"], r["body"]) for r in t["documents"].collect()}
    assert got == {"a.md": ("r1", "page", "Top", "current", "# Top\nsee [[b|B]]\n"), "b.md": (None, None, "Plain title", "current", "## Plain title ##\ntext"), "c.md": ("2", None, "", "invalid", "z")}
    assert [(r["from_path"], r["target"], r["label"]) for r in t["links"].collect()] == [("a.md", "b", "B")]
    assert sorted((r["path"], r["headings"]) for r in t["headings"].collect()) == [("a.md", ["Top"]), ("b.md", ["Plain title"])]


def test_guarded_writes(spark):
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    pages = spark.createDataFrame([("a", "one"), ("b", "two")], "path string, text string")
    kinds = "path string, expected string, text string"
    good = spark.createDataFrame([("a", h("one"), "one!"), ("b", "whatever", "two"), ("c", None, "new")], kinds)
    assert {tuple(r) for r in store.put_pages(pages, good, 16).collect()} == {("a", "written"), ("b", "unchanged"), ("c", "written")}
    bad = spark.createDataFrame([("a", h("one"), "x"), ("b", None, "y"), ("d", None, "z"), ("d", None, "zz")], kinds)
    assert {tuple(r) for r in store.put_pages(pages, bad).collect()} == {("a", "held"), ("b", "conflict"), ("d", "conflict")}
    with pytest.raises(ValueError):
        store.put_pages(pages, good, 2)


def test_replies_and_bundles(spark):
    shown = spark.createDataFrame([(1, "k", "aé日b"), (1, "n", None)], "request int, key string, text string")
    replies = spark.createDataFrame([(1, "k", 1, 3), (1, "k", 2, 3), (1, "k", 0, 7), (1, "k", 0, 8), (1, "x", 0, 1), (1, "n", 0, 1), (1, "k", 3, 6), (1, "k", 3, 6)], "request int, key string, start long, end long")
    got = {(r["key"], r["start"], r["end"]): r["reason"] for r in context.reply_errors(replies, shown).collect()}
    assert got == {("k", 2, 3): "inside a character", ("k", 0, 8): "outside", ("x", 0, 1): "not shown", ("n", 0, 1): "outside", ("k", 3, 6): "twice"}
    passages = spark.createDataFrame([(a, i, True, False, True, "p", i, i) for a in "xy" for i in range(3)], "assertion_id string, passage_id int, supports boolean, contradicts boolean, current boolean, path string, start int, support_group int")
    paths = spark.createDataFrame([("x", True), ("y", False)], "path_id string, connected boolean")
    assert {r["assertion_id"] for r in context.bundles(passages, paths).collect()} == {"x"} and context.bundles(passages).count() == 4


@given(st.text(alphabet="ab #*_`[]()!<>-\n1.é|", max_size=80))
@settings(max_examples=300, deadline=None)
def test_readable_markdown_runs_are_their_bytes(t):
    runs = text.readable_markdown(t)
    raw = t.encode()
    assert all(raw[a:b].decode() == r and r.strip() == r and r for r, a, b in runs)
    assert all(x[2] <= y[1] for x, y in itertools.pairwise(runs))


def test_mappings():
    lines = ["a: 1", "# no", "list:", "  - x", "  - 'y z'", "flow: [p, \"q\"]", "deep:", "  in: ner", "  more:", "    - k", "same:", "- v", "quoted: 'a: b'"]
    assert text.mapping(lines) == ([("a", "1"), ("list", '["x", "y z"]'), ("flow", '["p", "q"]'), ("deep", ""), ("deep.in", "ner"), ("deep.more", '["k"]'), ("same", '["v"]'), ("quoted", "a: b")], None)
    assert text.mapping(["a: 1", "a: 2"])[1] == "repeated key" and text.mapping(["- x"])[1] == "not a mapping" and text.mapping(["nothing here"])[1] == "not a mapping" and text.mapping([]) == ([], None)


def test_blocks_of_markdown():
    t = "Title\n=====\n\npara one\nstill\n> quote\n\n````\n```\n# no\n````\n- a\n\n  inside\n- b\n\n    code\n\ttabbed\n\n---\nlast\n---\n"
    found = [(k, t.encode()[a:b].decode()) for k, a, b in text.blocks(t)]
    assert found == [("heading", "Title\n=====\n"), ("prose", "para one\nstill\n> quote\n"), ("code", "````\n```\n# no\n````\n"), ("list", "- a\n\n  inside\n- b\n\n    code\n\ttabbed\n"), ("heading", "last\n---\n")]
    t = "text\n\n    code\n    more\n\npara\n    cont\n1. x\n2) y\n~~~\ncode\n~~~~\nafter\n"
    assert [k for k, _, _ in text.blocks(t)] == ["prose", "code", "prose", "list", "code", "prose"]


def nominated_by_hand(anchors, nodes, edges, depth, spans, span_bytes, text_bytes):
    """The same by lists: (from, to) -> reason or None."""
    held, out, level = [], [], []
    for a in anchors:
        s = nodes[a]
        if s in held or (s[1] - s[0] <= span_bytes and len(held) < spans and sum(y - x for x, y in held) + s[1] - s[0] <= text_bytes):
            held += [s] * (s not in held)
            level.append(a)
    known = set(anchors)
    for _ in range(depth):
        nxt = []
        for n in level:
            for _, to, s in sorted((o, t, s) for f, t, o, s in edges if f == n):
                new = [x for x in dict.fromkeys([s, nodes[to]]) if x not in held]
                used = sum(y - x for x, y in held)
                why = "span" if any(y - x > span_bytes for x, y in new) else "candidates" if len(held) + len(new) > spans else "text" if used + sum(y - x for x, y in new) > text_bytes else None
                out.append((n, to, why))
                if not why:
                    held += new
                    if to not in known:
                        known.add(to)
                        nxt.append(to)
        level = nxt
    return out


def test_nomination_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    want, anchors, nodes, edges = [], [], [], []
    for source in range(8):
        place = {f"n{i}": (a := int(rng.integers(0, 900)), a + int(rng.integers(10, 300))) for i in range(12)}
        links = [(f"n{rng.integers(0, 12)}", f"n{rng.integers(0, 12)}", o, (a := int(rng.integers(2000, 3000)), a + int(rng.integers(5, 120)))) for o in range(30)]
        begin = ["n3", "n0"]
        anchors += [(source, n, i) for i, n in enumerate(begin)]
        nodes += [(source, n, *s) for n, s in place.items()]
        edges += [(source, f, t, o, *s) for f, t, o, s in links]
        want += [(source, f, t, not w, w) for f, t, w in nominated_by_hand(begin, place, links, 3, 14, 280, 1500)]
    got = access.nominate(
        spark.createDataFrame(anchors, "source int, node string, rank int"), spark.createDataFrame(nodes, "source int, node string, start long, end long"),
        spark.createDataFrame(edges, "source int, node_from string, node_to string, ordinal long, start long, end long"), 3, 14, 280, 1500,
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and {"span", "candidates", "text", None} == {w[4] for w in want}


def test_hand_over_and_metrics(spark):
    p = spark.createDataFrame([(1, "o", 0, 100, False, 1), (2, "o", 10, 20, True, 9), (3, "o", 0, 100, True, 5), (4, "q", 0, 60, False, 2)], "id int, owner string, start long, end long, explicit boolean, rank int")
    assert [(r["passage"], r["owner"]) for r in catalog.hand_over(p).orderBy("passage").collect()] == [("p1", "o"), ("p2", "q")]
    assert catalog.hand_over(p, most_bytes=100).count() == 1
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, doc string, rank int")
    m = catalog.recall_and_ndcg(ranked, spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z"), ("n", "a")], "query string, doc string"), 3)
    got = {r["query"]: (round(r["recall"], 4), round(r["ndcg"], 4)) for r in m.collect()}
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert got == {"q": (round(2 / 3, 4), round(1.5 / ideal, 4)), "n": (0.0, 0.0)}


def test_folding_equals_decomposition(spark):
    import unicodedata

    s = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.category(chr(c)) in ("Ll", "Lu"))
    got = spark.createDataFrame([(s,)], "t string").select(model.tokens("t")).first()[0]
    assert "".join(got)[:60] == text.fold(s)[:60]


@given(TEXTS, st.integers(8, 40))
@settings(max_examples=100, deadline=None)
def test_packet_windows_are_disjoint_and_bounded(t, capacity):
    raw, at = t.encode(), 0
    for _, a, b, _ in text.packet_windows(t, capacity, 1000):
        assert a == at and 0 < b - a <= capacity and not (raw[b - 1 : b] == b"\r" and raw[b : b + 1] == b"\n" and b - a > 1)
        at = b
    assert at == len(raw) and len(text.packet_windows(t, capacity, 2)) <= 2


def test_citations_rewrites_and_source_map():
    page = 'x\n<!-- citations\n{"source_id":"s","revision":"r","start":1,"end":4}\n-->\n'
    assert text.page_citations(page) == [("s", "r", 1, 4)] and text.page_citations(page + page) == [] and text.page_citations("<!-- citations\n{}\n-->") == []
    assert text.rewrite_links("[[A]] \\[[A]] `[[A]]` [A](A)", "A", "é/B") == "[[é/B]] \\[[A]] `[[A]]` [A](é/B)" and text.rewrite_links(None, "a", "b") is None
    t = "<p>é one</p><b>two</b>"
    assert text.original_span(text.readable(t), 7, 10) == (16, 19) and t.encode()[16:19] == b"two" and text.original_span(text.readable(t), 4, 9) is None


def test_groups_are_folded_as_rows_and_results_go_on_in_pieces(spark):
    """Each key's rows reach the fold together, in lists of any number; results of a wide row go on in bounded pieces (F1, F5, F23)."""
    rows = [(k, v, None if v % 3 else "x") for k in range(700) for v in range(k % 5 + 1)]
    df = spark.createDataFrame(rows, "k long, v long, s string").repartition(3)
    got = text.folded(df, "k", lambda g: [(sum(v for v, _ in g), len(g)), (-1, sum(s is None for _, s in g))], "a long, n long").collect()
    want = [x for k in range(700) for m in [range(k % 5 + 1)] for x in [(k, sum(m), len(m)), (k, -1, sum(v % 3 > 0 for v in m))]]
    assert sorted(map(tuple, got)) == sorted(want)
    wide = spark.createDataFrame([(1, "ab " * 30_000), (2, None), (3, "c")], "i long, t string").coalesce(1)
    sizes = text.mapped(wide, lambda t: [(n,) for n in range(len((t or "").split()))], ("t",), "n long", ("i", "t"))
    assert sizes.groupBy("i").agg(F.count("*"), F.max(F.length("t"))).orderBy("i").collect() == [(1, 30_000, 90_000), (3, 1, 1)]  # 2.7 GB as one piece
