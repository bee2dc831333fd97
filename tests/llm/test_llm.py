"""Each operator against brute force on a small table with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, embedding_join, fingerprints, kernel, language_id, mixing, ngram_join, sentencepiece_scan, sharding, suffix_dedup, url_filter
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names the operators use themselves.
CLASH = "component_id long, tk string, row string, spans int, score string, shard int, size int, topic string"


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["an", "he", "in", "to", "é", "ßu", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = prose(rng, 300)
    out: list[tuple] = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:150], "CHANGED", *base[151:]])), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO")]
    out += [(9, "x" * 700), (10, "日本語のテキスト" * 60), (11, "123 456"), (12, "a ▁b▁ c"), (12, "a ▁b▁ c"), (None, "no id here at all"), (None, None)]
    passage = " ".join(prose(rng, 60))
    for i in range(20, 50):
        own = prose(rng, rng.randint(3, 200))
        if i % 3 == 0:
            own.insert(rng.randint(0, len(own)), passage)
        if i % 7 == 0:
            own = base[: 40 + i] + own[:2]
        out.append((i, " ".join(own)))
    out.append((60, " ".join(prose(rng, 9000))))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "fr"][n % 3], f"s{n % 4}" if n % 5 else None, len(t or "")) + (None,) * 8 for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_suffix_dedup_equals_brute_force(docs, texts):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    want = []
    for (ident, _), x in zip(texts, raw, strict=True):
        cover = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(x)) if cover[i] and (i == 0 or not cover[i - 1]))
        want.append((ident, len(x), sum(cover), spans, hashlib.sha256(bytes(b for b, m in zip(x, cover, strict=True) if not m)).hexdigest()))
    rows = suffix_dedup.cut_rows(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut", "emptied").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    assert sorted((r["doc_id"] or -1, r["cut"] or "") for r in rows if not r["n_removed"]) == sorted((w[0] or -1, t or "") for w, (_, t) in zip(want, texts, strict=True) if not w[2])
    assert all(r["emptied"] == bool(r["n_removed"] and not r["cut"].strip()) for r in rows) and any(r["emptied"] for r in rows)


def test_suffix_dedup_splits_hot_anchors_and_shards_alike(docs, monkeypatch):
    whole = sorted(map(str, suffix_dedup.cut_rows(docs, texts=False).select("row.doc_id", "n_removed", "kept_sha256").collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    assert whole == sorted(map(str, suffix_dedup.cut_rows(docs, texts=False).select("row.doc_id", "n_removed", "kept_sha256").collect()))


def test_pieces_and_runs():
    data, offsets = np.arange(1000) % 251, np.array([0, 0, 10, 700, 705, 1000])
    seen = {i: set() for i in range(5)}
    for text, base, part, ends in kernel.pieces(data, offsets, 100, 9):
        assert len(part) <= 109 and ends[-1] == len(part)
        for n, (i, b) in enumerate(zip(text.tolist(), base.tolist(), strict=True)):
            got = part[ends[n] : ends[n + 1]]
            assert (got == data[offsets[i] + b : offsets[i] + b + len(got)]).all()
            seen[i] |= {b + x for x in range(len(got) - 9)}
    assert all(seen[i] == set(range(n - 9)) for i, n in enumerate(np.diff(offsets).tolist()))
    at = np.array([0, 5, 99, 100, 101, 350, 350])
    assert kernel.runs(at, 100) == [(0, 3), (3, 5), (5, 7)] and kernel.runs(at[:0], 9) == []


def test_merged_order_is_the_sorted_one():
    rng = np.random.default_rng(3)
    rows, group = rng.integers(0, 3, (500, 12)).astype(np.uint8), np.sort(rng.integers(0, 5, 500))
    order = suffix_dedup.merged_order(rows, group, 64)
    want = sorted(range(500), key=lambda i: (group[i], rows[i].tobytes()))
    assert [(group[i], rows[i].tobytes()) for i in order] == [(group[i], rows[i].tobytes()) for i in want]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x", "http://example.com/en/70", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://b.net/de/1", "http://a.example.net/de/88?q", "http://example.net/de", "http://org/es/#", "x://y.org?/es/", "http://é.org/es/ü"]


def test_url_filter_equals_sql(spark):
    rows = [(i, u, i) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule int")
    db = duckdb.connect()
    db.execute("create table pages(page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    assert sorted(map(tuple, url_filter.filter_urls(df).collect())) == sorted(db.execute(url_filter.ORACLE).fetchall())
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_trie_prefers_longest():
    t = url_filter.Trie([url_filter.Rule("com", "/a/b", "allow"), url_filter.Rule("com", "/a/", "block"), url_filter.Rule("x.com", "", "allow")])
    assert t.match("y.com", "/a/bc").path == "/a/b" and t.match("y.com", "/a/c").path == "/a/" and t.match("z.x.com", "/a/b").host == "x.com" and t.match("com", "/") is None


def naive_bits(texts: list[bytes], text: bytes, order: int = language_id.ORDER) -> float:
    blob = b"\0".join(texts)
    seen = [Counter() for _ in range(order + 1)]
    kinds = [Counter() for _ in range(order + 1)]
    for i in range(order, len(blob)):
        for k in range(order + 1):
            c = blob[i - k : i]
            seen[k][c + blob[i : i + 1]] += 1
    total = [Counter() for _ in range(order + 1)]
    for k in range(order + 1):
        for key, n in seen[k].items():
            total[k][key[:-1]] += n
            kinds[k][key[:-1]] += 1
    padded, bits = b"\0" * order + text, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            c = padded[i - k : i]
            n, q = total[k][c], kinds[k][c]
            if not n:
                continue
            hit = seen[k][c + padded[i : i + 1]]
            if hit:
                bits -= np.log2(hit / (n + q))
                break
            bits -= np.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_language_code_lengths_are_exact():
    rng = random.Random(5)
    texts = {"a": [" ".join(prose(rng, 40)).encode() for _ in range(5)], "b": ["der die das und".encode() * 9, b"ein zwei"]}
    model = language_id.train(texts)
    probe = ["an he in", "und der", "", "日本", "q", "x" * 50]
    bits = language_id.score(model, *kernel.flat(pa.array(probe)))
    for i, p in enumerate(probe):
        for j, k in enumerate(model.languages):
            assert bits[i, j] == pytest.approx(naive_bits(texts[k], p.encode()), rel=1e-4, abs=1e-3)


def test_language_id_on_held_out_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.op3_language_id(spark, SF).join(df, "doc_id").filter("held_out")
    right, n = found.agg(F.sum(F.expr("cast(lang = lang_pred as int)")), F.count("*")).first()
    assert n > 50 and right / n > 0.97


def test_language_id_edges(docs, none):
    out = language_id.identify(docs, language_id.learn(docs))
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()}
    assert {(4, "und", 0.0), (5, "und", 0.0), (11, "und", 0.0), (None, "und", 0.0)} <= rows
    assert out.count() == docs.count() and language_id.identify(none, language_id.learn(none)).count() == 0


def test_language_id_of_repeated_rows(spark):
    """However often a row is repeated, the sample that reaches the driver is bounded, and nothing fails."""
    one = spark.range(20_000).select(F.lit(0).cast("long").alias("doc_id"), F.lit("wieder und wieder derselbe satz " * 4).alias("text"), F.lit("de").alias("lang"))
    docs = one.unionByName(spark.createDataFrame([(1, "another sentence altogether", "en")], kind := "doc_id long, text string, lang string"))
    models = language_id.learn(docs, 1 << 12)
    got = language_id.identify(spark.createDataFrame([(1, "derselbe satz", None), (2, "another sentence", None)], kind), models)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "de", 2: "en"}


def test_language_id_learns_every_language(spark):
    """More languages than are trained at a time, and one that has giant texts only; spread over models as in one."""
    rng = random.Random(3)
    rows = []
    for k in range(language_id.MAX_LANGUAGES + 6):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(20)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(4 if k else 3000)), f"l{k:02}") for i in range(12 if k else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.learn(docs, 1 << 14)
    assert {k for m in models for k in m.value.languages} == {r[2] for r in rows}
    found = language_id.identify(docs, models).join(docs, "doc_id").cache()
    assert found.count() == len(rows) and found.filter("lang = lang_pred").count() > 0.95 * len(rows)
    assert found.filter("lang = 'l00' and lang_pred = 'l00'").count() == 4
    few = docs.filter("lang < 'l06'")
    whole, parts = language_id.learn(few), language_id.learn(few, most_bytes=0.7 * (language_id.learn(few)[0].value.cost.nbytes))
    assert len(whole) == 1 < len(parts)
    one, many = ({(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(few, m).collect()} for m in (whole, parts))
    assert one == many


def test_sharding_is_whole_and_near_equal(spark, docs, none):
    placed = sharding.place(docs, 8).collect()
    assert len(placed) == docs.count()
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.place(none, 8).count() == 0
    big = sharding.place(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 8)
    loads = [r["size"] for r in sharding.balance(big).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.03 * sum(loads) / 8


def test_sharding_equals_brute_force(spark, docs, texts):
    """Items of the same sizes packed one by one: the largest share first, each where the dot product with what is left is highest."""
    shards = 3
    texts = [(i, t) for i, t in texts if i != 60]  # no text has a third of all
    placed = sharding.place(docs.filter("doc_id is null or doc_id <> 60"), shards).collect()
    groups: dict = {}
    for _, t in texts:
        raw = (t or "").encode()
        g = groups.setdefault(t or "", [0, 0, 0])
        g[0], g[1], g[2] = g[0] + len(raw) + 1, g[1] + len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")), g[2] + 1
    total = [sum(g[k] for g in groups.values()) for k in range(3)]
    of = {r["text_crc32"]: r["group"] for r in placed}
    split = {t for t, g in groups.items() if max(x / y for x, y in zip(g, total, strict=True)) > 1 / shards}
    heavy = {t for t, g in groups.items() if any(x > max(1, int(y * sharding.HEAVY)) for x, y in zip(g, total, strict=True))}
    assert {zlib.crc32(t.encode()) for t in groups} == set(of)
    items: dict = {}
    for t, g in groups.items():
        if t not in split:
            name = f"h{of[zlib.crc32(t.encode())]}.0" if t in heavy else f"c{of[zlib.crc32(t.encode())] % sharding.CELLS}"
            items[name] = [a + b for a, b in zip(items.get(name, [0, 0, 0]), g, strict=True)]
    got = {}
    for r in placed:
        got.setdefault(r["group"], set()).add(r["shard"])
    whole = [of[zlib.crc32(t.encode())] for t in groups if t not in split]
    assert all(len(got[g]) == 1 for g in whole)
    assert not split
    left, want = [[1 / shards] * 3 for _ in range(shards)], {}
    for name, g in sorted(sorted(items.items()), key=lambda x: -max(a / b for a, b in zip(x[1], total, strict=True))):
        share = [a / b for a, b in zip(g, total, strict=True)]
        best = max(range(shards), key=lambda s: (round(sum(x * y for x, y in zip(left[s], share, strict=True)), 12), -s))
        want[name] = best
        left[best] = [x - y for x, y in zip(left[best], share, strict=True)]
    for t in groups:
        g = of[zlib.crc32(t.encode())]
        assert got[g] == {want[f"h{g}.0" if t in heavy else f"c{g % sharding.CELLS}"]}


def test_sharding_keeps_groups_and_splits_giants(spark):
    df = spark.createDataFrame([(i, "same text" if i % 2 else f"text number {i}") for i in range(2000)], "doc_id long, text string")
    loads = [r["size"] for r in sharding.balance(sharding.place(df, 4)).collect()]
    assert len(loads) == 4 and max(loads) - min(loads) < 0.05 * sum(loads) / 4  # though half of the rows are copies
    few = spark.createDataFrame([(i, f"text {i // 2}") for i in range(1000)], "doc_id long, text string")
    assert sharding.place(few, 4).groupBy("text_crc32").agg(F.countDistinct("shard").alias("k")).filter("k > 1").count() == 0


def test_mixing_equals_sql_and_meets_targets(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as from '{SF}/documents.parquet'")
    got = mixing.op5_mixing(spark, SF)
    cols = ", ".join(got.columns)
    want = db.execute(f"select {cols} from ({mixing.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    cells = mixing.rake(spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "p", 30), ("b", "x", "p", 50), ("b", "y", "p", 10)], "source string, language string, topic string, tokens long"), 30, targets={"source": {"a": 0.5, "b": 0.5}, "language": {"x": 0.3, "y": 0.7}})
    for m, t in (("source", {"a": 0.5, "b": 0.5}), ("language", {"x": 0.3, "y": 0.7})):
        assert {r[m]: pytest.approx(r["w"], abs=1e-6) for r in cells.groupBy(m).agg(F.sum("weight").alias("w")).collect()} == t


def test_mixing_takes_a_topic_column(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "s", i % 3 if i % 5 else None) for i in range(300)], "doc_id long, text string, lang string, source string, kind int")
    out = mixing.mix_sources(docs, topics=F.col("kind"))
    assert {r["topic"] for r in out.select("topic").distinct().collect()} == {"0", "1", "2", "(none)"} and out.count() == 300


def test_mixing_edges(docs, none):
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count() and out.filter("probability is null").count() == 0
    assert mixing.mix_sources(none).count() == 0


def test_embedding_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        if i % 3 and rows and rows[-1][1] is not None:
            v = np.array(rows[-1][1]) + rng.normal(0, 0.03, 16) * (i % 3 - 1)
        else:
            v = rng.normal(0, 1, 16)
        rows.append((i, [float(np.float32(x)) for x in v], i // 50 % 3, 0))
    rows += [(900, None, 1, 0), (901, [0.0] * 16, 1, 0), (902, [float("nan")] * 16, 1, 0), (903, [1.0, None], 1, 0), (904, rows[3][1], None, 0), (905, [], 1, 0), (906, rows[5][1], rows[5][2], 0), (906, rows[5][1], rows[5][2], 0), (907, [1.0, 0.0], 1, 0), (908, [2.0, 0.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id int")
    fine = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, comp = Counter(), {id(r): r[0] for r in rows}
    for _ in range(2):
        changed = True
        while changed:
            changed = False
            links.clear()
            for a in fine:
                for b in fine:
                    if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= 0.98:
                        links[id(a)] += 1
                        if comp[id(b)] < comp[id(a)]:
                            comp[id(a)], changed = comp[id(b)], True
    want = sorted((r[0], links[id(r)], comp[id(r)], r[0] == comp[id(r)]) for r in rows)
    old = embedding_join.BLOCK, embedding_join.LEAF
    try:
        embedding_join.BLOCK, embedding_join.LEAF = 32, 8
        assert sorted(map(tuple, embedding_join.cosine_components(df).collect())) == want
    finally:
        embedding_join.BLOCK, embedding_join.LEAF = old
    assert embedding_join.cosine_components(df.limit(0)).count() == 0


def test_embedding_join_keeps_doubles(spark):
    """A column of doubles is compared as such: beyond the range of floats, and where floats would be equal."""
    rows = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, 0.0], 1), (4, [0.98, float(np.sqrt(1 - 0.98**2))], 1), (5, [0.98 - 1e-12, float(np.sqrt(1 - (0.98 - 1e-12) ** 2))], 1), (6, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.cosine_components(df).collect()}
    cos = lambda a, b: np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))
    want = {i: sum(j != i and cos(np.array(v), np.array(w)) >= 0.98 for j, w, m in rows[2:5] if m == 1) for i, v, _ in rows[2:5]}
    assert got == {1: 1, 2: 1, 6: 0} | want


def shingle_set(text: str | None, k: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num", "den", "cap"), [(3, 9, 10, None), (5, 4, 5, None), (2, 4, 5, 8)])
def test_ngram_join_equals_brute_force(spark, k, num, den, cap, monkeypatch):
    if cap:
        monkeypatch.setattr(ngram_join, "CAP", cap)
        monkeypatch.setattr(ngram_join, "TEXTS", cap)
        monkeypatch.setattr(ngram_join, "SHINGLES", 600)
    rng = random.Random(k)
    base, texts = prose(rng, 120), [None, "", "  ", "one", "ONE", "one two"]
    for i in range(150):
        own = list(base[: rng.choice([10, 30, 120])]) if i % 3 else prose(rng, 40)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = prose(rng, 1)[0]
        texts.append(" ".join(own))
    texts += [texts[-1]] * 3
    sets = [shingle_set(t, k) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(a & b)
                if both and den * both >= num * len(a | b) and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    got = ngram_join.jaccard_components(df, k, num, den).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    again = ngram_join.jaccard_components(df.unionByName(df.filter("doc_id > 100")).withColumn("doc_id", F.expr("nullif(doc_id, 155)")), k, num, den)
    assert {r["n_shingles"] for r in again.filter("doc_id is null").collect()} == {len(sets[155])} and again.count() == len(texts) + len([i for i in range(len(texts)) if i > 100])


def test_points_bound_the_overlap():
    """Points of any lengths: the sum of minima is never less than the overlap, and longer points tell unlike sets apart."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 3, 400, 2000, 5000, 5200, 20_000, 40_000)] + [pool[:5000], np.concatenate([pool[200:5000], pool[9000:9200]])]
    sets = [np.sort(x) for x in sets]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    table = pa.table({"vec": pa.array(ngram_join.vectors(np.concatenate(sets), at), pa.binary())})
    points = ngram_join.Points(table)
    assert points.dims.min() == ngram_join.DIMS and points.dims.max() == 4096 and (points.low.sum(axis=1) == np.diff(at)).all()
    for i in range(len(sets)):
        for j in range(len(sets)):
            x, y = points.of(np.array([i, j]))
            assert np.minimum(x, y).sum() >= len(np.intersect1d(sets[i], sets[j])) and x.sum() == len(sets[i])
    far, low = points.of(np.array([5, 9])), points.low[[5, 9]]
    assert far.min(axis=0).sum() < 0.8 * len(sets[5]) < low.min(axis=0).sum()


def test_ngram_join_links_chains_and_clusters(spark):
    """Sets that each resemble the next and not the first, and many copies of one with small changes: one component each."""
    rng = random.Random(3)
    base, rows = prose(rng, 200), []
    for i in range(30):
        own = [*prose(random.Random(i), 8 * i), *base][:200]
        rows.append((i, " ".join(own)))
    core = prose(rng, 150)
    for i in range(100, 160):
        own = list(core)
        own[i % 150] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    sets = {i: shingle_set(t, 3) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(40):
        for i in sets:
            comp[i] = min(comp[j] for j in sets if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]))
    assert got == comp and {comp[i] for i in range(100, 160)} == {100}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 9), (9, 3), (None, 4)] + [(500, 501 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 9: 3, **{i: 500 for i in range(500, 541)}}


@pytest.fixture(scope="module")
def codec():
    with open(sentencepiece_scan.MODEL, "rb") as f:
        return sentencepiece_scan.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)


def odd_texts() -> list[str]:
    rng = random.Random(4)
    bits = ["a", "b", "th", "e", "in", " ", "  ", "é", "日", "\n", "😀", "aaaa", "1", "--", "=", "\x00", "\u0301"]
    return ["the quick brown  fox\n naïve 日本", " lead", "x", "\t\r\n", "trail ", "a" * 700, "=-" * 300, " " * 40, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 150))) for _ in range(40))]


def test_sentencepiece_equals_library(spark, codec, library):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + odd_texts()
    ids, counts = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)
    assert codec.decode(ids, counts) == texts


@pytest.mark.parametrize("chunk", [1, 2, 5, 17, 64])
def test_sentencepiece_scan_equals_library(codec, library, chunk):
    for text in odd_texts():
        part = codec.escaped(text)[0]
        cut = [(part[i - min(i, codec.longest) : i + chunk + codec.longest - 1], min(i, codec.longest), min(chunk, len(part) - i)) for i in range(0, len(part), chunk)]
        states = sentencepiece_scan.boundaries([codec.transfer(*c) for c in cut])
        found = [codec.path(*c, a, b) for c, a, b in zip(cut, states[:-1], states[1:], strict=True)]
        assert np.concatenate(found).tolist() == library.encode(text)


@pytest.mark.parametrize("chunk", [16, 37, 500])
def test_sentencepiece_chunks_equal_whole(spark, codec, docs, none, chunk):
    small = docs.filter("doc_id is null or doc_id < 40")
    rows = sentencepiece_scan.encode(small, chunk=chunk).select("row.text", "ids", "score", "decoded").collect()
    assert len(rows) == small.count()
    for r in rows:
        ids, _ = codec.encode([r["text"] or ""])
        assert r["decoded"] == r["text"] and r["ids"] == ids.tolist() and r["score"] == codec.score(ids)
    assert sentencepiece_scan.encode(none).count() == 0


def test_max_plus_scan():
    rng = np.random.default_rng(1)
    states = [[(0, c) for c in "abcd"[: rng.integers(1, 5)]] for _ in range(8)]
    m = [(a, b, rng.integers(-50, 0, (len(a), len(b)))) for a, b in zip(states[:-1], states[1:], strict=True)]
    want = m[0]
    for i, got in enumerate(sentencepiece_scan.scan(m)):
        want = sentencepiece_scan.max_plus(want, m[i]) if i else want
        assert got[:2] == want[:2] and (got[2] == want[2]).all()


def test_chat_format_equals_sql(spark):
    rows = [(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "hi"), (1, 2, "user", None), (1, 3, "assistant", "é"), (2, 0, "assistant", "alone"), (3, 0, "system", "s" * 300), (3, 1, "user", ""), (3, 2, "assistant", "a"), (3, 2, "assistant", "a"), (4, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = chat_format.link_calls(*chat_format.from_conversations(df))
    want = db.execute(f"select {', '.join(got.columns)} from ({chat_format.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    calls, results = chat_format.from_conversations(df.union(spark.createDataFrame([(None, 1, "user", "x"), (5, None, "assistant", "y")], df.schema)))
    assert chat_format.unlinked(calls).count() == 1 and chat_format.unlinked(results).count() == 1
    assert chat_format.link_calls(*chat_format.from_conversations(df.limit(0))).count() == 0


def test_chat_format_keeps_unlinked_and_repeated(spark):
    rows = [(1, 0, "user", "first"), (1, 0, "user", "other"), (1, 0, "user", "other"), (1, 1, "assistant", "re a"), (1, 1, "assistant", "re b"), (None, 0, "user", "lost call"), (2, None, "system", None), (None, 3, "assistant", "lost result"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.link_calls(*chat_format.from_conversations(df)).collect()
    assert all(sum(json.dumps(t) in r["json"] for r in got) == 1 for _, _, _, t in rows if t)
    seen = {(r["conv_id"], r["turn"], r["result_turn"], r["calls"], r["results"], r["errors"], r["valid"]) for r in got}
    assert len(got) == 7 and seen == {
        (1, 0, 1, 3, 2, "", True), (1, 0, None, 2, 0, "repeated identifier", False), (1, None, 1, 0, 1, "repeated identifier", False),
        (None, 0, None, 1, 0, "no identifier", False), (2, None, None, 1, 0, "no identifier,missing text,missing turn", False), (None, None, 3, 0, 1, "no identifier", False), (3, 0, None, 2, 0, "", True),
    }


def test_conversations_are_whole_and_ordered(spark):
    rows = [(1, 1, "assistant", 'a "b"\n'), (1, 0, "user", "é"), (2, 0, "user", None), (2, 1, "user", "x"), (2, 1, "robot", "y"), (None, 3, "user", "lost"), (3, None, None, "z"), (3, 2, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.conversations(df).collect()}
    assert {k: (r["turns"], r["errors"]) for k, r in got.items()} == {1: (2, ""), 2: (3, "repeated turn,unknown role,no text"), None: (1, "no conversation"), 3: (2, "no turn,unknown role")} | {2: (3, got[2]["errors"])}
    assert {"repeated turn", "unknown role", "no text"} <= set(got[2]["errors"].split(","))
    assert got[1]["json"] == '{"conv_id":1,"messages":[{"content":"é","role":"user","turn":0},{"content":"a \\"b\\"\\n","role":"assistant","turn":1}]}'
    for k, r in got.items():
        said = json.loads(r["json"])
        assert said["conv_id"] == k and sorted(repr((m["turn"], m["role"], m["content"])) for m in said["messages"]) == sorted(repr((t, o, x)) for c, t, o, x in rows if c == k)
    assert chat_format.conversations(df.limit(0)).count() == 0


def test_chat_levels_and_schemas(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, "f", '{"n":1,"b":[2, 1]}', None), (1, "b", 2, "f", '{"n":"1"}', "a"), (1, "c", 3, "f", "{}", "b"), (1, "d", 4, "f", "oops", "e"), (1, "e", 5, "g", "{}", "d"), (1, "f", 6, "f", '{"z":1,"n":2}', "gone")],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on string",
    )
    results = spark.createDataFrame([(1, "b", 7, "ok")], "conv_id long, call_id string, turn long, content string")
    got = {r["call_id"]: r for r in chat_format.link_calls(calls, results, (chat_format.Tool("f", {"n": "integer", "b": "array"}, frozenset({"b"})),)).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0}
    assert {k: r["errors"] for k, r in got.items()} == {"a": "", "b": "n is no integer", "c": "missing n", "d": "not JSON", "e": "unknown tool", "f": "unknown argument"}
    assert got["a"]["json"] == '{"arguments":{"b":[2,1],"n":1},"call_id":"a","level":0,"name":"f","result":null}'


def test_fingerprints_equal_brute_force(docs, texts, none):
    rows = fingerprints.fingerprint_edits(docs).collect()
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for i, (ident, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        want[(ident, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())] += 1
    assert want == Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[2]["near_next"] == 1.0 and by[4]["fingerprint"] == ""
    assert fingerprints.fingerprint_edits(none).count() == 0


def naive_sketch(text: str, k: int = fingerprints.K, words: int = fingerprints.WORDS) -> list[int]:
    """Bottom-k by whole numbers: a word is a polynomial of its bytes, a shingle one of its words."""
    full = (1 << 64) - 1

    def mix(x: int) -> int:
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & full
        return x ^ x >> 33

    tokens = [w.translate(LOWER).encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashes = [mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) & full) for w in tokens]
    runs = [hashes[i : i + words] for i in range(max(1, len(hashes) - words + 1))] if hashes else []
    return sorted({mix(sum(h * ((2 * j + 1) * 0xD6E8FEB86659FD93 & full) for j, h in enumerate(r)) & full) >> 32 for r in runs})[:k]


def naive_likeness(a: list[int], b: list[int], k: int = fingerprints.K) -> float:
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})[:k]
    return len([x for x in union if x in a and x in b]) / len(union)


def test_fingerprints_equal_naive_bottom_k(docs, texts):
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for i, (ident, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        a, e, n = naive_sketch(text), naive_sketch(text[: len(text) - cut] + after[:cut]), naive_sketch(after)
        as_hex = lambda x: "".join(f"{h:08x}" for h in x)
        want[(ident, as_hex(a), as_hex(e), round(naive_likeness(a, e), 9), round(naive_likeness(a, n), 9))] += 1
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert want == Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)


def test_sketches_with_equal_upper_halves_have_k_hashes(monkeypatch):
    many = np.sort(np.concatenate([np.arange(500, dtype=np.uint64), (np.arange(40, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)]))
    monkeypatch.setattr(fingerprints, "shingles", lambda *a: (many, np.array([0, len(many)])))
    assert fingerprints.sketch_texts(pa.array(["x"]), 16)[0].tolist() == list(range(16))


def test_merged_sketches_are_those_of_all_texts(spark, docs, texts):
    rows = fingerprints.fingerprint(docs).withColumn("g", F.coalesce(F.col("doc_id") % 4, F.lit(-1)))
    got = {r["g"]: r["fingerprint"] for r in fingerprints.merged_by(rows, ["g"]).collect()}
    for g in got:
        mine = [naive_sketch(t or "") for i, t in texts if (-1 if i is None else i % 4) == g]
        assert got[g] == "".join(f"{h:08x}" for h in sorted({h for m in mine for h in m})[: fingerprints.K])
    blank = spark.createDataFrame([("a", ""), ("a", None)], "g string, fingerprint string")
    assert [tuple(r) for r in fingerprints.merged_by(blank, ["g"]).collect()] == [("a", "")]


def test_sketch_functions(spark):
    rng = random.Random(4)
    a, b = prose(rng, 3000), prose(rng, 3000)
    df = spark.createDataFrame([(0, " ".join(a)), (1, " ".join([*a, *b])), (2, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    row = spark.createDataFrame([(s[0], s[1], s[2])], "a string, b string, e string").select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("b")).alias("n"), fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.resemblance(F.col("e"), F.col("e")).alias("e")
    ).first()
    x, y = shingle_set(" ".join(a), 5), shingle_set(" ".join([*a, *b]), 5)
    assert abs(row["r"] - len(x & y) / len(x | y)) < 0.15 and abs(row["c"] - 1) < 0.3 and abs(row["n"] / len(y) - 1) < 0.3 and row["e"] == 1.0
    assert row["m"] == fingerprints.as_text(np.union1d(*[np.frombuffer(bytes.fromhex(s[i]), ">u4") for i in (0, 1)])[: fingerprints.K])
