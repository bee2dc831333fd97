"""The pipeline's stages, each against what its operator finds on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from test_llm import prose, shingle_set


def test_pipeline_stages(spark):
    rng = random.Random(9)
    base = prose(rng, 150)
    passage = " ".join(prose(rng, 70))
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:149], "x"])), (4, None), (5, "12 34"), (6, "")]
    rows += [(i, f"{' '.join(prose(rng, 80))} {passage} {' '.join(prose(rng, 80))}") for i in range(10, 14)]
    rows += [(i, " ".join(prose(rng, 60))) for i in range(20, 40)]
    rows += [(20, rows[-20][1])]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cut int")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert set(got) == {i for i, _ in rows} - {4, 5, 6}
        if name == "ngram_join":
            assert set(got) == {i for i, _ in rows} - {2, 3, 4, 5, 6} and docs.count() == len(got)
            assert len({shingle_set(t, 5) for t in got.values()}) == len(got)
        if name == "suffix_dedup":
            assert not any(passage in t for t in got.values()) and len(got) == 25
            assert got[20] == dict(rows)[20]
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    done = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in done} == kept and all(len(r["ids"]) == r["n_tokens"] for r in done)
    assert 0 < len(kept) <= 25


def test_mix_meets_targets_of_scarce_values(spark):
    """Small values want more tokens than they have; the sample has the budget and the targets of each margin."""
    topics = {"prose": "one two three four", "table": "one | two three", "secret": "token = x four"}
    rows = [(i, t, lang, source) for i, (t, lang, source) in enumerate((t, lang, source) for source, a in (("a", 40), ("b", 8), ("c", 1)) for lang, b in (("x", 6), ("y", 1)) for n, c in (("prose", 20), ("table", 3), ("secret", 1)) for t in [topics[n]] * (a * b * c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    topic = {t: n for n, t in topics.items()}
    got = [(r["source"], r["lang"], topic[r["text"]]) for r in mixed.collect()]
    assert abs(len(got) / (corpus_pipeline.mixing.BUDGET * len(rows)) - 1) < 0.02  # all texts have four tokens
    whole = [(source, lang, topic[t]) for _, t, lang, source in rows]
    for k in range(3):
        roots = {v: sum(x[k] == v for x in whole) ** corpus_pipeline.mixing.POWER for v in {x[k] for x in whole}}
        for v, root in roots.items():
            assert abs(sum(x[k] == v for x in got) / len(got) - root / sum(roots.values())) < 0.015, v


def test_pipeline_runs_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "stage")
    assert docs.count() == 0


def test_near_copies_keep_every_column_of_repeated_rows(spark):
    """Names that the stages use themselves and a map, which can't be ordered, go along; of repeated rows one stays whole."""
    rng = random.Random(12)
    text = [" ".join(prose(rng, 40)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t), {"a": i}, "k", f"r{i}", 1) for i, t in enumerate(text)]
    rows += [(3, text[3], "en", "s", len(text[3]), {"b": 1}, "other", "r", 2), (3, text[3], "en", "s", len(text[3]), {"b": 1}, "other", "r", 2), (None, text[5], "en", "s", 1, None, None, None, None), (None, text[5], "en", "s", 1, None, None, None, None)]
    rows += [(20, "", "en", "s", 0, {"c": 1}, "x", "y", 3), (20, "", "en", "s", 0, {"c": 1}, "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, meta map<string,int>, _key string, row string, tk int").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted(map(repr, map(tuple, out.collect())))
    whole = [repr(r) for r in rows]
    assert len(got) == 14 and all(g in whole for g in got)
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(12), 20, 20]  # without words a row is like no other
    again = sorted(map(repr, map(tuple, corpus_pipeline.drop_near_copies(spark, docs.repartition(5), "").collect())))
    assert again == got
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        assert docs.columns == out.columns


def test_mixing_query_meets_its_targets(spark):
    """The query's rows, each as often as its copies say, have the budget and every margin's shares."""
    from tessera.llm import mixing

    rows = mixing.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    whole, drawn = sum(r["tokens"] for r in rows), sum(r["tokens"] * r["copies"] for r in rows)
    assert abs(drawn / whole / mixing.BUDGET - 1) < 0.03 and all((r["copies"] > 0) == r["chosen"] for r in rows)
    for m in mixing.MARGINS:
        roots = {v: sum(r["tokens"] for r in rows if r[m] == v) ** mixing.POWER for v in {r[m] for r in rows}}
        for v, root in roots.items():
            assert abs(sum(r["tokens"] * r["copies"] for r in rows if r[m] == v) / drawn - root / sum(roots.values())) < 0.02, (m, v)
