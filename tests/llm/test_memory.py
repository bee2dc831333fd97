"""Memory of Python workers: what is handed to them at a time, and what they keep."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, language_id, sentencepiece_scan, suffix_dedup


@pytest.mark.parametrize("run", [lambda d: language_id.identify_rows(d, language_id.learn(d)), suffix_dedup.cut_rows, sentencepiece_scan.encode], ids=["language_id", "suffix_dedup", "sentencepiece"])
def test_last_stage_gets_bounded_batches_whoever_writes_it(spark, run):
    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    old = spark.conf.get(common.ARROW_BYTES)
    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 300)
    docs = spark.range(8000, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    try:
        spark.conf.set(common.ARROW_BYTES, str(256 << 20))
        run(docs.limit(50))
        assert docs.mapInArrow(largest, "n long").agg(F.max("n")).first()[0] < 10 << 20  # over 20 MB before
    finally:
        spark.conf.set(common.ARROW_BYTES, old)


def test_a_worker_gives_memory_back_when_a_task_ends(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append("back"))

    def f(batches):
        for b in batches:
            done.append(b)
            yield b

    assert list(common.lean(f)(iter([1, 2]))) == [1, 2]
    assert done == [1, 2, "back"]


def test_memory_held_free_is_given_back():
    held = pa.array([b"x" * 1000] * 50_000, pa.binary())
    del held
    common.give_back()
    assert pa.default_memory_pool().bytes_allocated() < 10 << 20
