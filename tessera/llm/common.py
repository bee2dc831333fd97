"""What the operators share: whole groups from sorted batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import ARROW_BYTES, WRITING, fewer, release, written

__all__ = ["bounded", "documents", "fewer", "lean", "release", "rows_of", "sliced", "text_key", "whole_groups", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key() -> Column:
    """One long for each text; a null text counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def bounded(df: DataFrame) -> DataFrame:
    """df, whose batches for Python have the bound of written() whoever runs it: from now on, in its whole session."""
    df.sparkSession.conf.set(ARROW_BYTES, WRITING[ARROW_BYTES])
    return df


def give_back() -> None:
    """Memory that Arrow and malloc hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, after which a worker that waits for other tasks doesn't keep what f needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of a string column at most; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def rows_of(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables in which every group of the keys is complete; the batches are sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def last_change(table: pa.Table) -> int:
        n = table.num_rows
        change = None
        for k in keys:
            c = table.column(k).combine_chunks()
            ne = pc.not_equal(c.slice(1), c.slice(0, n - 1))
            change = ne if change is None else pc.or_(change, ne)
        found = change.to_numpy(zero_copy_only=False).nonzero()[0]
        return int(found[-1]) + 1 if len(found) else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            cut = last_change(table)
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
            least = max(least, 2 * rows)  # a long group isn't scanned again for each batch
    if rows:
        yield pa.Table.from_batches(held)
