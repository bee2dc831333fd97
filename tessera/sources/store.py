"""Tables in the shared folder, generations with a pointer, row deltas and integrity checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files of a query that has ended go, and what is handed to Python at a time is bounded.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WRITING = {CLEANUP: "true", ARROW_BYTES: str(8 << 20)}
PARTITIONS = "spark.sql.shuffle.partitions"
PART_ROWS = 1 << 15  # narrow rows of a partition, of parted()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where it is unset, a temporary one if there is no cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines see")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fewer(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df with a last stage of four tasks, and so files, for each core, or one for each 64 MB of the tables that `of` reads if those
    are more: partitions beyond that are taken one after the other."""
    size = 0 if of is None else int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, size >> 26), 1 << 24))


def written(df: DataFrame, name: str, few: bool | DataFrame = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors.

    The shuffle files of the write go when it ends, as the table stands for them; release() removes the table. few writes
    fewer() files, of the tables that are given: for small or even rows, none for a hot key's.
    """
    spark = df.sparkSession
    if few is not False:
        df = fewer(df, None if few is True else few)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def parted(spark: SparkSession, rows: int) -> Iterator[int]:
    """While it holds, shuffles have a partition for each PART_ROWS of the rows, and the session's number at most: a small table that is
    dealt out again and again takes its time from the number of tasks."""
    before = spark.conf.get(PARTITIONS)
    n = min(int(before), rows // PART_ROWS + 1)
    spark.conf.set(PARTITIONS, str(n))
    try:
        yield n
    finally:
        spark.conf.set(PARTITIONS, before)


def publish(df: DataFrame, root: str, generation: int, by: list[str] | None = None) -> None:
    """Writes a generation's rows, then moves the pointer: readers see the old generation or the whole new one."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/gen={generation}")
    spark.createDataFrame([(generation,)], "published long").coalesce(1).write.mode("append").json(f"{root}/pointer")


def published(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """The newest published generation and its rows. Without a pointer none is published: an error."""
    g = spark.read.schema("published long").json(f"{root}/pointer").agg(F.max("published")).first()[0]
    return g, spark.read.parquet(f"{root}/gen={g}")


def rebuild(spark: SparkSession, root: str, make: Callable[[], DataFrame], check: Callable[[DataFrame], bool]) -> int:
    """Writes a whole generation beside the published one and moves the pointer if its rows, read again, pass the check; else the
    new folder goes, the old generation stays and ValueError is raised. Returns the generation."""
    g = published(spark, root)[0] + 1
    made = make()
    made.write.mode("overwrite").parquet(f"{root}/gen={g}")
    rows = spark.read.schema(made.schema).parquet(f"{root}/gen={g}")
    if not check(rows):
        rows.folder = f"{root}/gen={g}"
        release(rows)
        raise ValueError(f"generation {g} fails its check")
    spark.createDataFrame([(g,)], "published long").coalesce(1).write.mode("append").json(f"{root}/pointer")
    return g


def put_delta(writes: DataFrame, deletes: DataFrame, root: str, generation: int, number: int) -> None:
    """Writes what a change affects, and no more: rows to write, and keys to delete. A number that is repeated overwrites itself."""
    rows = writes.withColumn("_gone", F.lit(False)).unionByName(deletes.withColumn("_gone", F.lit(True)), True)
    rows.write.mode("overwrite").parquet(f"{root}/deltas/of={generation}/number={number}")


def with_deltas(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The published generation with its deltas: of each key the row of the highest number, without deleted ones.

    Only deltas are grouped; the base is joined to the keys that they touch, which are few.
    """
    g, base = published(spark, root)
    deltas = spark.read.option("basePath", f"{root}/deltas").parquet(f"{root}/deltas/of={g}").drop("of")
    last = latest(deltas, key, "number", "_gone")
    untouched = base.join(deltas.select(key).distinct(), key, "left_anti")
    return untouched.unionByName(last.select(*base.columns))


def put_pages(pages: DataFrame, writes: DataFrame, most: int | None = None) -> DataFrame:
    """(path, outcome) of guarded writes (path, expected, text) to pages (path, text): expected is the hash of the bytes that the writer saw, null for a new page.

    written; unchanged where the text is there already; conflict where the page isn't what was expected, or several writes name it. The batch is one change: no
    write counts unless all are written or unchanged, and what would have been written is then held. A batch of more than `most` is refused.
    """
    if most is not None and writes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} changes")
    hash_ = lambda c: F.sha2(c.cast("binary"), 256)
    one = writes.groupBy("path").agg(F.count("*").alias("n"), F.min("expected").alias("expected"), F.min("text").alias("new"))
    rows = one.join(pages.select("path", F.col("text").alias("old")), "path", "left")
    same = hash_(F.col("old")).eqNullSafe(F.col("expected"))
    outcome = F.when(F.col("n") > 1, "conflict").when(F.col("old") == F.col("new"), "unchanged").when(same, "written").otherwise("conflict")
    judged = rows.select("path", outcome.alias("outcome"))
    broken = judged.agg(F.coalesce(F.bool_or(F.col("outcome") == "conflict"), F.lit(False)).alias("broken"))
    return judged.join(F.broadcast(broken)).select("path", F.when(F.col("broken") & (F.col("outcome") == "written"), "held").otherwise(F.col("outcome")).alias("outcome"))


def overlay(base: DataFrame, writes: DataFrame, deletes: DataFrame, key: str = "path") -> DataFrame:
    """base with proposed rows in place of those with their key, and without deleted ones."""
    gone = writes.select(key).unionByName(deletes.select(key))
    return base.join(gone, key, "left_anti").unionByName(writes)


def latest(events: DataFrame, key: str, sequence: str, tombstone: str) -> DataFrame:
    """Each key's newest row, without keys whose newest row is a tombstone; partial aggregation, no sort of a key's rows."""
    rest = [c for c in events.columns if c != key]
    best = events.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("r")).select(key, "r.*")
    return best.filter(~F.col(tombstone))


def append_once(sink: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key the sink does not have yet, each once: what an idempotent replay adds."""
    return batch.dropDuplicates([key]).join(sink.select(key), key, "left_anti")


def put_vectors(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Staged vectors: new (space, input_hash) rows with ready false; those that are there are kept."""
    return store.unionByName(batch.join(store, ["space", "input_hash"], "left_anti").dropDuplicates(["space", "input_hash"]).withColumn("ready", F.lit(False)))


def confirm_vectors(store: DataFrame, refs: DataFrame) -> DataFrame:
    seen = refs.select("space", "input_hash").distinct().withColumn("_c", F.lit(True))
    return store.join(seen, ["space", "input_hash"], "left").withColumn("ready", F.col("ready") | F.coalesce("_c", F.lit(False))).drop("_c")


def replace_membership(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members without those of the (space, snapshot) pairs in new, and new."""
    return members.join(new.select("space", "snapshot").distinct(), ["space", "snapshot"], "left_anti").unionByName(new)


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of each side that the other doesn't have as often: a full check. Empty if the catalogs are equal."""
    a, b = expected.exceptAll(actual), actual.exceptAll(expected)
    return a.withColumn("side", F.lit("missing")).unionByName(b.withColumn("side", F.lit("unexpected")))
