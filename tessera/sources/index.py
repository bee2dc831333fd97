"""A stored full-text index: postings with positions by bucket of terms, what bounds them, narrow rows of what is indexed, sums for BM25.

A posting is a row for each term of each field of a row: (bucket, term, chunk, key, field, n, positions, size, len, mask), n being how
often the term is there, size the tokens of its field, len those of all fields, and mask the fields of the row that have the term. Files are
partitioned by bucket, a checksum of the term, and sorted by term and chunk, some CHUNK rows by the hash of their key, so that a
query reads the buckets and the row groups of its terms alone, and positions only for phrases. There is a bucket for each million tokens, of a
few hundred at most, and a bucket of many tokens is written by several tasks, so that the postings of a term that is
everywhere don't meet in one. Beside them stand the number of rows of each term by mask, and for each term, chunk and field the most hits and the
shortest field, which bound a score. A task of more than RUN_POSITIONS positions writes its rows in several sorted runs, and bounds for each run.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.model import tokens
from tessera.sources.store import WRITING, release, shared_dir, written

BUCKETS = (8, 512)  # the least and the most; a power of 2
BUCKET_TOKENS = 1 << 20  # tokens of a bucket, as long as there are few enough
TASK_TOKENS = 1 << 23  # tokens of a task, which has one or several buckets or a part of one
LEAST_TASKS = 32
CHUNK = 64  # rows of a chunk
PACK_ROWS = 1 << 20  # rows that are packed together on their way to a bucket's tasks
BY = ["bucket", "term", "chunk", "field", "mask"]
PACKS = "bucket int, part int, rows binary"
RUN_POSITIONS = 1 << 23  # positions of a task that are sorted together
OUT_ROWS = 1 << 16
#: While an index is made: a task keeps the files of its buckets open, as its rows are sorted already.
BUILDING = WRITING | {"spark.sql.maxConcurrentOutputFileWriters": "256", "spark.sql.parquet.compression.codec": "zstd"}
BLOCKS = "term string, chunk long, field string, mask int, most int, shortest int, rows long, bucket int"
MOST_KNOWN = 1 << 16  # terms whose numbers of rows are kept


@dataclass
class Index:
    """rows: key, the kept columns and size_<field>; sums: tokens of each field over all rows; count: rows; terms (term, mask, rows); blocks (term, chunk, field, mask, most, shortest, rows)."""

    rows: DataFrame
    postings: DataFrame
    terms: DataFrame
    blocks: DataFrame
    key: str
    fields: tuple[str, ...]
    count: int
    sums: dict[str, int]
    buckets: int
    known: dict[str, dict[int, int]] = field(default_factory=dict)  # of terms that were asked for, at most MOST_KNOWN
    counted: dict[str, int] = field(default_factory=dict)  # rows of phrases that were asked for

    def average(self, fields: Sequence[str] | None = None) -> float:
        return sum(self.sums[f] for f in fields or self.fields) / max(self.count, 1)

    def of_terms(self, terms: Sequence[str], table: DataFrame | None = None) -> DataFrame:
        """The postings (or rows of another table by term) of these terms: others' buckets aren't read, and others' row groups are skipped."""
        found = (self.postings if table is None else table).filter(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})))
        return found.filter(F.col("term").isin(*terms))

    def frequencies(self, terms: Sequence[str], fields: Sequence[str]) -> dict[str, int]:
        """In how many rows each term is in one of the fields."""
        new = sorted(set(terms) - set(self.known))
        if new:
            if len(self.known) + len(new) > MOST_KNOWN:
                self.known.clear()
                new = sorted(set(terms))
            found = {t: {} for t in new}
            for r in self.of_terms(new, self.terms).collect():  # a row for each set of fields
                found[r["term"]][r["mask"]] = r["rows"]
            self.known |= found
        wanted = sum(1 << self.fields.index(f) for f in fields)
        return {t: sum(n for mask, n in self.known[t].items() if mask & wanted) for t in terms}


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def text_of(df: DataFrame, c: str) -> Column:
    return F.array_join(c, " ") if dict(df.dtypes)[c].startswith("array") else F.col(c)


def postings_of(batches: Iterator[pa.RecordBatch], key: str, fields: Sequence[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each term of each field of rows (key, chunk, t_<field>...), whose tokens are together already."""
    for b in batches:
        lists = [b.column(f"t_{f}") for f in fields]
        sizes = np.stack([c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in lists]).astype(np.int64)
        words = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
        if not len(words):
            continue
        row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
        of = np.repeat(np.arange(len(fields)), sizes.sum(axis=1))
        position = np.arange(len(row)) - np.repeat(np.cumsum(sizes.ravel()) - sizes.ravel(), sizes.ravel())
        term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # tokens are in the order of their positions, which a stable sort keeps
        order = np.argsort((row * len(words.dictionary) + term) * len(fields) + of, kind="stable")
        row, of, term, position = row[order], of[order], term[order], position[order]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])  # another row or term
        head = np.flatnonzero(fresh | np.concatenate([[True], of[1:] != of[:-1]]))
        n = np.diff(np.append(head, len(row)))
        group = np.cumsum(fresh)[head] - 1
        mask = np.zeros(group[-1] + 1, np.int64)
        np.bitwise_or.at(mask, group, 1 << of[head])
        names = words.dictionary.to_pylist()
        bucket_ = np.array([bucket_of(t, buckets) for t in names], np.int32)
        at = pa.array(row[head])
        columns = {
            "term": words.dictionary.take(pa.array(term[head])), "chunk": b.column("chunk").take(at), key: b.column(key).take(at), "field": pa.array(np.array(fields, object)[of[head]], pa.string()), "n": pa.array(n.astype(np.int32)),
            "positions": pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(position.astype(np.int32))), "size": pa.array(sizes[of[head], row[head]].astype(np.int32)), "len": pa.array(sizes.sum(axis=0)[row[head]].astype(np.int32)),
            "mask": pa.array(mask[group].astype(np.int32)), "bucket": pa.array(bucket_[term[head]]),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _steps(a: np.ndarray) -> np.ndarray:
    """What each number is more than the one before, in as few bytes as the numbers themselves: sums of these overflow to them again."""
    a = _narrow(a)
    return np.diff(a, prepend=a.dtype.type(0))


def packed(batches: Iterator[pa.RecordBatch], spread: int, group: int = 1) -> Iterator[pa.RecordBatch]:
    """Postings by group of neighbouring buckets and task of it (part: spread of them, by chunk) as one compressed row each for some PACK_ROWS, as rows of a few numbers
    take many times their bytes in a shuffle and are spilled. A term stands once in a row, and so do a text's key, chunk and sizes."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = t.schema.names[2]
        number = lambda c: t.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        words, keys, names = (t.column(c).dictionary_encode() for c in ("term", key, "field"))
        code = lambda d: d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # keys are numbered in their order: what neighbours share is said once
        term, text = code(words), np.argsort(pc.sort_indices(keys.dictionary).to_numpy())[code(keys)] * len(names.dictionary) + code(names)
        place = number("bucket") // group * spread + number("chunk") % spread
        order = np.lexsort((text, place * len(words.dictionary) + term))
        term, text, place = term[order], text[order], place[order]
        n, mask, bucket_, chunk, size_, len_ = (number(c)[order] for c in ("n", "mask", "bucket", "chunk", "size", "len"))
        position = t.column("positions").take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)
        cut = lambda x: [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        ends, at = np.append(0, np.cumsum(n)), cut(place)
        out = []
        for start, end in zip(at, at[1:]):
            runs = np.array(cut(term[start:end])) + start
            of, first, where = np.unique(text[start:end], return_index=True, return_inverse=True)
            row, of_key = pa.array(order[start:end][first]), of // len(names.dictionary)
            fresh = np.flatnonzero(np.append(True, of_key[1:] != of_key[:-1]))
            columns = {
                "term": words.dictionary.take(pa.array(term[runs[:-1]])), "bucket": _narrow(bucket_[runs[:-1]]), "rows": _narrow(np.diff(runs)),
                "key": t.column(key).take(row.take(pa.array(fresh))), "chunk": _narrow(chunk[start:end][first][fresh]), "len": _narrow(len_[start:end][first][fresh]), "fields": _narrow(np.diff(np.append(fresh, len(of)))),
                "size": _narrow(size_[start:end][first]), "field": t.column("field").take(row),
                "text": _steps(where), "n": _narrow(n[start:end]), "mask": _narrow(mask[start:end]), "position": _steps(position[ends[start] : ends[end]]),
            }
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns.values()]
            one = pa.RecordBatch.from_arrays(lists, list(columns))
            stream = pa.BufferOutputStream()
            with pa.ipc.new_stream(stream, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(one)
            out.append((int(place[start]) // spread, int(place[start]) % spread, stream.getvalue().to_pybytes()))
        b, p, rows = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "part", "rows"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= PACK_ROWS:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def unpacked(batches: Iterator[pa.RecordBatch], key: str = "id") -> Iterator[pa.RecordBatch]:
    """The rows of packed(), some RUN_POSITIONS at a time by bucket, term, chunk and key: a task's rows, unless it has more of them."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        flat = lambda c: pa.concat_arrays([b.column(c).flatten() for b in held])
        numbers = lambda c, kind: np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind) for b in held])
        sums = lambda c: [np.cumsum(x, dtype=x.dtype) for x in (b.column(c).flatten().to_numpy(zero_copy_only=False) for b in held)]
        ranks = lambda t: np.argsort(pc.sort_indices(t, [(c, "ascending") for c in t.column_names]).to_numpy())
        words, keys = flat("term").dictionary_encode(), flat("key")
        # ranks of the terms by bucket and of the texts by chunk and key, so that rows are sorted by one number
        codes = words.indices.to_numpy(zero_copy_only=False)
        bucket_ = np.zeros(len(words.dictionary), np.int64)
        bucket_[codes] = numbers("bucket", np.int64)
        rank = ranks(pa.table({"b": bucket_, "t": words.dictionary}))
        of_key = np.repeat(np.arange(len(keys)), numbers("fields", np.int64))
        keys, chunk, len_ = keys.take(pa.array(of_key)), numbers("chunk", np.int64)[of_key], numbers("len", np.int32)[of_key]
        texts = pa.table({"c": chunk, "k": keys, "f": flat("field")})
        text_rank = ranks(texts)
        term = np.repeat(codes, numbers("rows", np.int64))
        bases = np.cumsum([0, *[len(b.column("field").flatten()) for b in held[:-1]]])
        text = np.concatenate([x.astype(np.int64) + base for x, base in zip(sums("text"), bases)])
        order = np.argsort(rank[term] * len(keys) + text_rank[text])
        n = numbers("n", np.int32)
        position = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate([x.astype(np.int32) for x in sums("position")])))
        term, text = term[order], text[order]
        at = pa.array(text)
        columns = {
            "term": words.dictionary.take(pa.array(term)), "chunk": texts.column("c").combine_chunks().take(at), key: keys.take(at), "field": flat("field").take(at), "n": pa.array(n[order]), "positions": position.take(pa.array(order)),
            "size": pa.array(numbers("size", np.int32)[text]), "len": pa.array(len_[text]), "mask": pa.array(numbers("mask", np.int32)[order]), "bucket": pa.array(bucket_[term].astype(np.int32)),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    held, size = [], 0
    for b in batches:
        for rows in b.column("rows"):
            held += pa.ipc.open_stream(rows.as_buffer())
            size += len(held[-1].column("position").flatten())
            if size >= RUN_POSITIONS:
                yield run(held)
                held, size = [], 0
    if held:
        yield run(held)


def stored(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The postings of packed() rows, and behind those of a run its blocks: of each term, chunk, field and mask the most hits, the shortest field and the rows. `of` tells which."""
    for run in unpacked(batches, key):
        blocks = pa.Table.from_batches([run.select([*BY, "n", "size"])]).group_by(BY, use_threads=False).aggregate([("n", "max"), ("size", "min"), ("n", "count")])
        blocks = blocks.sort_by([(c, "ascending") for c in BY]).combine_chunks().to_batches()[0]
        none = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
        posting = [c for c in run.schema.names if c not in BY]
        names = [*posting, "most", "shortest", "rows", "of", *BY[1:], "bucket"]
        for start in range(0, run.num_rows, OUT_ROWS):
            b = run.slice(start, OUT_ROWS)
            more = [*none(b.num_rows, pa.int32(), pa.int32(), pa.int64()), pa.array(["postings"] * b.num_rows)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in posting], *more, *[b.column(c) for c in [*BY[1:], "bucket"]]], names)
        for start in range(0, blocks.num_rows, OUT_ROWS):
            b = blocks.slice(start, OUT_ROWS)
            held = [*none(b.num_rows, *[run.schema.field(c).type for c in posting]), b.column("n_max"), b.column("size_min"), b.column("n_count"), pa.array(["blocks"] * b.num_rows)]
            yield pa.RecordBatch.from_arrays([*held, *[b.column(c) for c in [*BY[1:], "bucket"]]], names)


def build(df: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = ()) -> Index:
    """The index of df's fields (texts or lists of texts) in the shared folder. Null keys aren't indexed; a null field has no tokens."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    held = [c for c in dict.fromkeys([key, *keep])]
    indexed = df.filter(F.col(key).isNotNull())
    before = {k: spark.conf.get(k, v) for k, v in BUILDING.items()}
    for k, v in BUILDING.items():
        spark.conf.set(k, v)
    try:
        # written once: what df joins and the tokens of its texts aren't made again for the postings
        tokenised = written(indexed.select(*held, *[tokens(text_of(df, f)).alias(f"t_{f}") for f in fields]), "tokens")
        tokenised.select(*held, *[F.size(f"t_{f}").alias(f"size_{f}") for f in fields]).write.parquet(f"{root}/rows")
        count, sums = _sums(spark.read.parquet(f"{root}/rows"), fields)
        every = sum(sums.values())
        buckets = min(BUCKETS[1], max(BUCKETS[0], 1 << (every // BUCKET_TOKENS).bit_length()))
        spread = every // (buckets * TASK_TOKENS) + 1
        group = 1  # neighbouring buckets of a task
        while buckets // (2 * group) >= LEAST_TASKS and 2 * group * every <= buckets * TASK_TOKENS:
            group *= 2
        kind = dict(df.dtypes)[key]
        kinds = _schema(key, kind)
        rows = tokenised.select(key, F.pmod(F.xxhash64(key), F.lit(count // CHUNK + 1)).alias("chunk"), *[f"t_{f}" for f in fields])
        packs = rows.mapInArrow(lambda batches: packed(postings_of(batches, key, fields, buckets), spread, group), PACKS)
        both = f"{key} {kind}, n int, positions array<int>, size int, len int, most int, shortest int, rows long, of string, term string, chunk long, field string, mask int, bucket int"
        found = packs.repartition(buckets // group * spread, "bucket", "part").mapInArrow(lambda batches: stored(batches, key), both)
        found.write.partitionBy("of", "bucket").parquet(f"{root}/by_term")
        for of in ("postings", "blocks"):  # are there without rows too
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/by_term/of={of}")
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(where)
        lowest = F.element_at(F.array(*[F.lit(f) for f in fields]), (F.log2(F.col("mask").bitwiseAND(-F.col("mask"))) + 1).cast("int"))
        blocks = spark.read.schema(BLOCKS).parquet(f"{root}/by_term/of=blocks")
        terms = blocks.filter(F.col("field") == lowest).groupBy("bucket", "term", "mask").agg(F.sum("rows").alias("rows"))  # a row counts where its first field is
        terms.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/by_term/of=terms")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    release(tokenised)
    return Index(*_tables(spark, root, kinds), key, tuple(fields), count, sums, buckets)


def _sums(rows: DataFrame, fields: Sequence[str]) -> tuple[int, dict[str, int]]:
    one = rows.agg(F.count("*").alias("n"), *[F.sum(f"size_{f}").alias(f) for f in fields]).first()
    return one["n"], {f: one[f] or 0 for f in fields}


def _schema(key: str, kind: str) -> str:
    return f"term string, chunk long, {key} {kind}, field string, n int, positions array<int>, size int, len int, mask int, bucket int"


def _tables(spark: SparkSession, root: str, kinds: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    read = lambda schema, name: spark.read.schema(schema).parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/rows"), read(kinds, "by_term/of=postings"), read("term string, mask int, rows long, bucket int", "by_term/of=terms"), read(BLOCKS, "by_term/of=blocks")


def unmatched(index: Index) -> DataFrame:
    """(key, reason) of rows and postings that don't fit: postings without their row, and rows whose field has not as many postings as tokens."""
    counted = index.postings.groupBy(index.key, "field").agg(F.sum("n").alias("found"))
    wanted = index.rows.select(index.key, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in index.fields]), F.array(*[F.col(f"size_{f}") for f in index.fields]))).alias("field", "size")).filter("size > 0")
    both = wanted.join(counted, [index.key, "field"], "full")
    reason = F.when(F.col("size").isNull(), "postings without a row").when(F.col("found").isNull(), "no postings").when(F.col("found") != F.col("size"), "postings are missing")
    return both.select(index.key, "field", reason.alias("reason")).filter("reason is not null")


def digests(occurrences: DataFrame, buckets: int, by: Sequence[str]) -> DataFrame:
    """(bucket, n, low, high) of rows (term, *by): how many there are in each bucket of terms, and two sums of their hashes that no order changes."""
    hashed = [F.xxhash64("term", *by, F.lit(i)).alias(f"h{i}") for i in (0, 1)]
    rows = occurrences.select(bucket(F.col("term"), buckets).alias("bucket"), *hashed)
    # halves are summed, so that no sum overflows
    sums = [F.sum(F.shiftrightunsigned(f"h{i}", 32) if high else F.col(f"h{i}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"s{i}{int(high)}") for i in (0, 1) for high in (False, True)]
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), *sums)


def audit(index: Index, df: DataFrame) -> DataFrame:
    """(term, key, field, position, side) of occurrences that the stored postings of df's fields have too few or too many of, each as often: missing or unexpected.

    The other side is built anew from the texts, by another way than the index: tokens are exploded, not grouped. Both sides give digests by bucket of
    terms; only buckets whose digests differ are compared row by row, so that what is shuffled of a sound index is a row for each bucket and task.
    """
    key = index.key
    by = [key, "field", "position"]
    texts = df.filter(F.col(key).isNotNull())
    one = lambda f: texts.select(F.col(key), F.lit(f).alias("field"), F.posexplode(tokens(text_of(df, f))).alias("position", "term"))
    rebuilt = reduce(DataFrame.unionByName, [one(f) for f in index.fields]).select("term", *by)
    stored = index.postings.select("bucket", "term", key, "field", F.explode("positions").alias("position"))
    names = [c for c in digests(rebuilt, index.buckets, by).columns if c != "bucket"]
    was = digests(stored.select("term", *by), index.buckets, by)
    now = digests(rebuilt, index.buckets, by).select("bucket", *[F.col(c).alias(f"new_{c}") for c in names])
    differ = was.join(now, "bucket", "full").filter(~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in names]))
    wrong = [r["bucket"] for r in differ.select("bucket").collect()]  # BUCKETS[1] at most
    stored = stored.filter(F.col("bucket").isin(wrong)).select("term", *by)
    rebuilt = rebuilt.filter(bucket(F.col("term"), index.buckets).isin(wrong))
    return rebuilt.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(rebuilt).withColumn("side", F.lit("unexpected")))
