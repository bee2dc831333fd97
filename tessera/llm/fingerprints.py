"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, sliced
from .kernel import flat, shingles

K = 128  # hashes kept of each text
WORDS = 5  # words of a shingle
DIGITS = 8  # hexadecimal digits of a hash: 32 bits
MOST_PARTS = 1 << 17  # ranges of ids, whose bounds the driver holds


def sketch_texts(column: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k least distinct 32-bit shingle hashes of each text, ascending; none for a text without words."""
    h, at = shingles(*flat(column), words)
    top = (h >> np.uint64(32)).astype(np.uint32)  # ascending as h is
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        wide = 2 * k
        x = np.unique(top[i : min(j, i + wide)])
        while len(x) < k and i + wide < j:  # equal upper halves took the room of others
            wide *= 2
            x = np.unique(top[i : min(j, i + wide)])
        out.append(x[:k])
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of the k least hashes of the union that both have; 1 if both are empty, 0 if one is."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, True), True).sum() / len(union))


# The same on sketches as strings, by SQL functions: a hash is DIGITS hexadecimal digits, so the order of strings is that of numbers.


def hashes(sketch: Column) -> Column:
    return F.regexp_extract_all(sketch, F.lit(f"([0-9a-f]{{{DIGITS}}})"), F.lit(1))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both parts together: the k least of the two sketches."""
    return F.array_join(F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, k), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = F.array_intersect(hashes(merged(a, b, k)), F.array_intersect(hashes(a), hashes(b)))
    size = F.size(hashes(merged(a, b, k)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), (F.length(a) == F.length(b)).cast("double")).otherwise(F.size(both) / size)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a fraction."""
    n = F.size(hashes(a))
    last = F.conv(F.substring(a, (k - 1) * DIGITS + 1, DIGITS), 16, 10).cast("double")
    return F.when(n < k, n.cast("double")).otherwise(F.lit(k - 1.0) / ((last + 1) / F.lit(float(16**DIGITS))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the distinct counts; null if a is empty."""
    r = resemblance(a, b, k)
    return F.when(F.length(a) > 0, F.least(F.lit(1.0), r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k)))


def merged_by(rows: DataFrame, by: list[str], sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, fingerprint): the sketch of all rows of a group together, as if their shingles were one text's.

    Hashes are made distinct and cut to the k least of a group before and after the shuffle, so that no task
    has all hashes of a group; a group of empty sketches has an empty one, null sketches count as empty.
    """
    each = rows.select(*by, F.explode_outer(hashes(F.coalesce(F.col(sketch), F.lit("")))).alias("h")).distinct()
    least = each.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("h").asc_nulls_last()))).filter(F.col("n") <= k)
    return least.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("fingerprint"))


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint) of every row; null and empty texts have an empty fingerprint, equal texts equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([as_text(s) for s in sketch_texts(b.column("text"), k, words)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def with_next(docs: DataFrame, per_part: int = 20_000) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of descending doc_id (null last, after it the text), each range followed by the first rows of the next.

    Returns (frame of doc_id, text, ghost, part; number of parts). Bounds between ranges are quantiles of the
    ids, a few for each million rows; each range but for its ghost rows is whole, so a row and the next one
    meet in one task and each text is shuffled once. A row finds its range by binary search.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    n = docs.count()
    want = min(max(1, n // per_part + 1), MOST_PARTS)
    want = max(want, min(n // 64 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(ids.filter("d is not null").approxQuantile("d", [i / want for i in range(1, want)], 0.2 / want))) if want > 1 and n else []
    # part 0 has the largest ids; a null id comes after all others
    if cuts:
        dealer = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_range", handleInvalid="keep")
        docs = dealer.transform(docs.withColumn("_id", F.col("doc_id").cast("double"))).drop("_id")
        rank = F.lit(len(cuts)) - F.col("_range")
    else:
        rank = F.lit(0)
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(rank).cast("int")
    rows = docs.select("doc_id", "text", part.alias("part"))
    firsts = rows.groupBy("part").agg(F.max("doc_id").alias("first")).orderBy("part").collect()
    order = [r["part"] for r in firsts]
    ghost = {r["first"]: order[i - 1] for i, r in enumerate(firsts)}
    table = F.broadcast(spark.createDataFrame([(k, v) for k, v in ghost.items()], "first long, to int"))
    heads = rows.join(table, rows["doc_id"].eqNullSafe(table["first"])).groupBy("to", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    dealt = rows.select("doc_id", "text", F.lit(False).alias("ghost"), "part").unionByName(heads.select("doc_id", "text", F.lit(True).alias("ghost"), F.col("to").alias("part")))
    return dealt, len(cuts) + 2


def fingerprint_edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    text in descending doc_id, equal ids by text; after the last row comes the first. Null texts count as
    empty; an only row is its own next one.
    """
    dealt, parts = with_next(docs)
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one has not come yet: doc_id, text, sketch, part

        def rows() -> Iterator[tuple]:
            for b in sliced(batches, "text"):
                yield from zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), sketch_texts(b.column("text"), k, words), b.column("ghost").to_pylist(), b.column("part").to_pylist(), strict=True)

        out, size = [], 0

        def flush() -> pa.RecordBatch:
            edited = sketch_texts(pa.array([r[1] for r in out], pa.large_string()), k, words)
            cols = [
                pa.array([r[0] for r in out], arrow_id),
                pa.array([r[2] for r in out], pa.int64()),
                pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in out], pa.string()),
                pa.array([as_text(r[3]) for r in out], pa.string()),
                pa.array([as_text(e) for e in edited], pa.string()),
                pa.array([likeness(r[3], e, k) for r, e in zip(out, edited, strict=True)]),
                pa.array([likeness(r[3], r[4], k) for r in out]),
            ]
            return pa.RecordBatch.from_arrays(cols, names)

        for ident, text, sketch, ghost, part in rows():
            text = text or ""
            if held is not None and held[3] == part:
                cut = len(held[1]) // 3
                out.append((held[0], held[1][: len(held[1]) - cut] + text[:cut], len(held[1]), held[2], sketch))
                size += len(out[-1][1])
                if size > 2 << 20:
                    yield flush()
                    out, size = [], 0
            held = None if ghost else (ident, text, sketch, part)
        if out:
            yield flush()

    arrow_id = pa.int32() if id_type == "int" else pa.int64()
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))
    return ordered.mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
