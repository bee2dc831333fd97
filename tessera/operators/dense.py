"""Dense search: exact cosine with owner collapse, vector checks, coverage, worklists; rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.filters import top
from tessera.sources.store import written

#: Channels of rank contributions, and the constant of reciprocal rank fusion.
CHANNELS = ("dense", "exact_id", "exact_title", "exact_alias", "lexical", "identity_lexical", "graph_evidence")
RRF = 60.0
QUERY_BYTES = 8 << 20  # of query vectors that go to the tasks at a time
BATCH_ITEMS, BATCH_BYTES = 32, 256 * 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, clamped to [-1, 1]; null for a zero vector."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def finite(v: str) -> Column:
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def normalised(v: str) -> Column:
    """Unit length, computed in double and stored in float; null for a zero vector or one that isn't finite."""
    norm = F.sqrt(dot(F.col(v), F.col(v)))
    return F.when(finite(v) & (norm > 0), F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def unit_length(v: str) -> Column:
    """Whether a stored vector is as long as it must be: its square within 1e-5 of 1."""
    return F.abs(dot(F.col(v), F.col(v)) - 1) <= 1e-5


def dense_owners(units: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k owners with the best unit, each with its best two units: (owner, owner_rank, unit_rank, unit_id, score).

    Two passes over narrow rows: best unit of each owner by partial aggregation, top k of those; then the units of
    the winners, k rows being broadcast. Order: score descending, owner, unit_id.
    """
    scored = units.select("owner", "unit_id", cosine(F.col("embedding"), literal_vector(query)).alias("score")).filter("owner is not null and score is not null")
    best = scored.groupBy("owner").agg(F.max("score").alias("best"), F.max_by(-F.col("unit_id"), F.struct("score", -F.col("unit_id"))).alias("u"))
    owners = top(best, [F.col("best").desc(), F.col("owner")], k).select("owner", F.col("rank").alias("owner_rank"))
    w = Window.partitionBy("owner").orderBy(F.col("score").desc(), "unit_id")
    return scored.join(F.broadcast(owners), "owner").withColumn("unit_rank", F.row_number().over(w)).filter("unit_rank <= 2").select("owner", "owner_rank", "unit_rank", "unit_id", "score")


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def dense_owners_of(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """dense_owners() of many queries (query, embedding) at once: (query, owner, owner_rank, unit_rank, unit_id, score).

    Query vectors go to the tasks in blocks of QUERY_BYTES at most, and for each block the units are read twice, as Arrow batches that
    meet the block in one product of matrices. The first time a task returns its k best owners of each query, by their best
    unit, which are merged by aggregation; the second time the two best units of each winner. Scores are rounded to 12 digits, so
    that the order of a product's sums doesn't decide ties. Queries and units that are null, zero, not finite or of another width take no part.
    """
    fine = finite("embedding") & (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0)
    asked = queries.filter(fine & F.col("query").isNotNull()).select("query", "embedding", F.size("embedding").alias("width"))
    sizes = asked.groupBy("width").count().collect()  # a row for each width
    rows = units.filter(fine & F.col("owner").isNotNull()).select("owner", "unit_id", "embedding")
    owner, unit, kind = (dict(d.dtypes)[c] for d, c in ((units, "owner"), (units, "unit_id"), (queries, "query")))
    found = []
    for size in sizes:
        width, blocks = size["width"], -(-size["count"] * size["width"] * 8 // QUERY_BYTES)
        for i in range(blocks):
            block = asked.filter((F.col("width") == width) & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)).select("query", "embedding").orderBy("query").toArrow()
            found.append(_owners_of_block(rows.filter(F.size("embedding") == width), block, width, k, f"query {kind}, owner {owner}, unit_id {unit}, score double"))
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], f"query {kind}, owner {owner}, owner_rank int, unit_rank int, unit_id {unit}, score double")


def _owners_of_block(rows: DataFrame, block: pa.Table, width: int, k: int, schema: str) -> DataFrame:
    vectors = _rows(block.column("embedding").combine_chunks(), width)
    unit_length = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    sent = rows.sparkSession.sparkContext.broadcast((block.column("query").combine_chunks(), unit_length))

    def best(batches: Iterator[pa.RecordBatch], most: int, wanted: Callable | None) -> Iterator[pa.RecordBatch]:
        """The `most` best units of each owner and query of a batch, of wanted owners."""
        names, q = sent.value
        for b in batches:
            x = _rows(b.column("embedding"), width)
            score = np.round(np.clip((x / np.sqrt((x * x).sum(axis=1))[:, None]) @ q.T, -1, 1), 12)
            unit = b.column("unit_id").to_numpy()
            of = pc.rank(b.column("owner"), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
            keep = wanted(b.column("owner"), of) if wanted else None
            for j in range(len(names)):
                order = np.lexsort((unit, -score[:, j], of))
                if keep is not None:
                    order = order[keep[j][of[order]]]
                head = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(order) else np.zeros(0, np.int64)
                place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
                taken = order[place < most]
                if wanted is None and len(taken) > k:
                    owners = of[taken]
                    taken = taken[np.lexsort((owners, -score[taken, j]))[:k]]
                at = pa.array(taken)
                yield pa.RecordBatch.from_arrays([pa.array([names[j].as_py()] * len(taken), names.type), b.column("owner").take(at), b.column("unit_id").take(at), pa.array(score[taken, j])], ["query", "owner", "unit_id", "score"])

    first = rows.mapInArrow(lambda batches: best(batches, 1, None), schema).groupBy("query", "owner").agg(F.max("score").alias("best"))
    place = Window.partitionBy("query").orderBy(F.col("best").desc(), "owner")
    winners = first.withColumn("owner_rank", F.row_number().over(place)).filter(F.col("owner_rank") <= k).select("query", "owner", "owner_rank")
    winners = written(winners, "winners")  # k rows for each query of the block
    won = rows.sparkSession.sparkContext.broadcast(winners.select("query", "owner").toArrow())

    def of_winners(owners: pa.Array, of: np.ndarray) -> list[np.ndarray]:
        """For each query which of the batch's owners, by their rank, won."""
        names, _ = sent.value
        ranks = dict(zip(owners.to_pylist(), of.tolist(), strict=True))
        number = {name.as_py(): j for j, name in enumerate(names)}
        out = [np.zeros(len(ranks), bool) for _ in names]
        for query, owner in zip(won.value.column("query").to_pylist(), won.value.column("owner").to_pylist(), strict=True):
            if owner in ranks:
                out[number[query]][ranks[owner]] = True
        return out

    second = rows.mapInArrow(lambda batches: best(batches, 2, of_winners), schema).join(winners, ["query", "owner"])
    w = Window.partitionBy("query", "owner").orderBy(F.col("score").desc(), "unit_id")
    return second.withColumn("unit_rank", F.row_number().over(w)).filter("unit_rank <= 2").select("query", "owner", "owner_rank", "unit_rank", "unit_id", "score")


def coverage(units: DataFrame, vectors: DataFrame, key: str = "input_hash") -> DataFrame:
    """Counts of eligible units and of their vectors: available, missing, corrupt, pending."""
    fine = finite("vector") & unit_length("vector")
    rows = units.join(vectors, key, "left")
    there = F.col("vector").isNotNull()
    return rows.agg(
        F.count("*").alias("eligible"), F.count_if(there & fine & F.col("ready")).alias("available"), F.count_if(~there).alias("missing"), F.count_if(there & ~fine).alias("corrupt"), F.count_if(there & fine & ~F.col("ready")).alias("pending")
    )


def worklist(units: DataFrame, vectors: DataFrame, shards: int = 64, key: str = "input_hash") -> DataFrame:
    """(shard, batch, key, bytes) of inputs without a vector, each once, in batches of at most BATCH_ITEMS and BATCH_BYTES.

    Batches are filled in order of key inside shards by hash, so that no task orders all inputs; an item that is larger
    than a batch is alone. Filling is sequential, so each shard's sorted rows are streamed through one fold.
    """
    missing = units.join(vectors.select(key), key, "left_anti").groupBy(key).agg(F.max("bytes").cast("long").alias("bytes"))
    dealt = missing.select(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard"), key, "bytes")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, items, held = None, 0, 0, 0
        for b in batches:
            numbers = []
            for shard, size in zip(b.column("shard").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if shard != last:
                    last, batch, items, held = shard, 0, 0, 0
                if items and (items == BATCH_ITEMS or held + size > BATCH_BYTES):
                    batch, items, held = batch + 1, 0, 0
                items, held = items + 1, held + size
                numbers.append(batch)
            yield b.append_column("batch", pa.array(numbers, pa.int32()))

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", key)
    return ordered.mapInArrow(fill, f"shard int, {key} string, bytes long, batch int").select("shard", "batch", key, "bytes")


def fuse(lists: DataFrame) -> DataFrame:
    """(path, score, channels): sum of 1 / (60 + rank) over channels, a channel's first contribution only, from rows (path, channel, rank)."""
    first = lists.groupBy("path", "channel").agg(F.min("rank").alias("rank"))
    return first.groupBy("path").agg(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("channels"))


def channel_lists(ranked: DataFrame) -> DataFrame:
    """Rows (path, channel, rank) from columns rank_<channel>."""
    cols = [c for c in ranked.columns if c.startswith("rank_")]
    return ranked.select("path", F.explode(F.array(*[F.struct(F.lit(c[5:]).alias("channel"), F.col(c).alias("rank")) for c in cols])).alias("x")).select("path", "x.channel", "x.rank").filter("rank is not null")


def hybrid(*lists: DataFrame, k: int = 80) -> DataFrame:
    """Fused candidates of several channel lists, cut at k: (path, score, channels, rank)."""
    return top(fuse(reduce(DataFrame.unionByName, lists)), [F.col("score").desc(), F.col("path")], k)


