"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, by K centroids each, so that a vector lies in one of K * K cells. A
query takes pairs of centroids from a heap by the sum of the two halves' distances until the cells have SHORTLIST
entries, which are ranked by their true distances. The k-th best of them is a bound for a second round: a cell's
entries have a squared distance of a known mean and spread (that of the centroids, and the residuals' variance), which
gives the number of entries nearer than the bound that a cell is expected to hold; cells are taken, best first, until
those left out are expected to hold no more than MISSED in all. Where vectors have structure the second round
takes next to nothing; where they have none, as uniform ones, it takes much, as it must.

Entries are dealt to units, ranges of cells of about UNIT rows (a larger cell is several units), and queries go to the
units of their cells. Equal vectors are one entry with their least ids, which is exact for k neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, rows_of, written
from .kernel import flat

SAMPLE_ROWS = 32_768  # centroids are fitted to at most so many vectors, those of the least hashes,
SAMPLE_BYTES = 64 << 20  # and at most so many bytes of them
MOST_CENTROIDS = 512  # for a half; cells are at most the square
SHORTLIST = 1000  # entries of the first round
MISSED = 0.2  # expected number of nearer entries in cells that aren't taken
UNIT = 1024  # entries of a unit
PASSES = 12  # of Lloyd's algorithm
# The normal distribution's share below x, for x of -9 to 9.
_AT = np.linspace(-9.0, 9.0, 3601)
_BELOW = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _AT])


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's algorithm; one that loses its rows stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()  # the sample is in the order of a hash
    for _ in range(PASSES):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(n)
        c[filled] = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled]) / n[filled, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c * c).sum(axis=1) - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Index:
    """Codebooks of the two halves, and what is known of each cell: its entries, first unit and units."""

    def __init__(self, width: int, single: bool, scale: int, books: tuple[np.ndarray, np.ndarray]):
        self.width, self.single, self.scale, self.books = width, single, scale, books
        self.half, self.k = books[0].shape[1], len(books[0])

    def matrix(self, column) -> np.ndarray:
        """Vectors as rows of `width` doubles, zeros behind shorter ones, by a power of two about 1 at most."""
        raw, ends = flat(column)
        values = raw.view("<f4" if self.single else "<f8")
        lengths = np.diff(ends) // values.itemsize
        out = np.zeros((len(lengths), self.width))
        out[np.arange(self.width) < lengths[:, None]] = values
        return np.ldexp(out, -self.scale)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.half], x[..., self.half :]

    def learn(self, cell: np.ndarray, n: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> None:
        """Sizes and residuals of the cells that have entries; deals cells to units in their order."""
        k = self.k
        self.size = np.zeros(k * k, np.int64)
        self.size[cell] = n
        rows = [np.bincount(at, n, k) for at in (cell // k, cell % k)]
        self.spread = [np.bincount(at, r, k) / np.maximum(m, 1) for at, r, m in zip((cell // k, cell % k), (r1, r2), rows, strict=True)]
        self.parts = np.maximum(1, -(-self.size // UNIT))
        large = self.parts > 1
        before = np.cumsum(np.where(large, 0, self.size)) - np.where(large, 0, self.size)
        small = before // UNIT  # of cells that share units; larger ones have their own behind these
        self.unit = np.where(large, (small[-1] + 1) + np.cumsum(np.where(large, self.parts, 0)) - self.parts, small).astype(np.int64)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of one vector's halves to the centroids."""
        return tuple(((c - h) ** 2).sum(axis=1) for c, h in zip(self.books, self.halves(q), strict=True))

    def shortlist(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Cells with entries, by the sum of distances from a heap, until they have SHORTLIST of them."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        heap, found, entries, k = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], 0, self.k
        while heap and entries < SHORTLIST:
            _, i, j = heapq.heappop(heap)
            cell = int(o1[i]) * k + int(o2[j])
            if self.size[cell]:
                found.append(cell)
                entries += int(self.size[cell])
            if j + 1 < k:
                heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
        return np.array(found, np.int64)

    def remaining(self, d1: np.ndarray, d2: np.ndarray, bound: float) -> np.ndarray:
        """Cells beyond the shortlist, without those that are expected to hold MISSED entries nearer than bound in all."""
        seen = self.shortlist(d1, d2)
        cells = np.flatnonzero(self.size)
        cells = cells[~np.isin(cells, seen)]
        if not math.isfinite(bound):
            return cells
        i, j = cells // self.k, cells % self.k
        v1, v2 = (s / max(1, c.shape[1]) for s, c in zip(self.spread, self.books, strict=True))
        mean = d1[i] + self.spread[0][i] + d2[j] + self.spread[1][j]
        # of |c + r - q|^2 = |c - q|^2 + 2 (c - q) r + |r|^2 with residuals r alike in all directions
        sd = np.sqrt(4 * (d1[i] * v1[i] + d2[j] * v2[j]) + 2 * (self.half * v1[i] ** 2 + (self.width - self.half) * v2[j] ** 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(sd > 0, (bound * bound - mean) / sd, np.where(mean <= bound * bound, 9.0, -9.0))
        nearer = self.size[cells] * np.interp(z, _AT, _BELOW)
        order = np.argsort(nearer, kind="stable")
        return cells[order[np.cumsum(nearer[order]) > MISSED]]


def fit(vectors: DataFrame, single: bool) -> Index | None:
    """The index's codebooks, from at most SAMPLE_ROWS and SAMPLE_BYTES of the distinct vectors; None without any."""
    shape = vectors.agg(F.count("*").alias("n"), F.max("d").alias("width"), F.max("most").alias("most")).first()
    if not shape["n"]:
        return None
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * shape["width"])))
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(rows).toArrow()
    k = int(max(1, min(MOST_CENTROIDS, 2 ** round(math.log2(math.sqrt(shape["n"] / 4) + 1)), sample.num_rows)))
    half = (shape["width"] + 1) // 2
    index = Index(shape["width"], single, math.frexp(shape["most"])[1], (np.zeros((k, half)), np.zeros((k, shape["width"] - half))))
    index.books = tuple(centroids(h, k) for h in index.halves(index.matrix(sample.column("v").combine_chunks())))
    return index


def _distance(x: np.ndarray, q: np.ndarray, scale: int) -> np.ndarray:
    """Euclidean distances of rows in their own units; what can't be squared there is squared as it is scaled."""
    within = scale if -400 < scale < 400 else 0
    diff = np.ldexp(x - q, within)
    return np.ldexp(np.sqrt((diff * diff).sum(axis=1)), scale - within)


def neighbours(rows: DataFrame, asked, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of (vec_id, embedding) of which `asked`, a Column, is true.

    Nearest first by Euclidean distance in double precision of the original vectors, ties to the smaller vec_id; all
    candidates where they are fewer than k. A query's candidates are all rows but itself, of its own width. Vectors that
    are null, empty, zero or have a component that is null or not finite, and rows without vec_id, take no part. Repeated
    rows of an id and vector are one; an id with several vectors is a query and a candidate with each. Other columns
    aren't read; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    fine = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked")).filter(fine).distinct()
    # each task keeps k + 1 ids of a vector before they are shuffled: its own and those that its neighbours need
    first = F.row_number().over(Window.partitionBy("embedding", "asked").orderBy("vec_id"))
    least = source.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("embedding").agg(F.bool_or("asked").alias("asked"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    most = F.array_max(F.transform("embedding", F.abs)).cast("double")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("embedding")
            values = v.flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8") + 0.0
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
            blobs = pa.array([values[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("asked"), b.column("ids"), pa.array(np.diff(ends)), b.column("most"), b.column("embedding"), blobs], ["node", "asked", "ids", "d", "most", "embedding", "v"])

    kind = dict(source.dtypes)["embedding"]
    vectors = least.withColumn("most", most).withColumn("node", F.monotonically_increasing_id()).mapInArrow(packed, f"node long, asked boolean, ids array<long>, d long, most double, embedding {kind}, v binary")
    vectors = written(vectors, "entries", few=rows)
    index = fit(vectors, single)
    if index is None:
        release(vectors)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(index)  # two codebooks of MOST_CENTROIDS halves at most

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = books.value
        for b in rows_of(batches, 4096):
            parts = ix.halves(ix.matrix(b.column("v")))
            at = [nearest(x, c) for x, c in zip(parts, ix.books, strict=True)]
            left = [((x - c[a]) ** 2).sum(axis=1) for x, c, a in zip(parts, ix.books, at, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[0] * ix.k + at[1]), *map(pa.array, left)], [*b.schema.names, "cell", "r1", "r2"])

    cells = vectors.select("node", "asked", "ids", "d", "v").mapInArrow(to_cells, "node long, asked boolean, ids array<long>, d long, v binary, cell long, r1 double, r2 double")
    cells = written(cells, "cells", few=rows)
    sums = cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")).orderBy("cell").toArrow()
    index.learn(*(sums.column(c).to_numpy() for c in ("cell", "n", "r1", "r2")))
    filled = spark.sparkContext.broadcast(index)  # and five numbers for each cell, MOST_CENTROIDS ** 2 at most

    visit = "unit long, side int, node long, d long, v binary, ids array<long>, cell long, cells array<int>, bound double"

    def to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = filled.value
        for b in batches:
            cell, node, n = b.column("cell").to_numpy(), b.column("node").to_numpy(), b.num_rows
            unit = ix.unit[cell] + node % ix.parts[cell]
            arrays = [pa.array(unit), pa.array(np.zeros(n, np.int32)), b.column("node"), b.column("d"), b.column("v"), b.column("ids"), b.column("cell"), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in visit.split(", ")])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries at the units of their cells: of the shortlist, or where a bound is known of the rest."""
        ix = filled.value
        for b in rows_of(batches, 64):
            bounds = b.column("bound").to_pylist()
            out: list[tuple] = []
            for r, q in enumerate(ix.matrix(b.column("v"))):
                d1, d2 = ix.distances(q)
                cells_ = ix.shortlist(d1, d2) if bounds[r] is None else ix.remaining(d1, d2, math.ldexp(bounds[r], -ix.scale))
                several = ix.parts[cells_]
                cell = np.repeat(cells_, several)
                unit = np.repeat(ix.unit[cells_], several) + np.arange(len(cell)) - np.repeat(np.cumsum(several) - several, several)
                order = np.argsort(unit, kind="stable")
                units, starts = np.unique(unit[order], return_index=True)
                out += [(r, u, c.astype(np.int32)) for u, c in zip(units.tolist(), np.split(cell[order], starts[1:]), strict=True)] if len(cell) else []
            at = pa.array([r for r, _, _ in out], pa.int64())
            n = len(out)
            part = b.take(at)
            arrays = [pa.array([u for _, u, _ in out], pa.int64()), pa.array(np.ones(n, np.int32)), part.column("node"), part.column("d"), part.column("v"), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.array([c for _, _, c in out], pa.list_(pa.int32())), part.column("bound")]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in visit.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 nearest (query, vec_id, score) of each query in each unit; a unit's entries come before its queries."""
        ix, held, unit, ready = filled.value, [], None, None
        for batch in rows_of(batches, 512):
            units, sides = batch.column("unit").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (units[1:] != units[:-1]) | (sides[1:] != sides[:-1]), [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if units[a] != unit:
                    held, unit, ready = [], units[a], None
                if sides[a] == 0:
                    held.append(part.select(["d", "v", "ids", "cell"]))
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held)
                    x = ix.matrix(table.column("v").combine_chunks())
                    ready = x, (x * x).sum(axis=1), table.column("cell").to_numpy(), table.column("d").to_numpy(), table.column("ids").to_pylist()
                yield from _best(ix, part, *ready, k)

    best = "node long, vec_id long, score double"

    def searched(queries: DataFrame) -> DataFrame:
        entries = cells.select("node", "d", "v", "ids", "cell").mapInArrow(to_units, visit)
        both = entries.unionByName(queries.mapInArrow(visits, visit)).repartition("unit").sortWithinPartitions("unit", "side")
        found = both.mapInArrow(scan, best)
        place = F.row_number().over(Window.partitionBy("node").orderBy("score", "vec_id"))
        return found.withColumn("place", place).filter(F.col("place") <= k + 1)

    queries = cells.filter("asked").select("node", "d", "v")
    round1 = written(searched(queries.withColumn("bound", F.lit(None).cast("double"))), "first", few=rows)
    bounds = round1.filter(F.col("place") == k + 1).select("node", F.col("score").alias("bound"))
    bounded = queries.join(bounds, "node", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    round2 = written(searched(bounded), "second", few=rows)
    release(cells)
    place = F.row_number().over(Window.partitionBy("node").orderBy("score", "vec_id"))
    both = round1.unionByName(round2).withColumn("place", place).filter(F.col("place") <= k + 1)
    lists = both.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))  # k + 1 at most
    named = vectors.filter("asked").select("node", "embedding").join(lists, "node")
    own = F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id"))
    out = source.filter("asked").select(F.col("vec_id").alias("query_id"), "embedding").join(named, "embedding")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x != own), 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _best(ix: Index, part: pa.RecordBatch, x: np.ndarray, norms: np.ndarray, cell: np.ndarray, dims: np.ndarray, ids: list, k: int) -> Iterator[pa.RecordBatch]:
    q = ix.matrix(part.column("v"))
    square = (q * q).sum(axis=1)[:, None] + norms - 2 * q @ x.T
    nodes, widths, bounds = (part.column(c).to_pylist() for c in ("node", "d", "bound"))
    out: list[tuple] = []
    for r, wanted in enumerate(part.column("cells").to_numpy(zero_copy_only=False)):
        rows = np.flatnonzero(np.isin(cell, wanted) & (dims == widths[r]))
        near = square[r, rows]
        slack = 1e-12 * (1 + norms.max(initial=0.0))
        if len(rows) > k + 1:
            rows = rows[near <= np.partition(near, k)[k] + slack]
        score = _distance(x[rows], q[r], ix.scale)
        if bounds[r] is not None:
            fits = score <= bounds[r]
            rows, score = rows[fits], score[fits]
        hits = sorted((s, i) for s, row in zip(score.tolist(), rows.tolist(), strict=True) for i in ids[row])[: k + 1]
        out += [(nodes[r], i, s) for s, i in hits]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["node", "vec_id", "score"])


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
