"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at a cosine of at least t are at a distance of at most eps = sqrt(2 - 2t). Vectors are sorted by their
cells, eps wide, on the leading principal dimensions; the sequence is cut into blocks, and pairs of intervals of
the sequence are joined recursively, skipping those whose boxes in these dimensions are further apart than eps.
The principal dimensions are orthonormal, so a distance in them is never more than the whole one: nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_groups, written
from .components import connected_components
from .kernel import flat

LEADING = 6  # principal dimensions of the grid
BLOCK = 2048  # vectors of a block: a task joins two blocks
LEAF = 128  # vectors of an interval that is compared outright
COVARIANCE_DIMS = 256  # of wider vectors the first so many take part in the principal dimensions


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of dims doubles, each scaled by a power of two so that its largest component is about 1: products don't overflow."""
    raw = flat(column)[0]
    x = raw.view("<f4" if len(raw) == 4 * dims * len(column) else "<f8").reshape(-1, dims).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _by_width(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each width of vectors an orthonormal basis (width x LEADING) of the directions of most variance of the unit vectors.

    Sums over all rows, partial in each task; what reaches the driver has the square of COVARIANCE_DIMS numbers at most for a width.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("d").to_numpy()
            for d, rows in _by_width(dims):
                x = _matrix(b.column("v").take(pa.array(rows)), d)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                x = np.concatenate([np.ones((len(x), 1)), x[:, :COVARIANCE_DIMS]], axis=1)
                totals[d] = totals.get(d, 0) + x.T @ x
        for d, t in totals.items():
            i, j = np.indices(t.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(t.ravel())], ["d", "i", "j", "s"])

    found: dict[int, np.ndarray] = {}
    for r in vectors.select("d", "v").mapInArrow(sums, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect():
        m = min(r["d"], COVARIANCE_DIMS) + 1
        found.setdefault(r["d"], np.zeros((m, m)))[r["i"], r["j"]] = r["s"]
    out = {}
    for d, t in found.items():
        n, mean = t[0, 0], t[0, 1:] / t[0, 0]
        _, axes = np.linalg.eigh(t[1:, 1:] / n - np.outer(mean, mean))
        basis = np.zeros((d, LEADING))
        lead = axes[:, ::-1][:, :LEADING]
        basis[: len(lead), : lead.shape[1]] = lead
        out[d] = basis
    return out


def _pairs(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of rows with a cosine of at least threshold; i < j if same. Rows are in grid order."""
    nx, ny = (np.sqrt((m * m).sum(axis=1)) for m in (x, y))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def box(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p.min(axis=0), p.max(axis=0)

    def join(a: int, b: int, c: int, d: int) -> None:
        (lo1, hi1), (lo2, hi2) = box(px[a:b]), box(py[c:d])
        gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
        if gap @ gap > eps * eps:
            return
        if b - a <= LEAF and d - c <= LEAF:
            dot = x[a:b] @ y[c:d].T
            i, j = np.nonzero(dot >= (threshold - 1e-9) * nx[a:b, None] * ny[None, c:d])
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            # near the threshold the last digits of a product of matrices don't decide
            cos = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
            found.append((i[cos >= threshold], j[cos >= threshold]))
            return
        cuts_x = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        cuts_y = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        for e, f in cuts_x:
            for g, h in cuts_y:
                if not same or e < h:
                    join(e, f, g, h)

    join(0, len(x), 0, len(y))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _stars(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Least reachable node of each of n nodes by the links (p, q)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cosine_components(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors of equal, non-null label and equal width are linked when their cosine in double precision is at least
    threshold. A vector that is null, empty, zero or has a component that is null or not finite, or whose label is
    null, is linked with nothing: 0 links, its own component, kept. n_links counts other rows, copies too.
    component_id is the least vec_id that links reach. Equal vectors of a label are compared as one that counts
    for all; no pairs are listed: tasks return sums of links and stars. Repeated rows are vectors of their own;
    other columns are not read; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7)
    fine = F.col("label").isNotNull() & F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"  # others are compared as doubles
    source = rows.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), "label").withColumn("fine", F.coalesce(fine, F.lit(False)))
    equal = F.xxhash64("label", "embedding")
    distinct = source.filter("fine").groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("embedding")
            flat_values = v.flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8")
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
            blobs = [flat_values[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), b.column("weight"), pa.array(np.diff(ends)), pa.array(blobs, pa.binary())], ["key", "label", "weight", "d", "v"])

    label_type = dict(source.dtypes)["label"]
    keyed = distinct.select(equal.alias("key"), "label", "weight", "embedding").mapInArrow(packed, f"key long, label {label_type}, weight long, d long, v binary")
    vectors = written(keyed, "vectors", few=rows)
    bases = spark.sparkContext.broadcast(principal(vectors))  # LEADING numbers for each component of a width

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.zeros((b.num_rows, LEADING))
            for d, rows_ in _by_width(b.column("d").to_numpy()):
                x = _matrix(b.column("v").take(pa.array(rows_)), d)
                at[rows_] = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ bases.value[d]
            cell = np.floor(at / eps).astype(np.int64)
            arrays = [*b.columns, *(pa.array(cell[:, k]) for k in range(LEADING)), *(pa.array(at[:, k]) for k in range(LEADING))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, *(f"c{k}" for k in range(LEADING)), *(f"p{k}" for k in range(LEADING))])

    extra = "".join(f", c{k} long" for k in range(LEADING)) + "".join(f", p{k} double" for k in range(LEADING))
    gridded = vectors.mapInArrow(cells, f"key long, label {label_type}, weight long, d long, v binary{extra}")
    order = ["label", "d", *(f"c{k}" for k in range(LEADING)), "key"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, last = TaskContext.get().partitionId() << 32, BLOCK, None
        for b in batches:
            ids = []
            for kind in zip(b.column("label").to_pylist(), b.column("d").to_pylist(), strict=True):
                if kind != last or filled == BLOCK:
                    block, filled, last = block + 1, 0, kind
                filled += 1
                ids.append(block)
            yield b.append_column("block", pa.array(ids, pa.int64()))

    grid = gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    grid = written(grid.mapInArrow(blocks, f"key long, label {label_type}, weight long, d long, v binary{extra}, block long"), "grid")
    boxes = grid.groupBy("label", "d", "block").agg(*[f(f"p{k}").alias(f"{n}{k}") for k in range(LEADING) for n, f in (("lo", F.min), ("hi", F.max))])
    # intervals meet where they have a cell of the first dimension in common or next to each other
    boxes = boxes.withColumn("cell", F.explode(F.expr(f"sequence(cast(floor(lo0 / {eps!r}) as long), cast(floor(hi0 / {eps!r}) as long) + 1)")))
    a, b = (boxes.select(*[F.col(c).alias(f"{s}_{c}" if c not in ("label", "d", "cell") else c) for c in boxes.columns]) for s in "ab")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")), F.lit(2.0)) for k in range(LEADING)), F.lit(0.0))
    tasks = a.join(b, ["label", "d", "cell"]).filter((F.col("a_block") <= F.col("b_block")) & (gap <= eps * eps)).select("a_block", "b_block").distinct()
    tasks = tasks.select(F.col("a_block"), F.col("b_block"), F.explode(F.expr("case when a_block = b_block then array(0) else array(0, 1) end")).alias("side"))
    members = grid.join(tasks.withColumn("block", F.expr("case when side = 0 then a_block else b_block end")), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["a_block", "b_block"], 1):
            a_block, b_block, side, key, weight, dims = (table.column(c).to_numpy() for c in ("a_block", "b_block", "side", "key", "weight", "d"))
            cuts = np.flatnonzero(np.concatenate([[True], (a_block[1:] != a_block[:-1]) | (b_block[1:] != b_block[:-1]), [True]]))
            grid_at = np.stack([table.column(f"p{k}").to_numpy() for k in range(LEADING)], axis=1)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                x = _matrix(table.column("v").combine_chunks().slice(i, j - i), int(dims[i]))
                mid = int((side[i:j] == 0).sum())
                same, at = a_block[i] == b_block[i], grid_at[i:j]
                p, q = _pairs(x[:mid], at[:mid], x if same else x[mid:], at if same else at[mid:], same, threshold, eps)
                q = q if same else q + mid
                n, w = j - i, weight[i:j]
                links = np.bincount(p, w[q], n) + np.bincount(q, w[p], n)
                root = _stars(p, q, n)
                own, hit = np.flatnonzero(root != np.arange(n)), np.flatnonzero(links)
                k = key[i:j]
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([k[hit], k[own]])), pa.array([None] * len(hit) + k[root[own]].tolist(), pa.int64()), pa.array(np.concatenate([links[hit], np.zeros(len(own))]).astype(np.int64))],
                        ["a", "b", "links"],
                    )

    deal = ["a_block", "b_block", "side", *order[2:]]
    found = members.select(*deal, "weight", "d", "v", *[f"p{k}" for k in range(LEADING)]).repartition("a_block", "b_block").sortWithinPartitions(*deal)
    found = written(found.mapInArrow(run, "a long, b long, links long"), "found")
    links = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    parts_ = connected_components(found.filter("b is not null")).select(F.col("node").alias("key"), "component")
    kinds = distinct.select(equal.alias("key"), "weight", "least").join(links, "key", "left").join(parts_, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = kinds.groupBy("component").agg(F.min("least").alias("component_id"))
    kinds = kinds.join(least, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    out = source.select("vec_id", F.when(F.col("fine"), equal).alias("key")).join(kinds, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r(node, seen) AS (
  SELECT a, b FROM l
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (SELECT node, min(seen) AS least FROM r GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.node
"""
