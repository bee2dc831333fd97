"""N-gram Jaccard join: texts whose sets of word shingles are alike, by count vectors in an R-tree.

Shingle hashes are dealt into groups; the group counts of a text are a point. The overlap of two texts is at
most the sum of the coordinate minima of their points, and of two boxes of points at most the sum of the minima
of their upper corners, which prunes the tree join. Pairs that survive are verified on the sets. Counts of some four
hashes a group tell unlike texts apart, so a larger set has more groups, a power of 2; points of different lengths meet
at the shorter one's, the longer one's neighbouring groups being added up.

What meets in one tree is found exactly by the same idea of token groups: two sets with a Jaccard index of at
least t differ in at most D = floor(min size * (1 - t) / t) tokens, so of G > D + E groups of the tokens more than
E agree wholly. A text with at most E empty groups thus shares a non-empty group with each of its partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, lean, release, sliced, text_key, whole_groups, written
from .components import connected_components
from .kernel import U, flat, mix, shingles

DIMS, MOST_DIMS = 128, 16_384  # dimensions of a count vector, powers of 2
LEAF = 32  # points in a leaf of the R-tree and children of a node
CAP = 1024  # points of a signature that one task takes; the members of a larger group are compared with its pivot first
TEXTS = 1024  # texts of a component that one task verifies
SHINGLES = 1 << 20  # and their shingles


class SizeClasses:
    """Classes of set sizes so that partners are in the same or in the next class, with D and the number of groups of each."""

    def __init__(self, num: int, den: int):
        lows = [1]
        while lows[-1] < 1 << 31:
            lows.append(max(lows[-1] + 1, lows[-1] * den // num + 1))
        self.lows = np.array(lows)
        self.differ = (self.lows[1:] - 1) * (den - num) // num
        self.empty = np.ceil(0.06 * self.differ).astype(np.int64) + 2
        self.groups = self.differ + 1 + self.empty

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, side="right") - 1


def signatures(tokens: np.ndarray, at: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes, text of each): one for each token group of the text's class and of the class below."""
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    deal, add = mix(tokens ^ U(0x5851F42D4C957F2D)) >> U(1), mix(tokens ^ U(0x14057B7EF767814F))
    found, texts = [], []
    for below in (0, 1):
        c = classes.of(np.maximum(sizes, 1)) - below
        used = (c >= 0) & (sizes > 0)
        used &= classes.differ[np.maximum(c, 0)] > 0
        g = np.where(used, classes.groups[np.maximum(c, 0)], 0)
        base = np.concatenate([[0], np.cumsum(g)])
        tok = used[doc]
        if not tok.any():
            continue
        key = base[doc[tok]] + (deal[tok] % g[doc[tok]].astype(np.uint64)).astype(np.int64)
        n = int(base[-1])
        count = np.bincount(key, minlength=n)
        low = np.bincount(key, (add[tok] & U(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
        high = np.bincount(key, (add[tok] >> U(32)).astype(float), n).astype(np.uint64)
        of = np.repeat(np.arange(len(sizes)), g)
        spare = np.bincount(of, count == 0, len(sizes))
        kept = (count > 0) | (spare > classes.empty[np.maximum(c, 0)])[of]
        sig = mix(low + (high << U(32)) ^ mix((np.maximum(c, 0)[of].astype(np.uint64) << U(32)) + (np.arange(n) - base[of]).astype(np.uint64)))
        found.append(sig[kept])
        texts.append(of[kept])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, texts = np.concatenate(found), np.concatenate(texts)
    order = np.argsort(texts, kind="stable")
    return found[order], texts[order]


def vectors(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The point of each set: counts of its tokens by their leading bits."""
    sizes = np.diff(at)
    bits = np.clip(np.floor(np.log2(np.maximum(sizes, 1) / 4)), np.log2(DIMS), np.log2(MOST_DIMS)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(1 << bits)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = ends[:-1][doc] + (tokens >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(place, minlength=int(ends[-1])).astype("<u4")
    return [counts[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Points:
    """The points of a table's rows, which are seen at DIMS dimensions, or those of a group at as many as all of it have."""

    def __init__(self, table: pa.Table):
        data, ends = flat(table.column("vec"))
        self.data, self.ends = data.view("<u4").view(np.int32), ends // 4
        self.dims = np.diff(self.ends)
        self.low = np.zeros((len(self.dims), DIMS), np.int32)
        for d in np.unique(self.dims).tolist():
            rows = np.flatnonzero(self.dims == d)
            self.low[rows] = self.data[self.ends[:-1][rows, None] + np.arange(d)].reshape(len(rows), DIMS, d // DIMS).sum(axis=2)

    def of(self, rows: np.ndarray) -> np.ndarray:
        d = int(self.dims[rows].min(initial=MOST_DIMS))
        if d == DIMS or not len(rows):
            return self.low[rows]
        return np.stack([self.data[self.ends[r] : self.ends[r + 1]].reshape(d, -1).sum(axis=1) for r in rows.tolist()])


def set_keys(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; that of an empty set is 0."""
    total = np.concatenate([[U(0)], np.cumsum(mix(tokens ^ U(0xA0761D6478BD642F)), dtype=np.uint64)])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mix((total[at[1:]] - total[at[:-1]]) ^ mix(n)) | U(1), U(0))


class RTree:
    """A packed R-tree over count vectors: sorted by size and leading dimensions, LEAF children to a node.

    A node has the largest coordinates and the least size below it: what the bound needs.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points[:, :4].T[::-1], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            top, least = self.levels[-1]
            cuts = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)))

    @staticmethod
    def _pass(a: tuple, b: tuple, num: int, den: int) -> np.ndarray:
        """Which boxes of a may hold a partner of which of b: overlap bound * (num + den) >= num * (size + size)."""
        bound = np.minimum(a[0][:, None, :], b[0][None, :, :]).sum(axis=2, dtype=np.int64)
        return bound * (num + den) >= num * (a[1][:, None] + b[1][None, :])

    def join(self, other: RTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (i, j) of pairs of points, by leaf pairs, that pass the bound; with itself, i < j in tree order."""
        same = self is other
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            la, i, lb, j = stack.pop()
            if la == 0 and lb == 0:
                if not same or i < j:
                    yield np.array([i]), np.array([j])
                continue
            down_a, down_b = (la >= lb, lb >= la) if la != lb else (True, True)
            ia = np.arange(i * LEAF, min((i + 1) * LEAF, len(self.levels[la - 1][0]))) if down_a else np.array([i])
            ib = np.arange(j * LEAF, min((j + 1) * LEAF, len(other.levels[lb - 1][0]))) if down_b else np.array([j])
            na, nb = la - down_a, lb - down_b
            x, y = self.levels[na], other.levels[nb]
            hit = self._pass((x[0][ia], x[1][ia]), (y[0][ib], y[1][ib]), num, den)
            p, q = np.nonzero(hit)
            p, q = ia[p], ib[q]
            if same and na == nb:
                keep = p < q if na == 0 else p <= q
                p, q = p[keep], q[keep]
            if na == 0 and nb == 0:
                if len(p):
                    yield p, q
            else:
                stack.extend((na, int(u), nb, int(v)) for u, v in zip(p, q, strict=True))


class Forest:
    """Union-find with an array of roots, so that whole arrays of pairs are seen to be connected at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.up[i] != self.up[j])

    def root(self, i: int) -> int:
        while self.up[i] != i:
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def settle(self) -> None:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]


def _links(side: np.ndarray, split: bool, points: np.ndarray, sizes: np.ndarray, num: int, den: int, verify=None, joined: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a task that pass the bound and verify(i, j); between the sides if split.

    A pair whose ends are already connected, by links or as rows of one of the joined sets, isn't looked at again.
    """
    forest, out = Forest(len(sizes)), []
    for same in joined or []:
        for x in same[1:].tolist():
            forest.join(int(same[0]), x)
    forest.settle()
    rows = [np.flatnonzero(side == s) for s in (0, 1)] if split else [np.arange(len(sizes))] * 2
    if not len(rows[0]) or not len(rows[1]):
        return out
    a = RTree(points[rows[0]], sizes[rows[0]])
    b = RTree(points[rows[1]], sizes[rows[1]]) if split else a
    for p, q in a.join(b, num, den):
        i, j = rows[0][a.order[p]], rows[1][b.order[q]]
        new = forest.apart(i, j)
        before = len(out)
        for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
            if forest.root(x) != forest.root(y) and (verify is None or verify(x, y)):
                forest.join(x, y)
                out.append((x, y))
        if len(out) > before:
            forest.settle()
    return out


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, class, tk) of every row: texts are linked when den * |A & B| >= num * |A | B|.

    Shingles are `words` words in a row, A-Z lower-cased; fewer words are one shingle; null, empty and blank texts
    have none and are linked with nothing, so each is a component of its own. component_id is the least doc_id that
    links reach, of a row whose component has only null ids its own null. class is
    a key of the component, null for texts without shingles; tk is the row's text_key. Repeated rows
    and equal texts are linked; other columns are not read; an empty table gives an empty one.

    Copies meet once: from the first pass on a set stands for all texts that have it. No step lists the pairs of a
    group: tasks return spanning forests of links; in groups of more than CAP points, and in verification, members are
    compared with their group's pivot first (_connected).
    """
    classes = SizeClasses(num, den)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            tokens, at = shingles(*flat(b.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tk"), pa.array(np.diff(at)), pa.array(set_keys(tokens, at).view(np.int64)), pa.array(vectors(tokens, at), pa.binary())],
                ["doc_id", "tk", "n", "set_key", "vec"],
            )

    def signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task signs a set once
        for b in sliced(batches, "text"):
            tokens, at = shingles(*flat(b.column("text")), words)
            keys = set_keys(tokens, at)
            sig, of = signatures(tokens, at, classes)
            new = np.array([not (k in seen or seen.add(k)) for k in keys.tolist()], bool)[of]
            for i in range(0, len(sig), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)][new[i : i + (1 << 17)]].view(np.int64)) for x in (sig, keys[of])], ["sig", "set_key"])

    id_type = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", "text", text_key().alias("tk"))
    rows = written(source.mapInArrow(lean(sets), f"doc_id {id_type}, tk long, n long, set_key long, vec binary"), "sets", few=docs)
    kinds_table = written(rows.filter("n > 0").groupBy("set_key").agg(F.min(F.struct("tk", F.col("doc_id").isNull(), "doc_id")).alias("one"), F.first("n").alias("n"), F.first("vec").alias("vec")), "kinds", few=docs)
    kinds = kinds_table.select("set_key", "one.tk", F.col("one.doc_id").alias("one"), "n", "vec")
    # Signatures, many times the sets, are shuffled once and not written: sorted by signature, those of several sets stay.
    signed = docs.select("text").mapInArrow(lean(signed_sets), "sig long, set_key long")
    by_key, whole = Window.partitionBy("sig").orderBy("set_key"), Window.partitionBy("sig")
    first = signed.withColumn("new", F.coalesce(F.lag("set_key").over(by_key) != F.col("set_key"), F.lit(True)))
    mixed = lambda *salt: F.bit_xor(F.when(F.col("new"), F.xxhash64("set_key", *salt))).over(whole)
    several = first.withColumn("members", F.count_if("new").over(whole)).withColumn("m1", mixed()).withColumn("m2", mixed(F.lit(1))).filter("new and members > 1").drop("new")
    several = written(several, "signed")
    # near copies share most of their signatures: each set of members meets in one tree
    trees = several.groupBy("members", "m1", "m2").agg(F.min("sig").alias("sig")).select("sig")
    members = several.select("sig", "set_key", "members").join(trees, "sig").join(kinds.select("set_key", "n", "vec"), "set_key")
    near = _task_links(members.filter(F.col("members") <= CAP), "sig", num, den)
    large = several.filter(F.col("members") > CAP)
    if not large.isEmpty():
        large = written(members.filter(F.col("members") > CAP).select("sig", "set_key", "n", "vec"), "large")
        near = near.unionByName(_connected(large, "sig", CAP, num, den, None))
    near = written(near, "near")
    release(several)
    coarse_table = written(connected_components(near), "coarse", few=docs)
    release(near)
    links = _verified(docs, coarse_table, kinds, num, den, words)
    found = connected_components(links)
    release(kinds_table, coarse_table)
    least = rows.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least")).join(found.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    least = least.withColumn("class", F.coalesce("component", "set_key"))
    classes_ = least.groupBy("class").agg(F.min("least").alias("component_id"))
    of_set = written(least.select("set_key", "class").join(classes_, "class"), "classes", few=docs)  # a row for each set: what rows join is without heavy keys on this side
    out = rows.select("doc_id", "n", "set_key", "tk").join(of_set, "set_key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", "tk")
    out = written(out, "members", few=docs)
    release(rows, of_set)
    return out


def _sets_of(column: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of many texts, a slice at a time: its arrays take some sixty times the room of the bytes."""
    tokens, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for b in sliced(pa.Table.from_arrays([column], ["text"]).to_batches(), "text"):
        found, at = shingles(*flat(b.column("text")), words)
        tokens.append(found)
        sizes.append(np.diff(at))
    return np.concatenate(tokens), np.cumsum(np.concatenate(sizes))


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of the keys begin in sorted rows, and the end."""
    task = np.stack([table.column(c).to_numpy() for c in keys])
    return np.flatnonzero(np.concatenate([[True], (task[:, 1:] != task[:, :-1]).any(axis=0), [True]]))


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _task_links(members: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """Links (a, b) of set keys that pass the bound, as the tree join of each group of a key finds them; two points need no tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [key], 2048):
            cuts, points = _cuts(table, [key]), Points(table)
            ident, sizes = (table.column(c).to_numpy() for c in ("set_key", "n"))
            i = cuts[:-1][np.flatnonzero(np.diff(cuts) == 2)]
            j = i + 1
            ok = (ident[i] != ident[j]) & (np.minimum(points.low[i], points.low[j]).sum(axis=1) * (num + den) >= num * (sizes[i] + sizes[j]))
            for k in np.flatnonzero(ok & (np.minimum(points.dims[i], points.dims[j]) > DIMS)).tolist():
                ok[k] = points.of(np.array([i[k], j[k]])).min(axis=0).sum() * (num + den) >= num * (sizes[i[k]] + sizes[j[k]])
            a, b = ident[i[ok]].tolist(), ident[j[ok]].tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j - i > 2:
                    _, one = np.unique(ident[i:j], return_index=True)  # copies of a text bring its set again
                    one += i
                    for p, q in _links(np.zeros(len(one)), False, points.of(one), sizes[one], num, den):
                        a.append(int(ident[one[p]]))
                        b.append(int(ident[one[q]]))
            if a:
                yield _pairs(a, b)

    return members.repartition(key).sortWithinPartitions(key).mapInArrow(lean(run), "a long, b long")


def _verified(docs: DataFrame, coarse: DataFrame, kinds: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Links (a, b) of set keys, verified on the texts' sets, that connect what any links between members of a coarse component (node, component) connect."""
    sized = coarse.join(kinds.select(F.col("set_key").alias("node"), "tk", "one", "n", "vec"), "node").withColumnRenamed("node", "set_key")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("tk"))
    full = sized.join(texts, "tk").filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("component", "set_key", "n", "vec", "text")
    full = written(full, "candidates")
    if not full.groupBy("set_key").count().filter("count > 1").isEmpty():  # repeated rows, with their ids
        again, full = full, written(full.dropDuplicates(["set_key"]), "candidates")
        release(again)
    return _connected(full, "component", TEXTS, num, den, words)


def _connected(full: DataFrame, key: str, most: int, num: int, den: int, words: int | None) -> DataFrame:
    """Links (a, b) that connect what any links between members of a group of the key connect, of full (key, set_key, n, vec, with words text), a written table that goes.

    Links pass the bound, and with words hold on the texts' sets. Every member is compared with its group's pivot, the member of
    the least key, in tasks of some `most` members, or SHINGLES shingles, each. Near copies of one text all link there, however many. Members that
    don't are compared with all members, by trees, in pairs of blocks; what linked to the pivot counts as connected
    there. So rows are copied by the blocks of unlinked members only.
    """
    text = ["text"] if words else []
    weight = F.ceil(F.greatest(F.count("*") / F.lit(most), *([F.sum("n") / F.lit(SHINGLES)] if words else [F.lit(0.0)]))).cast("int")
    load = written(full.groupBy(key).agg(weight.alias("blocks"), F.min("set_key").alias("pivot")), "load", few=full)
    block = lambda n: F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = full.join(load, key)
    own, first = dealt.filter("set_key <> pivot").withColumn("block", F.array(block("blocks"))), dealt.filter("set_key = pivot").withColumn("block", every("blocks"))
    rows = own.unionByName(first).select(key, F.explode("block").alias("block"), "set_key", "n", "vec", *text, (F.col("set_key") == F.col("pivot")).alias("is_pivot"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [key, "block"], 512):
            ident, size, points, a, b = table.column("set_key").to_numpy(), table.column("n").to_numpy(), Points(table), [], []
            tokens, at = _sets_of(table.column("text"), words) if words else (None, None)
            cuts = _cuts(table, [key, "block"])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # the pivot stands first
                if words:
                    mine = np.isin(tokens[at[i] : at[j]], tokens[at[i] : at[i + 1]])
                    both = np.diff(np.concatenate([[0], np.cumsum(mine)])[at[i : j + 1] - at[i]])
                else:
                    mine = points.of(np.arange(i, j))
                    both = np.minimum(mine[0], mine).sum(axis=1)
                near = np.flatnonzero(both * (num + den) >= num * (size[i:j] + size[i]))[1:] + i
                a += [int(ident[i])] * len(near)
                b += ident[near].tolist()
            if a:
                yield _pairs(a, b)

    near = written(rows.repartition(key, "block").sortWithinPartitions(key, "block", F.col("is_pivot").desc(), "set_key").mapInArrow(lean(stars), "a long, b long"), "stars")
    linked = near.select(F.col("a").alias("pivot"), F.col("b").alias("set_key"), F.lit(True).alias("linked")).distinct()
    marked = dealt.join(linked, ["pivot", "set_key"], "left").withColumn("linked", F.col("linked").isNotNull() | (F.col("set_key") == F.col("pivot")))
    rest = marked.filter("not linked")
    if rest.isEmpty():
        release(load, full)
        return near
    left = written(rest.groupBy(key).agg(weight.alias("left")), "left", few=full)
    of = lambda df, side, x, y: df.join(left, key).select(key, F.explode(x).alias("block_a"), "set_key", "n", "vec", *text, "linked", F.lit(side).alias("side"), y.alias("_b")).withColumn("block_b", F.explode("_b")).drop("_b")
    pairs = of(rest, 0, F.array(block("left")), every("blocks")).unionByName(of(marked, 1, every("left"), F.array(block("blocks"))))
    order = [key, "block_a", "block_b"]

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order, 512):
            cuts, points = _cuts(table, order), Points(table)
            ident, sizes, side = (table.column(c).to_numpy() for c in ("set_key", "n", "side"))
            there = table.column("linked").to_numpy()
            a, b = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                verify = None
                if words:
                    tokens, at = _sets_of(table.column("text").slice(i, j - i), words)

                    def verify(p: int, q: int, tokens=tokens, at=at) -> bool:
                        x, y = tokens[at[p] : at[p + 1]], tokens[at[q] : at[q + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        return den * both >= num * (len(x) + len(y) - both)

                own = ident[i:j]
                by_key = np.argsort(own, kind="stable")
                twice = [by_key[k : k + 2] for k in np.flatnonzero(own[by_key[1:]] == own[by_key[:-1]])]  # a row that is on both sides
                for p, q in _links(side[i:j], True, points.of(np.arange(i, j)), sizes[i:j], num, den, verify, [*twice, np.flatnonzero(there[i:j])]):
                    a.append(int(own[p]))
                    b.append(int(own[q]))
            if a:
                yield _pairs(a, b)

    more = written(pairs.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(trees), "a long, b long"), "links")
    release(load, full, left)
    return near.unionByName(more)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 3, 9, 10).select("doc_id", "n_shingles", "component_id")
