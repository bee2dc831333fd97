"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that start at two places or more.

Where such strings may start is found by anchors: of the ANCHOR-byte strings inside a window of LENGTH bytes the one
with the least hash, the leftmost among equals, is the window's anchor. Equal windows have equal anchors at equal
offsets, so a window can only be repeated if its anchor is. The surroundings of each repeated anchor (a snippet:
all windows that it owns) are sorted with those of its equals as rows aligned at the anchor:

- each shard of the rows has its Burrows-Wheeler transform by columns: for each column the bytes that precede the
  sorted suffixes that start there;
- shards are merged by refining an interleave: a sequence of shard numbers that at first lists the shards one after
  the other. A pass reads each shard's next preceding bytes in the interleave's order and deals the shard
  numbers stably by byte, so that after j passes the interleave is that of the suffixes of j bytes. Suffixes are not
  sorted again;
- neighbours' common prefixes in the merged order, right of the anchor and, on reversed rows, left of it, give
  intervals of rows that agree to any depth. Windows with the anchor at offset o agree where both intervals, of depth
  LENGTH - o and o, do, and are repeated where such an interval stands for two places or more.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, lean, release, rows_of, sliced, text_key, whole_groups, written
from .kernel import U, flat, mix, pieces, powers, prefix_hash, runs

LENGTH = 200  # bytes of a repeated string
ANCHOR = 48  # bytes of an anchor
STEP = 8  # offsets of the windows that a row of a hot anchor keeps
HOT = 8192  # places of an anchor beyond which its rows are split by more of their bytes
SHARD = 4096  # rows of a shard
PIECE = 1 << 18  # bytes of texts whose anchors and snippets are found at a time, some eighty times as many in arrays


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor, first and last start of its windows, hash), places within the text."""
    n, w = len(data), length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    p = prefix_hash(data)
    _, down = powers(n + 1)
    h = mix((p[k:] - p[:-k]) * down[: n - k + 1])
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # equal upper halves: the leftmost
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if w > size:
        least = np.minimum(least[: -(w - size)], least[w - size :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][doc])
    owner = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(start) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(start))[: len(new)] - 1
    text, at = doc[start[new]], owner[new]
    base = offsets[:-1][text]
    return text, at - base, start[new] - base, start[last] - base, h[at]


def shard_bwt(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(preceding bytes of the sorted suffixes by the column they stand in, order of the whole rows)."""
    order = np.arange(len(rows))
    bwt = np.empty(rows.shape[::-1], np.uint8)
    for c in range(rows.shape[1] - 1, -1, -1):
        bwt[c] = rows[order, c]
        order = order[np.argsort(bwt[c], kind="stable")]
    return bwt, order


def merged_order(rows: np.ndarray, group: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Order of the rows by (group, bytes) from the shards' transforms by interleave refinement."""
    parts = [np.arange(i, min(i + shard, len(rows))) for i in range(0, len(rows), shard)]
    done = [shard_bwt(rows[p]) for p in parts]
    if len(parts) == 1:
        order = done[0][1]
        return order[np.argsort(group[order], kind="stable")]
    interleave = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
    preceding = np.empty(len(rows), np.uint8)
    for c in range(rows.shape[1] - 1, -1, -1):
        # a stable sort of the interleave by shard tells where each shard's next bytes go
        preceding[np.argsort(interleave, kind="stable")] = np.concatenate([bwt[c] for bwt, _ in done])
        interleave = interleave[np.argsort(preceding, kind="stable")]
    order = np.empty(len(rows), np.int64)
    order[np.argsort(interleave, kind="stable")] = np.concatenate([p[o] for p, (_, o) in zip(parts, done, strict=True)])
    return order[np.argsort(group[order], kind="stable")]


def common_prefixes(rows: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in the order shares with the one before; -1 where a group begins."""
    out = np.full(len(order), -1, np.int32)
    if len(order) > 1:
        for i in range(1, len(order), 8192):
            differ = rows[order[i : i + 8192]] != rows[order[i - 1 : i + 8191][: len(order[i : i + 8192])]]
            out[i : i + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:][group[order[1:]] != group[order[:-1]]] = -1
    return out


def repeated_windows(snippets: list[np.ndarray], left: np.ndarray, span: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each snippet and window start in it, whether the window stands at two places or more of its group.

    A snippet starts with its first window; the anchor is at left; span + 1 windows are its own.
    """
    n, wide = len(snippets), length - k
    data = np.concatenate(snippets)
    base = np.concatenate([[0], np.cumsum([len(s) for s in snippets])])
    size = np.diff(base)

    def columns(offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(offsets)), np.uint8)
        for i in range(0, n, 2048):  # places take eight times the room of bytes
            rows = slice(i, i + 2048)
            at = left[rows, None] + offsets[None, :]
            inside = (at >= 0) & (at < size[rows, None])
            out[rows][inside] = data[(base[:-1][rows, None] + at)[inside]]
        return out

    right, back = columns(np.arange(length)), columns(-1 - np.arange(wide))
    out = np.zeros((n, wide + 1), bool)
    order_f, order_b = merged_order(right[:, k:], group), merged_order(back, group)
    lcp_f, lcp_b = common_prefixes(right, group, order_f), common_prefixes(back, group, order_b)
    forward, backward = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(wide + 1):  # offset of the anchor in the window
        own = np.flatnonzero((o <= left) & (o >= left - span))
        if not len(own):
            continue
        forward[order_f] = np.cumsum(lcp_f < length - o)
        backward[order_b] = np.cumsum(lcp_b < o)
        _, interval = np.unique(forward[own] * (n + 1) + backward[own], return_inverse=True)
        often = np.bincount(interval, weight[own]) >= 2
        hit = own[often[interval]]
        out[hit, left[hit] - o] = True
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int | None = None) -> DataFrame:
    """(tk, spans): for each text_key the maximal byte ranges [start, end) that repeated strings cover, in order.

    Texts without any aren't listed. All texts take part whole; of equal texts each task counts two, which tells as
    much as all of them. Each step's result is a table in the shared folder, which goes when the next one stands, so
    that the joins are between tables, which Spark can split at hot keys, and their shuffle files don't add up.
    """
    k = k or max(1, length * ANCHOR // LENGTH)
    wide = length - k

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in sliced(batches, "text", 1 << 20):
            # whether a string stands at two places is known from two copies of a text: a task doesn't send more
            kept = []
            for i, tk in enumerate(b.column("tk").to_pylist()):
                seen[tk] += 1
                if seen[tk] <= 2:
                    kept.append(i)
            b = b.take(pa.array(kept, pa.int64())) if len(kept) < b.num_rows else b
            data, offsets = flat(b.column("text"))
            for text, base, part, ends in pieces(data, offsets, PIECE, length - 1):
                of, at, first, last, h = anchors(part, ends, length, k)
                place = ((at + base[of]) << 32) | ((at - first) << 16) | (last - first)
                yield pa.RecordBatch.from_arrays([b.column("tk").take(pa.array(text[of])), pa.array(place), pa.array(h.view(np.int64))], ["tk", "place", "h"])

    long_enough = docs.filter(F.octet_length("text") >= length).select("text", text_key().alias("tk"), "doc_id")
    found = written(long_enough.select("text", "tk").mapInArrow(lean(find), "tk long, place long, h long"), "anchors", few=docs)
    often = written(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "often", few=docs)
    # a place of a text has one anchor: not grouped by h, so that the join may split a hot one
    hits = found.join(often, "h").groupBy("tk", "place").agg(F.first("h").alias("h"), F.count("*").cast("int").alias("copies"), F.first("hot").alias("hot"))
    by_text = hits.groupBy("tk").agg(F.collect_list(F.struct("place", "h", "copies", "hot")).alias("hits"))
    by_text = written(by_text, "hits", few=docs)
    release(found, often)
    one = docs.filter(F.octet_length("text") >= length).groupBy(text_key().alias("tk")).agg(F.min("doc_id").alias("least"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            data, offsets = flat(b.column("text"))
            lists = b.column("hits")
            doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = lists.flatten()
            place, h, copies, hot = (hit.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((place, doc))
            doc, place, h, copies, hot = (x[order] for x in (doc, place, h, copies, hot.astype(bool)))
            at, left, span = place >> 32, (place >> 16) & 0xFFFF, place & 0xFFFF
            begins = offsets[:-1][doc] + at - left  # where the first window of a hit starts: ascending, in steps of a window at most
            for i, j in runs(begins, PIECE):
                lo, hi = max(0, begins[i:j].min() - length), min(len(data), begins[i:j].max() + 3 * length)
                yield from snippets(b.column("tk"), data[lo:hi], offsets[:-1] - lo, doc[i:j], at[i:j], left[i:j], span[i:j], h[i:j], copies[i:j], hot[i:j])

    def snippets(tks: pa.Array, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, span: np.ndarray, h: np.ndarray, copies: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = prefix_hash(data)
        _, down = powers(len(data) + 1)
        if hot.any():
            # rows of STEP windows each; all windows with the anchor at STEP * r ... STEP * r + STEP - 1 share what the new key is of
            low, high = (left - span) // STEP, left // STEP
            times = np.where(hot, high - low + 1, 1)
            of = np.repeat(np.arange(len(at)), times)
            r = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            is_hot = hot[of]
            most = np.where(is_hot, np.minimum(left[of], r * STEP + STEP - 1), left[of])
            least = np.where(is_hot, np.maximum((left - span)[of], r * STEP), (left - span)[of])
            begin = np.where(is_hot, offsets[doc[of]] + at[of] - r * STEP, 0)
            end = np.where(is_hot, begin + length - STEP + 1, 0)
            h = np.where(is_hot, mix((p[end] - p[begin]) * down[begin] + r.astype(np.uint64)), h[of].view(np.uint64)).view(np.int64)
            doc, at, copies, left, span = doc[of], at[of], copies[of], most, most - least
        start = at - left
        begin = offsets[doc] + start
        end = begin + span + length
        shape = (left << 16) | span
        # a snippet that stands at several places of the text is one row
        same = mix((p[end] - p[begin]) * down[begin])
        order = np.lexsort((start, same, shape, h, doc))
        key = np.stack([doc[order], h[order], shape[order], same[order].view(np.int64)])
        new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else order
        ends = np.append(new[1:], len(order))[: len(new)]
        total = np.add.reduceat(copies[order], new) if len(new) else new
        for i in range(0, len(new), 8192):
            n, e = new[i : i + 8192], ends[i : i + 8192]
            one = order[n]
            cuts_ = [data[x:y].tobytes() for x, y in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
            starts = pa.ListArray.from_arrays(pa.array(np.append(n, e[-1]).astype(np.int32) - np.int32(n[0])), pa.array(start[order[n[0] : e[-1]]]))
            yield pa.RecordBatch.from_arrays(
                [tks.take(pa.array(doc[one])), starts, pa.array(h[one]), pa.array(shape[one]), pa.array(total[i : i + 8192].astype(np.int64)), pa.array(cuts_, pa.binary())],
                ["tk", "starts", "h", "shape", "copies", "snippet"],
            )

    texts = docs.filter(F.octet_length("text") >= length).select("doc_id", "text", text_key().alias("tk"))
    texts = texts.join(by_text.join(one, "tk"), "tk").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "tk", "hits")
    cuts = written(texts.mapInArrow(lean(cut), "tk long, starts array<long>, h long, shape long, copies long, snippet binary").withColumn("sid", F.xxhash64("shape", "snippet")), "snippets")
    release(by_text)
    distinct = cuts.groupBy("h", "sid", "shape", "snippet").agg(F.sum("copies").alias("copies"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], 4 * SHARD):
            h, sid, shape, copies = (table.column(c).to_numpy() for c in ("h", "sid", "shape", "copies"))
            data, offsets = flat(table.column("snippet"))
            snippets = [data[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            windows = repeated_windows(snippets, shape >> 16, shape & 0xFFFF, group, copies, length, k)
            any_ = np.flatnonzero(windows.any(axis=1))
            bits = np.packbits(windows[any_], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(h[any_]), pa.array(sid[any_]), pa.array([x.tobytes() for x in bits], pa.binary())], ["h", "sid", "windows"])

    decided = distinct.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(lean(decide), "h long, sid long, windows binary")
    places = cuts.select("tk", "starts", "h", "sid").join(decided, ["h", "sid"])
    by_text = places.groupBy("tk").agg(F.collect_list(F.struct("starts", "windows")).alias("places"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 256):
            out = []
            for places_ in b.column("places"):
                v = places_.values
                bits = np.unpackbits(np.frombuffer(b"".join(v.field(1).to_pylist()), np.uint8).reshape(len(v), -1), axis=1)[:, : wide + 1]
                at = v.field(0)
                i, j = np.nonzero(np.repeat(bits, at.value_lengths().to_numpy(), axis=0))
                starts = np.unique(at.flatten().to_numpy()[i] + j)
                new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
                out.append(np.stack([starts[new], starts[np.append(new[1:], len(starts)) - 1] + length], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([b.column("tk"), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["tk", "spans"])

    out = written(by_text.mapInArrow(lean(spans), "tk long, spans array<long>"), "spans", few=docs)
    release(cuts)
    return out


def cut_rows(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """(row, n_bytes, n_removed, kept_sha256, n_spans, spans, cut, emptied) of every row.

    row holds all columns but text, or without texts doc_id alone. spans are the removed ranges of bytes, start and
    end in turn; kept_sha256 is of the bytes that are left. cut is the rest as a string, for which spans shrink to whole
    characters: null for a null text, and for all without texts; emptied says that only blanks are left of a text that had more.
    Null texts count as empty, texts shorter than length lose nothing. Matches don't cross rows; a text that stands in
    two rows loses all it has. Repeated rows and null ids are rows like others; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, length)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text" and (texts or c == "doc_id")]).alias("row")
    rows = docs.select(row, "text", text_key().alias("tk")).join(spans, "tk", "left").select("row", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            n, removed, count, sha, cut, emptied = [], [], [], [], [], []
            data, offsets = flat(b.column("text"))
            lists = b.column("spans").to_pylist()
            for i, (s, null) in enumerate(zip(lists, b.column("text").is_null().to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                s = s or []
                parts, whole, at, at_char = [], [], 0, 0
                for x, y in zip(s[::2], s[1::2], strict=True):
                    parts.append(text[at:x])
                    at = y
                    while x < y and x < len(text) and text[x] & 0xC0 == 0x80:
                        x += 1
                    while y > x and y < len(text) and text[y] & 0xC0 == 0x80:
                        y -= 1
                    whole.append(text[at_char:x])
                    at_char = y
                rest = b"".join([*parts, text[at:]])
                left = b"".join([*whole, text[at_char:]]) if s else text
                n.append(len(text))
                removed.append(len(text) - len(rest))
                count.append(len(s) // 2)
                sha.append(hashlib.sha256(rest).hexdigest())
                cut.append(left.decode() if texts and not null else None)
                emptied.append(bool(s) and not left.strip() and bool(text.strip()))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(count, pa.int64()), b.column("spans"), pa.array(cut, pa.string()), pa.array(emptied, pa.bool_())],
                ["row", "n_bytes", "n_removed", "kept_sha256", "n_spans", "spans", "cut", "emptied"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return bounded(rows).mapInArrow(lean(apply), f"row {kind}, n_bytes long, n_removed long, kept_sha256 string, n_spans long, spans array<long>, cut string, emptied boolean")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rows(documents(spark, sf_dir), texts=False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
