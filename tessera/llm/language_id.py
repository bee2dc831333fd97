"""Language identification by prediction by partial matching: exact code lengths under frozen byte context trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, documents, lean, sliced, written
from .kernel import flat

ORDER = 3  # bytes of the longest context
SAMPLE_BYTES = 1 << 20  # of training text for each language; the learner's bound
MAX_LANGUAGES = 64  # that are drawn and trained at a time
MODEL_BYTES = 256 << 20  # the largest model that is broadcast; languages that don't fit are spread over several


@dataclass
class Model:
    """symbol: of each byte; node: of each context of ORDER symbols, the number of the longest context that is known;
    cost[node * n_symbols + symbol]: bits for each language."""

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    cost: np.ndarray
    n_symbols: int


def train(texts: dict[str, list[bytes]], most_bytes: float = math.inf) -> Model | None:
    """One context tree for each language. Escapes follow method C: in a context with n bytes seen, q of them
    different, a byte seen c times costs -log2(c / (n + q)) and the escape to the next shorter context costs
    -log2(q / (n + q)); below order 0 all 256 bytes are equally likely. A context that a language hasn't seen
    costs nothing to leave. Nothing is updated while scoring. A language's costs don't depend on the others.
    None if the model would have more than most_bytes.
    """
    languages = sorted(texts)
    blobs = {k: b"\0".join(v) for k, v in texts.items()}
    used = np.zeros(256, bool)
    for blob in blobs.values():
        used[np.frombuffer(blob, np.uint8)] = True
    used[0] = True
    alphabet = np.flatnonzero(used)
    s = len(alphabet) + 1  # the last symbol stands for all other bytes
    symbol = np.full(256, s - 1, np.uint8 if s <= 256 else np.uint16)
    symbol[alphabet] = np.arange(len(alphabet))
    coded = {k: symbol[np.frombuffer(b, np.uint8)].astype(np.int64) for k, b in blobs.items()}

    def contexts(x: np.ndarray, order: int) -> np.ndarray:
        at = np.zeros(max(len(x) - ORDER, 0), np.int64)
        for j in range(order, 0, -1):
            at = at * s + x[ORDER - j : len(x) - j]
        return at

    node = np.zeros(s**ORDER, np.int32)
    known, above, rows, total = None, np.full((1, s, len(languages)), 8.0), [], 0
    for order in range(ORDER + 1):
        shorter, known = known, np.unique(np.concatenate([contexts(x, order) for x in coded.values()]))
        if 4 * ((total + len(known)) * s * len(languages) + len(node)) > most_bytes:
            return None
        up = np.searchsorted(shorter, known % s ** (order - 1)) if order else np.zeros(len(known), np.int64)
        made = above[up]
        for k, language in enumerate(languages):
            x = coded[language]
            if len(x) <= ORDER:
                continue
            pairs, count = np.unique(np.searchsorted(known, contexts(x, order)) * s + x[ORDER:], return_counts=True)
            of, byte = pairs // s, pairs % s
            n, q = np.bincount(of, count, len(known)), np.bincount(of, minlength=len(known))
            seen = n > 0
            made[seen, :, k] += np.log2((n + q)[seen] / q[seen])[:, None]
            made[of, byte, k] = np.log2((n + q)[of] / count)
        node.reshape(s ** (ORDER - order), s**order)[:, known] = total + np.arange(len(known))  # the nearest bytes are the low digits
        rows.append(made.astype(np.float32))
        total += len(known)
        above = made
    table = np.concatenate(rows)
    return Model(languages, symbol, node, table.reshape(-1, len(languages)), s)


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text for each language; a text starts after ORDER zero bytes."""
    n, s = len(data), model.n_symbols
    x = model.symbol[data].astype(np.int64)
    zero = int(model.symbol[0])
    context = np.zeros(n, np.int64)
    for j in range(ORDER, 0, -1):
        before = np.full(n, zero, np.int64)
        before[j:] = x[:-j] if j < n else x[:0]
        for d in range(j):  # bytes of the text before don't count
            at = offsets[:-1] + d
            before[at[at < offsets[1:]]] = zero
        context = context * s + before
    bits = model.cost[model.node[context] * np.int64(s) + x]
    out = np.zeros((len(offsets) - 1, bits.shape[1]))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def held_out(ident: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(ident).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def spread(texts: dict[str, list[bytes]], most_bytes: float) -> Iterator[Model]:
    """Models of at most most_bytes that have all languages together, in their order."""
    model = train(texts, most_bytes)
    if model:
        yield model
    elif len(texts) == 1:
        raise ValueError(f"a model of more than {most_bytes} bytes for {next(iter(texts))}")
    else:
        names = sorted(texts)
        for part in (names[: len(names) // 2], names[len(names) // 2 :]):
            yield from spread({k: texts[k] for k in part}, most_bytes)


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, most_bytes: float = MODEL_BYTES) -> list[Broadcast] | None:
    """Models of the labelled rows that aren't held out, from whole texts drawn by a hash of the text.

    Every value of lang is learned; one model has them all if it fits, else each has some. Languages' sizes are
    counted over all rows. About sample_bytes are drawn for each, equal texts once, and cut to twice that, in the order of
    the hash, before they reach the driver; texts longer than sample_bytes / 4 are left out of the sample. A language of which
    nothing is drawn so is learned from the first sample_bytes of its shortest text. None if no row is labelled.
    """
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    small = F.octet_length("text") <= sample_bytes // 4
    sizes = {r["lang"]: (r["b"], r["small"] or 0) for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.when(small, F.octet_length("text"))).alias("small")).collect()}
    if not any(b for b, _ in sizes.values()):
        return None
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    names, models = sorted(sizes), []
    for at in range(0, len(names), MAX_LANGUAGES):
        group = names[at : at + MAX_LANGUAGES]
        share = F.create_map(*[x for k in group for x in (F.lit(k), F.lit(min(1.0, sample_bytes / max(sizes[k][1], 1))))])
        drawn = labelled.filter(small & F.col("lang").isin(group)).withColumn("u", u).filter(F.col("u") < share[F.col("lang")]).select("lang", "u", "text").distinct()
        upto = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("u", "text"))  # some sample_bytes of each
        texts: dict[str, list[bytes]] = {k: [] for k in group}
        for r in sorted(drawn.withColumn("upto", upto).filter(F.col("upto") <= 2 * sample_bytes).toLocalIterator(), key=lambda r: (r["lang"], r["u"], r["text"])):
            texts[r["lang"]].append(r["text"].encode())
        undrawn = [k for k in group if not any(texts[k]) and sizes[k][0]]
        if undrawn:
            head = F.struct(F.octet_length("text").alias("n"), F.substring("text", 1, sample_bytes).alias("text"))
            for r in labelled.filter(F.col("lang").isin(undrawn) & (F.octet_length("text") > 0)).groupBy("lang").agg(F.min(head).alias("m")).select("lang", "m.text").toLocalIterator():
                texts[r["lang"]] = [r["text"].encode()[:sample_bytes]]
        models += [docs.sparkSession.sparkContext.broadcast(m) for m in spread({k: v or [b""] for k, v in texts.items()}, most_bytes)]
    return models


def judge(shared: Broadcast, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a model's languages to what the models before it found: best is the shortest code's bits, mass the sum of
    all languages' probabilities as multiples of the best one's. The last model's pass doesn't give the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for b in sliced(batches, "text", 1 << 20):
            bits = score(m, *flat(b.column("text")))
            mine = bits.argmin(axis=1)
            least, old = bits[np.arange(len(mine)), mine], b.column("best").to_numpy()
            best = np.minimum(least, old)
            mass = b.column("mass").to_numpy() * np.exp2(best - old) + np.exp2(np.minimum(best[:, None] - bits, 0)).sum(axis=1)
            pred = np.where(least < old, names[mine], b.column("lang_pred").to_numpy(zero_copy_only=False))
            held = {"lang_pred": pa.array(pred, pa.string()), "best": pa.array(best), "mass": pa.array(mass)}
            out = [n for n in b.schema.names if n != "text" or not last]
            yield pa.RecordBatch.from_arrays([held.get(n, b.column(n)) for n in out], out)

    return run


def identify_rows(docs: DataFrame, models: list[Broadcast] | None) -> DataFrame:
    """(row, held_out, lang_pred, score) of every row; row holds all its columns, whatever their names.

    The language with the shortest code wins, the first in alphabetical order among equals; score is its share
    of the probability that all languages give the text. Each model is a pass; rows are written between passes, so
    that workers hold one model. A text that is null or has no letter, or any text
    if there is no model, gives und and 0. Nulls in doc_id count as not held out; repeated rows are judged
    alike; lang, source and doc_id are no inputs; an empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "text", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not models:
        return rows.select("row", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(math.inf).alias("best"), F.lit(0.0).alias("mass"))
    kinds = [(f.name, f"{f.name} {f.dataType.simpleString()}") for f in rows.schema]
    for i, shared in enumerate(models):
        last = i == len(models) - 1
        kind = ", ".join(k for n, k in kinds if n != "text" or not last)
        rows = (written(rows, "judged") if i else bounded(rows)).mapInArrow(lean(judge(shared, last)), kind)
    return rows.select("row", "held_out", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), 1 / F.col("mass")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, models: list[Broadcast] | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, as identify_rows; other columns are not read."""
    return identify_rows(docs.select("doc_id", "text"), models).select("row.doc_id", "held_out", "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))
