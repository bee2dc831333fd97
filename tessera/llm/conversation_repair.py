"""Cheapest repair of a conversation's structure, by a dynamic program over tensors.

A state is what the repaired conversation ends in: nothing yet, the system's turn, the user's, or the assistant's. Conversations
are put in buckets by length; a bucket's rows are a matrix turn by conversation, and the costs from a turn on, for all
conversations and states, are found a turn at a time from the last one backwards. All are kept: the cheapest edits are
then traced from the first turn on, again for all conversations at once, the ASCII-least of those that cost no more.

A conversation of more than LONG rows or LONG_BYTES is dealt out in segments. A segment's costs from each state to each are a
matrix; the matrices of a conversation, few and small, are folded from the last one to find each segment's costs behind
it, segments are traced from every state they may start in, and a fold from the first one tells which it is. Only the
hash of its repaired text has to read its rows in order: one task streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, rows_of, whole_groups, written

LONG = 4096  # rows of a conversation that one task takes as a whole, and of a segment of a longer one
LONG_BYTES = 8 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3  # of the codes of initials: system 0, user 1, assistant 2
TRUNCATED, GONE = 4, 8  # a row's kind is its initial's code, with TRUNCATED added; GONE must be deleted
END = np.array([0, 4, 2, 0], np.int64)  # cost behind the last row: from a system's or user's turn turns are inserted
NEVER = 1 << 40
NEXT = np.array([USER, USER, ASSISTANT, USER])  # state after a turn that is inserted or gets a new role
_KEPT = np.full((9, 4), 4)  # state after a row of a kind is kept in a state; 4: it can't be
for _kind in range(8):
    for _state in range(4):
        if _kind % 4 == 0 and _state == START:
            _KEPT[_kind, _state] = SYSTEM
        elif _kind % 4 == NEXT[_state] - 1:
            _KEPT[_kind, _state] = NEXT[_state]


def backward(kinds: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, i, s] from turn t on in state s, for kinds[t, i] of conversations i of their lengths and costs end[i, s] behind them."""
    turns, n = kinds.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = end
    wide = np.full((n, 5), NEVER, np.int64)
    for t in range(turns - 1, -1, -1):
        after, kind = costs[t + 1], kinds[t]
        wide[:, :4] = after
        extra = ((kind & TRUNCATED) >> 2)[:, None]
        stay = np.minimum(np.take_along_axis(wide, _KEPT[kind], axis=1), after[:, NEXT] + 2) + extra
        stay[kind == GONE] = NEVER
        here = np.minimum(stay, after + 3)
        for _ in range(2):  # more than two insertions come back to a state
            here = np.minimum(here, here[:, NEXT] + 2)
        costs[t] = np.where((t < lengths)[:, None], np.minimum(here, NEVER), after)
    return costs


def trace(kinds: np.ndarray, lengths: np.ndarray, costs: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The cheapest edits' initials of each conversation from its state in start, the least of equal ones, and the state after its rows.

    Insertions behind the rows are made where last is true; else the next segment makes them.
    """
    n = len(lengths)
    at, state, every = np.zeros(n, np.int64), start.copy(), np.arange(n)
    steps: list[np.ndarray] = []
    while True:
        rows = at < lengths
        live = rows | (last & ((state == SYSTEM) | (state == USER)))
        if not live.any():
            break
        now = costs[at, every, state]
        behind = np.minimum(at + 1, costs.shape[0] - 1)
        kind = kinds[np.minimum(at, len(kinds) - 1), every] if len(kinds) else np.full(n, GONE)
        extra = (kind & TRUNCATED) >> 2
        new = _KEPT[kind, state]
        deletes = rows & (costs[behind, every, state] + 3 == now)
        inserts = costs[at, every, NEXT[state]] + 2 == now
        keeps = rows & (kind != GONE) & (new < 4) & (costs[behind, every, np.minimum(new, 3)] + extra == now)
        step = np.select([~live, deletes, inserts, keeps], [0, ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
        state = np.select([(step == 0) | (step == ord("D")), step == ord("K")], [state, np.minimum(new, 3)], NEXT[state])
        at += (step != 0) & (step != ord("I"))
        steps.append(step)
    grid = np.stack(steps, axis=1) if steps else np.zeros((n, 0), np.uint8)
    return [r[r != 0].tobytes() for r in grid], state


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Conversations by the power of two that their length is below."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for s in np.unique(size).tolist():
        yield np.flatnonzero(size == s)


def _bucket(kind: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Kinds of the rows as turn by conversation, GONE behind the ends."""
    t = np.arange(int(lengths.max(initial=0)))[:, None]
    return np.where(t < lengths, np.append(kind, GONE)[np.minimum(starts + t, len(kind))], GONE)


class Repaired:
    """The repaired text, a line for each turn, and its hash."""

    def __init__(self, state: int = START):
        self.state, self.hash, self.first = state, hashlib.sha256(), True

    def line(self, edit: int, role: str, text: str) -> None:
        if edit == 68:  # D
            return
        if edit == 75:  # K
            self.state = SYSTEM if self.state == START and role[:1] == "s" else int(NEXT[self.state])
        else:
            self.state = int(NEXT[self.state])
            role = "user" if self.state == USER else "assistant"
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def rows(self, edits: Iterator[int], rows: Iterator[tuple[str, str]]) -> None:
        for edit in edits:
            self.line(edit, *(("", "") if edit == 73 else next(rows)))  # I


def _codes(initial: Column) -> Column:
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (k, conv_id, turn, role, text, ...) after damage: by crc32 of `conv_id:turn` modulo 20 a row is dropped (0: its row stays, marked),
    emptied (1), loses `.`, `!` and `?` (2), is repeated (3) or given to the user (4). A null counts as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    out = rows.select(key.alias("k"), "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fault"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = out.select("k", "conv_id", "turn", F.when(F.col("fault") != 0, role).otherwise("").alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)  # empty: no character but spaces
    return out.select("k", "conv_id", "turn", "role", "text", "dropped", "copy", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"), _codes(F.substring("role", 1, 1)).alias("initial"))


ORDER = ["turn", "role", "text", "copy"]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _illegal(initial: np.ndarray) -> np.ndarray:
    """For each row but the first whether it and the one before are no legal pair."""
    a, b = initial[:-1], initial[1:]
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def _whole(table: pa.Table) -> pa.RecordBatch:
    """Results of the conversations of a table, whose rows are in order."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    k = np.unique(np.array(col["k"].to_pylist(), object), return_inverse=True)[1]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))  # rows, dropped ones included
    n = len(first)
    conv_all = np.repeat(np.arange(n), np.diff(np.append(first, len(k))))
    here = np.flatnonzero(~col["dropped"].to_numpy(zero_copy_only=False))
    rows = {c: v.take(pa.array(here)) for c, v in col.items()}
    conv = conv_all[here]
    role, text = rows["role"].to_pylist(), rows["text"].to_pylist()
    blank, truncated = (rows[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "truncated"))
    initial = rows["initial"].to_numpy().astype(np.int64)
    seen: set = set()
    duplicate = np.zeros(len(here), bool)
    for i, what in enumerate(zip(conv.tolist(), role, text, strict=True)):
        duplicate[i] = what in seen
        seen.add(what)
    duplicate &= ~blank
    truncated &= ~(blank | duplicate)
    kind = np.where(blank | duplicate, GONE, initial + TRUNCATED * truncated)
    lengths = np.bincount(conv, minlength=n)
    starts = np.cumsum(lengths) - lengths
    same = conv[1:] == conv[:-1]
    illegal = np.bincount(conv[1:], _illegal(initial) & same, n).astype(np.int64) if len(conv) else np.zeros(n, np.int64)
    known = np.flatnonzero(rows["turn"].is_valid().to_numpy(zero_copy_only=False))
    gaps = np.zeros(n, np.int64)
    if len(known):
        turn, of = rows["turn"].take(pa.array(known)).to_numpy(), conv[known]
        head = np.concatenate([[True], of[1:] != of[:-1]])
        tail = np.concatenate([of[1:] != of[:-1], [True]])
        distinct = np.bincount(of, head | np.concatenate([[False], turn[1:] != turn[:-1]]), n).astype(np.int64)
        gaps[of[head]] = turn[tail] - turn[head] + 1 - distinct[of[head]]
    cost, audits, hashes = np.zeros(n, np.int64), [""] * n, [""] * n
    for bucket in _buckets(lengths):
        kinds, size = _bucket(kind, starts[bucket], lengths[bucket]), lengths[bucket]
        costs = backward(kinds, size, np.tile(END, (len(bucket), 1)))
        cost[bucket] = costs[0, :, START]
        edits, _ = trace(kinds, size, costs, np.full(len(bucket), START), np.ones(len(bucket), bool))
        for c, e in zip(bucket.tolist(), edits, strict=True):
            a, b = int(starts[c]), int(starts[c] + lengths[c])
            done = Repaired()
            done.rows(iter(e), iter(zip(role[a:b], text[a:b], strict=True)))
            audits[c], hashes[c] = e.decode(), done.hash.hexdigest()
    sums = [np.bincount(conv, w, n).astype(np.int64) for w in (blank, duplicate, truncated)]
    arrays = [col["conv_id"].take(pa.array(first)), *map(pa.array, (gaps, *sums, illegal, cost)), pa.array(audits, pa.string()), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", *(c.split()[0] for c in RESULT.split(", "))])


def _long(rows: DataFrame, id_type: str) -> DataFrame:
    """Results of conversations in segments of LONG rows, of the damaged rows that aren't dropped."""
    spark = rows.sparkSession
    names = ["k", "conv_id", "turn", "role", "text", "blank", "truncated", "initial"]
    kinds = f"k string, conv_id {id_type}, turn long, role string, text string, blank boolean, truncated boolean, initial int"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments: rows of a conversation in one range, LONG at most; the order of segments is that of their rows."""
        segment, filled, last = TaskContext.get().partitionId() << 32, LONG, None
        for b in batches:
            at = []
            for k in b.column("k").to_pylist():
                if k != last or filled == LONG:
                    segment, filled, last = segment + 1, 0, k
                at.append((segment, filled))
                filled += 1
            seg, i = (pa.array(c, pa.int64()) for c in zip(*at, strict=True)) if at else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, seg, i], [*names, "segment", "at"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["k", *ORDER, "some"]  # equal rows can be parted as well
    rows = rows.withColumn("some", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(number, f"{kinds}, segment long, at long"), "turns")
    place = F.struct("segment", "at")
    hashed = rows.filter("not blank").select("k", "role", F.sha2("text", 256).alias("digest"), "segment", "at")
    again = hashed.groupBy("k", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = hashed.join(again, ["k", "role", "digest"]).filter(F.struct("segment", "at") != F.col("first")).select("k", "segment", "at", F.lit(True).alias("copied"))
    kinds_of = rows.select("k", "turn", "blank", "truncated", "initial", "segment", "at").join(copies, ["k", "segment", "at"], "left")
    duplicate = F.coalesce("copied", F.lit(False))
    gone = F.col("blank") | duplicate
    kinds_of = kinds_of.select("k", "turn", "segment", "at", "initial", "blank", duplicate.alias("duplicate"), (F.col("truncated") & ~gone).alias("truncated"), F.when(gone, GONE).otherwise(F.col("initial") + F.when(F.col("truncated"), TRUNCATED).otherwise(0)).cast("int").alias("kind"))
    kinds_of = written(kinds_of, "kinds")
    counts = kinds_of.groupBy("k", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = counts.groupBy("k").agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(k, segment, kinds, initials, end) of each segment of rows in order."""
        for table in whole_groups(batches, ["segment"], 1):
            seg = table.column("segment").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1], [True]]))
            kind, initial = (table.column(c).to_numpy() for c in ("kind", "initial"))
            extra = table.column("end").combine_chunks() if "end" in table.column_names else None
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield table.column("k")[a].as_py(), int(seg[a]), kind[a:b], initial[a:b], extra[a].as_py() if extra is not None else None

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, seg, kind, initial, _ in segments(batches):
            size = np.full(4, len(kind))
            costs = backward(np.repeat(kind[:, None], 4, axis=1), size, np.where(np.eye(4, dtype=bool), 0, NEVER))[0]  # end by start
            row = [[k], [seg], [costs.T.ravel().tolist()], [int(_illegal(initial).sum())], [int(initial[0])], [int(initial[-1])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["k", "segment", "matrix", "illegal", "head", "tail"])

    def fold_back(frame: pd.DataFrame) -> pd.DataFrame:
        """Costs behind each segment; the first row has the conversation's cost and illegal pairs."""
        frame = frame.sort_values("segment")
        behind, ends = END, []
        for m in frame["matrix"].iloc[::-1]:
            ends.append(behind.tolist())
            behind = np.minimum((np.array(m).reshape(4, 4) + behind).min(axis=1), NEVER)
        pairs = np.stack([frame["tail"].to_numpy()[:-1], frame["head"].to_numpy()[1:]], axis=1)
        illegal = int(frame["illegal"].sum()) + sum(int(_illegal(p)[0]) for p in pairs)
        n = len(frame)
        return pd.DataFrame({"k": frame["k"], "segment": frame["segment"], "end": ends[::-1], "last": [False] * (n - 1) + [True], "cost": [int(behind[START])] * n, "illegal": [illegal] * n})

    steps = kinds_of.repartition("k", "segment").sortWithinPartitions("segment", "at").mapInArrow(matrices, "k string, segment long, matrix array<long>, illegal long, head long, tail long")
    folded = written(steps.groupBy("k").applyInPandas(fold_back, "k string, segment long, end array<long>, last boolean, cost long, illegal long"), "ends")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, seg, kind, _, end in segments(batches):
            size, last = np.full(4, len(kind)), np.full(4, bool(end["last"]))
            four = np.repeat(kind[:, None], 4, axis=1)
            costs = backward(four, size, np.tile(np.array(end["end"], np.int64), (4, 1)))
            edits, state = trace(four, size, costs, np.arange(4), last)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([seg]), pa.array([[e.decode() for e in edits]]), pa.array([state.tolist()], pa.list_(pa.int64()))], ["k", "segment", "edits", "state"])

    with_end = kinds_of.join(folded.select("k", "segment", F.struct("end", "last").alias("end")), ["k", "segment"]).repartition("k", "segment").sortWithinPartitions("segment", "at")
    traced = written(with_end.mapInArrow(traces, "k string, segment long, edits array<string>, state array<long>"), "edits")

    def fold_on(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        state, entered = START, []
        for after in frame["state"]:
            entered.append(state)
            state = int(after[state])
        return pd.DataFrame({"k": frame["k"], "segment": frame["segment"], "entered": entered})

    entered = traced.select("k", "segment", "state").groupBy("k").applyInPandas(fold_on, "k string, segment long, entered int")
    chosen = written(traced.join(entered, ["k", "segment"]).select("k", "segment", "entered", F.get("edits", F.col("entered")).alias("audit")), "audits")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One hash for each conversation from its rows in order, the edits before the rows of their segment; a row is held at a time."""
        k, done, edits, at = None, None, b"", 0
        out: list[tuple[str, str]] = []

        def insert(at: int) -> int:
            while at < len(edits) and edits[at] == 73:
                done.line(73, "", "")
                at += 1
            return at

        for b in rows_of(batches, 64):
            for who, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("k", "audit", "role", "text")), strict=True):
                if who != k:
                    if done:
                        out.append((k, done.hash.hexdigest()))
                    k, done = who, Repaired()
                if audit is not None:
                    edits = audit.encode()
                    at = insert(0)
                else:
                    done.line(edits[at], role, text)
                    at = insert(at + 1)
        if done:
            out.append((k, done.hash.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["k", "repaired_sha256"])

    null = F.lit(None).cast("string")
    stream = rows.select("k", "segment", "at", null.alias("audit"), "role", "text").unionByName(chosen.select("k", "segment", F.lit(-1).cast("long").alias("at"), "audit", null.alias("role"), null.alias("text")))
    hashed = stream.repartition("k").sortWithinPartitions("k", "segment", "at").mapInArrow(hashes, "k string, repaired_sha256 string")
    audits = chosen.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    totals = folded.groupBy("k").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    ids = rows.groupBy("k").agg(F.min("conv_id").alias("conv_id"))
    out = counts.join(totals, "k").join(audits, "k").join(hashed, "k").join(ids, "k").select("conv_id", *(c.split()[0] for c in RESULT.split(", ")))
    out = written(out, "long")
    release(rows, kinds_of, folded, traced, chosen)
    return out


def repair(rows: DataFrame) -> DataFrame:
    """conv_id and what its repair needs (RESULT) of every conversation of (conv_id, turn, role, text), damaged first.

    Rows of a conversation are taken by turn, nulls first; of one turn by role and text, then copies. Null conv_ids are one
    conversation; null roles and texts are a space, so such texts are blank. Repeated rows are duplicates of the first.
    A conversation without rows after damage has zeros, an empty audit and the hash of nothing. Other columns
    aren't read; an empty table gives an empty one.
    """
    id_type = dict(rows.dtypes)["conv_id"]
    turns = damaged(rows)
    size = turns.filter("not dropped").groupBy("k").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = written(size.filter((F.col("rows") > LONG) | (F.col("bytes") > LONG_BYTES)).select("k"), "large", few=True)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["k"], 1):
            yield _whole(table)

    short = turns.join(large, "k", "left_anti").repartition("k").sortWithinPartitions("k", *ORDER).mapInArrow(whole, f"conv_id {id_type}, {RESULT}")
    out = written(short, "short", few=rows)
    if not large.isEmpty():
        out = out.unionByName(_long(turns.filter("not dropped").join(large, "k", "left_semi"), id_type))
    release(large)
    return out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH RECURSIVE crc_step(n, i, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE i < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM crc_step WHERE i = 8
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), faults AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fault
  FROM raw, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM faults WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem FROM damaged
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS occurrence FROM placed
), kinds AS (
  SELECT *, stem = '' AS blank, stem <> '' AND occurrence > 1 AS duplicate, stem <> '' AND occurrence = 1 AND right(stem, 1) NOT IN ('.', '!', '?') AS truncated,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM counted
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || '>' || initial NOT IN ('s>u', 'u>a', 'a>u')) AS illegal FROM kinds GROUP BY conv_id
), inserts(a, b, edits, cost) AS (  -- from state a to b before a row: - nothing yet, s, u, a
  VALUES ('-', '-', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0), ('-', 'u', 'I', 2), ('s', 'u', 'I', 2), ('u', 'a', 'I', 2), ('a', 'u', 'I', 2),
    ('-', 'a', 'II', 4), ('s', 'a', 'II', 4), ('u', 'u', 'II', 4), ('a', 'a', 'II', 4)
), moves(a, b, edit, cost, initial) AS (  -- a row's; the initial is that of rows that may make it, null for all
  VALUES ('-', 's', 'K', 0, 's'), ('-', 'u', 'K', 0, 'u'), ('s', 'u', 'K', 0, 'u'), ('u', 'a', 'K', 0, 'a'), ('a', 'u', 'K', 0, 'u'),
    ('-', 'u', 'R', 2, NULL), ('s', 'u', 'R', 2, NULL), ('u', 'a', 'R', 2, NULL), ('a', 'u', 'R', 2, NULL),
    ('-', '-', 'D', 3, NULL), ('s', 's', 'D', 3, NULL), ('u', 'u', 'D', 3, NULL), ('a', 'a', 'D', 3, NULL)
), steps AS (
  SELECT x.a, m.b, x.edits || m.edit AS edits, x.cost + m.cost AS cost, m.edit, m.initial FROM inserts x JOIN moves m ON x.b = m.a
), best(conv_id, i, n, state, found) AS (
  SELECT conv_id, 0::BIGINT, n, '-', {'cost': 0::BIGINT, 'audit': ''} FROM sums
  UNION ALL
  SELECT w.conv_id, w.i + 1, w.n, s.b, min({'cost': w.found.cost + s.cost + CASE WHEN k.truncated AND s.edit <> 'D' THEN 1 ELSE 0 END, 'audit': w.found.audit || s.edits})
  FROM best w JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1
  JOIN steps s ON s.a = w.state AND (s.initial IS NULL OR s.initial = k.initial) AND (s.edit = 'D' OR NOT (k.blank OR k.duplicate))
  GROUP BY w.conv_id, w.i + 1, w.n, s.b
), ended AS (
  SELECT w.conv_id, min({'cost': w.found.cost + x.cost, 'audit': w.found.audit || x.edits}) AS found FROM best w JOIN inserts x ON x.a = w.state AND x.b IN ('-', 'a') WHERE w.i = w.n GROUP BY w.conv_id
), edits AS (
  SELECT conv_id, unnest(string_split(found.audit, '')) AS edit, generate_subscripts(string_split(found.audit, ''), 1) AS p FROM ended WHERE found.audit <> ''
), numbered AS (
  SELECT conv_id, edit, p, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), turns AS (
  SELECT e.conv_id, e.edit, e.p, e.o, CASE WHEN e.edit <> 'I' THEN k.role END AS role, CASE WHEN e.edit <> 'I' THEN k.text ELSE '' END AS text,
    first_value(e.edit = 'K' AND k.initial = 's') OVER (PARTITION BY e.conv_id ORDER BY e.edit = 'D', e.p) AS led
  FROM numbered e LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.i = e.i AND e.edit <> 'I'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired FROM turns WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
  coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(e.found.cost, 0)::BIGINT AS cost, coalesce(e.found.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
