"""The run ledger as streams: rates over sliding windows, replay with state, idempotent publication, progress lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessera.operators.ledger import RUN_STATES

#: Captures of a group that is published together.
GROUP = 4


def rates(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", seconds: int = 60, slide: int = 30) -> DataFrame:
    """Requests and amounts by key in sliding windows; state is dropped behind the watermark."""
    seen = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = seen.groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds").alias("w"), key).agg(F.count("*").alias("requests"), F.sum("value").alias("amount"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "requests", "amount")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, last, refused = state.get if state.exists else ("", 0, 0)
    rows = pd.concat(list(frames)).sort_values("sequence")
    for r in rows.itertuples():
        if r.sequence <= last:
            continue  # a frame that was replayed
        last = int(r.sequence)
        if (not now and r.state == "planned") or (now, r.state) in RUN_STATES:
            now = r.state
        else:
            refused += 1
    state.update((now, last, refused))
    yield pd.DataFrame({"run_id": [key[0]], "state": [now], "last": [last], "refused": [refused]})


def replay(events: DataFrame) -> DataFrame:
    """(run_id, state, last, refused) after each batch of (run_id, sequence, state): a fold with state by run.

    A frame is taken once, in order of sequence; one that the state doesn't allow is counted and leaves the state.
    """
    return events.groupBy("run_id").applyInPandasWithState(_step, "run_id string, state string, last long, refused long", "state string, last long, refused long", "update", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row; keys are remembered until the watermark passes them."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def publisher(root: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a batch's folder is named by its id and overwritten, so a batch that is repeated changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return put


def groups(captures: DataFrame, order: list[str], size: int = GROUP) -> DataFrame:
    """Group numbers of at most `size` captures of each source, in order."""
    from pyspark.sql.window import Window

    return captures.withColumn("group", F.floor((F.row_number().over(Window.partitionBy("source_id").orderBy(*order)) - 1) / size))


def progress(df: DataFrame, kind: str) -> DataFrame:
    """Rows as JSON lines of a progress stream: {"type": kind, ...}, for a text or JSON sink."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(c) for c in df.columns])).alias("value"))


def envelope(ok: bool, data: object) -> str:
    """A command's one result as canonical JSON."""
    return json.dumps({"data": data, "ok": ok}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _Window(StatefulProcessor):
    """Rows of a key by span of time. When the watermark has passed a span its rows are counted, with those of the last span before it, which then goes."""

    def __init__(self, seconds: int, span: int):
        self.wide, self.span = seconds * 1_000_000, span * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span long", "at array<bigint>, sequence array<bigint>, amount array<double>")
        self.last = handle.getValueState("last", "span long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for span, part in frame.groupby(frame["at"] // self.span):
                at = (int(span),)
                held = self.spans.getValue(at) if self.spans.containsKey(at) else ([], [], [])
                self.spans.updateValue(at, tuple([*h, *part[c].tolist()] for h, c in zip(held, ("at", "sequence", "amount"), strict=True)))
                self.handle.registerTimer((int(span) + 1) * self.span // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        span = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.span - 1
        own, before = [list(c) for c in self.spans.getValue((span,))], [[], [], []]
        last = self.last.get()
        if last is not None:
            if last[0] == span - 1:
                before = [list(c) for c in self.spans.getValue((last[0],))]
            self.spans.removeKey((last[0],))
        self.last.update((span,))
        at, amount = (np.array(before[i] + own[i]) for i in (0, 2))
        order = np.argsort(at, kind="stable")
        at, sums = at[order], np.concatenate([[0.0], np.cumsum(amount[order])])
        low = at.searchsorted(np.array(own[0]) - self.wide, side="right")  # strict: the instant `seconds` ago has left
        high = at.searchsorted(np.array(own[0]), side="right")
        yield pd.DataFrame({"key": key[0], "sequence": own[1], "requests": high - low, "amount": sums[high] - sums[low]})

    def close(self) -> None:
        pass


def live_rates(events: DataFrame, key: str, sequence: str, ts: str, value: str, late: str = "10 minutes", seconds: int = 60, span: int = 600) -> DataFrame:
    """(key, sequence, requests, amount) of each row: what its key did in the seconds up to it, its own instant included and the one `seconds` ago not.

    State by key with event-time timers: a row waits until the watermark has passed its span of `span` seconds, so that late rows before it are there; then it is counted, and
    rows that no later one can see are forgotten. What is held of a key is two spans and what is younger than the watermark, however long its history.
    Rows later than `late` are dropped by the watermark. Needs the RocksDB state store.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(sequence).cast("long").alias("sequence"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("amount"))
    if span < seconds:
        raise ValueError("a span is as long as the window at least")
    rows = rows.withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Window(seconds, span), "key string, sequence long, requests long, amount double", "append", "eventTime")
