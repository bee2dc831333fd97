"""Context: term weights, passage scores and utilities, unit selection, facility location, greedy packing, whole originals.

Choosing under a budget is sequential by nature. It is done for each request in a task of its own, over at most
MOST_PACKETS rows that windows cut first, so requests are what is spread over the cluster.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tessera.operators.dense import RRF

#: Caps of a context.
MOST_PACKETS, PER_OWNER, PER_OWNER_SOURCES, GRAPH_SHARE = 160, 2, 4, 0.5
WHOLE_OWNERS, WHOLE_PATHS, WHOLE_BYTES = 10, 16, 96 * 1024
SET_CANDIDATES, OWNER_CANDIDATES = 80, 32


def term_weights(blocks: DataFrame) -> DataFrame:
    """(term, df, weight) over blocks (block, terms): round((1 + ln((blocks + 1) / df)) * 1e6)."""
    n = blocks.agg(F.count("*").alias("n"))
    df = blocks.select("block", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round((1 + F.ln((F.col("n") + 1) / F.col("df"))) * 1e6).cast("long").alias("weight"))


def semantic_strength(affinity: Column) -> Column:
    return F.pow(F.greatest(F.coalesce(affinity, F.lit(0.0)), F.lit(0.0)), F.lit(4.0))


def passage_score(owner_rank: Column, graph_rank: Column) -> Column:
    """Sum of 1 / (60 + r) over the direct and graph ranks of a passage's owner; absent ranks add nothing."""
    return sum((F.when(r.isNotNull(), 1.0 / (F.lit(RRF) + r)).otherwise(0.0) for r in (owner_rank, graph_rank)), F.lit(0.0))


def utility(score: Column, novel: Column, local: Column, density: Column, affinity: Column, best: Column, seed_overlap: Column, clipped: Column) -> Column:
    """Priority of a packet; novel and local are shares of the terms' weight, best the highest affinity of the request."""
    some = best > 0
    relative = F.when(some, F.greatest(affinity, F.lit(0.0)) / best).otherwise(0.0)
    near = (0.05 + F.pow(relative, F.lit(4.0))) * (1 + 0.25 * novel + 0.5 * local)
    lexical = (0.25 + 2 * novel + 0.5 * local + F.when(seed_overlap, 0.05).otherwise(0.0)) * F.when(some, 0.15).otherwise(1.0)
    return score * F.when(affinity.isNotNull(), near).otherwise(lexical) * density * F.when(clipped, 0.7).otherwise(1.0)


def select_units(units: DataFrame, bm25: DataFrame, most: int = MOST_PACKETS) -> DataFrame:
    """(unit_id, rank, dense_rank, bm25_rank) of a request's units by cosine, BM25 and id; identical parents once, before the cap."""
    rows = units.join(bm25, "unit_id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    order = [F.col("cosine").desc(), F.col("bm25").desc(), F.col("unit_id")]
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("owner", "start", "end").orderBy(*order))).filter("n = 1")
    cut = one.orderBy(*order).limit(most)
    rank = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  at most `most` rows
    return cut.select("unit_id", rank(*order).alias("rank"), rank(F.col("cosine").desc(), "unit_id").alias("dense_rank"), rank(F.col("bm25").desc(), "unit_id").alias("bm25_rank"))


def cut_for_request(rows: DataFrame, order: Sequence[Column], most: int = MOST_PACKETS) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy(*order))).filter(F.col("n") <= most).drop("n")


def _by_request(rows: DataFrame, order: Sequence[Column], choose: Callable[[pd.DataFrame], list[int]], most: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key").reset_index(drop=True)
        picked = choose(group)
        return pd.DataFrame({"request": group["request"].iloc[picked], "key": group["key"].iloc[picked], "position": np.arange(1, len(picked) + 1, dtype=np.int64)})

    kinds = dict(rows.dtypes)
    return cut_for_request(rows, order, most).groupBy("request").applyInPandas(run, f"request {kinds['request']}, key {kinds['key']}, position long")


PACKET = "request, key, owner, start, end, score, terms, weights, local, density, affinity, seed, clipped, graph, child_start, child_end"


def header_of(label: str, start: int, end: int) -> str:
    """What stands above a passage, behind its number: its citation."""
    return f"{label} bytes {start}-{end}\n"


TAIL = "\n\n"  # behind a passage


class _Tray:
    """What is in a context: each owner's spans, merged where they overlap or touch, and running sums of what they cost.

    A span costs its bytes and `header`, or if that is None what is printed with it: its number, its citation by the owner's label, and TAIL. Numbers
    follow the order of passages, so that their digits depend on how many there are alone.
    """

    def __init__(self, header: int | None):
        self.header, self.spans, self.sizes, self.count, self.graph = header, {}, 0, 0, 0

    def _size(self, label: str, start: int, end: int) -> int:
        return end - start + (self.header if self.header is not None else len(header_of(label, start, end).encode()) + len(TAIL))

    def _numbers(self, count: int) -> int:
        """Bytes of [1], [2], ... with a space each."""
        if self.header is not None:
            return 0
        digits = sum(count - 10**d + 1 for d in range(len(str(count)))) if count else 0
        return 3 * count + digits

    def trial(self, owner, label: str, start: int, end: int, graph: bool, limits: dict) -> tuple[str | None, tuple]:
        """Why a span isn't admitted, or None, and what is in the context with it."""
        mine = self.spans.get(owner, [])
        joined = [x for x in mine if not (x[1] < start or x[0] > end)]
        apart = [x for x in mine if x[1] < start or x[0] > end]
        one = (min([start, *(x[0] for x in joined)]), max([end, *(x[1] for x in joined)]), (end - start) * graph + sum(x[2] for x in joined), min([x[3] for x in joined], default=self.count))
        sizes = self.sizes - sum(self._size(label, x[0], x[1]) for x in joined) + self._size(label, one[0], one[1])
        count = self.count - len(joined) + 1
        shared = self.graph + (end - start) * graph
        cost = sizes + self._numbers(count)
        why = None
        if one[1] - one[0] > limits["excerpt"]:
            why = "passage too long"
        elif len(apart) + 1 > limits["per_owner"]:
            why = "owner has enough"
        elif cost > limits["bytes"] or -(-cost // 4) > limits["tokens"]:
            why = "does not fit"
        elif shared > GRAPH_SHARE * limits["bytes"]:
            why = "graph has its share"
        return why, ([*apart, one], sizes, count, shared)

    def admit(self, owner, trial: tuple) -> None:
        self.spans[owner], self.sizes, self.count, self.graph = trial

    def cost(self) -> int:
        return self.sizes + self._numbers(self.count)


def _packed(g: dict[str, list], limits: dict, header: int | None, order: list[int]) -> tuple[dict[int, tuple[int | None, str | None]], _Tray]:
    """Each packet's position and reason. Utilities only fall as terms are covered, so that they are kept in a heap and found again when they come up."""
    weights = [dict(zip(t, w, strict=True)) for t, w in zip(g["terms"], g["weights"], strict=True)]
    worth: dict[str, float] = {}
    for x in weights:
        for t, w in x.items():
            worth[t] = max(worth.get(t, 0), w)
    total = max(float(sum(worth.values())), 1.0)
    best = max([0.0, *(a for a in g["affinity"] if a is not None)])
    covered: set[str] = set()

    def value(i: int) -> float:
        novel, local, affinity = sum(w for t, w in weights[i].items() if t not in covered) / total, g["local"][i] / total, g["affinity"][i]
        if affinity is None:
            v = (0.25 + 2 * novel + 0.5 * local + 0.05 * g["seed"][i]) * (0.15 if best else 1.0)
        else:
            v = (0.05 + (max(affinity, 0.0) / best if best else 0.0) ** 4) * (1 + 0.25 * novel + 0.5 * local)
        return round(g["score"][i] * v * g["density"][i] * (0.7 if g["clipped"][i] else 1.0), 12)

    # (-utility, key's place, child, the number of admissions at which it was found)
    heap = [(-value(i), place, False, 0) for place, i in enumerate(order)]
    heapq.heapify(heap)
    tray, turn, fate, found = _Tray(header), 0, {}, 0
    while heap:
        _, place, child, seen = heapq.heappop(heap)
        i = order[place]
        if not child and seen != found:
            heapq.heappush(heap, (-value(i), place, False, found))
            continue
        owner, label = g["owner"][i], g["label"][i] if "label" in g else ""
        start, end = (int(g[f"{'child_' if child else ''}{c}"][i]) for c in ("start", "end"))
        if not child and any(x[0] <= start and end <= x[1] for x in tray.spans.get(owner, [])):
            fate[i] = (None, "contained")
            continue
        why, trial = tray.trial(owner, label, start, end, g["graph"][i], limits)
        if why is None:
            turn += 1
            tray.admit(owner, trial)
            fate[i] = (turn, "child" if child else None)
            if not child:
                covered |= set(weights[i])
                found += 1
        elif not child and g["child_start"][i] is not None:
            heapq.heappush(heap, (-round(g["score"][i], 12), place, True, found))
        else:
            fate[i] = (None, why)
    return fate, tray


def _pack(packets: DataFrame, columns: Sequence[str], limits: dict, header: int | None, most: int, give: Callable[[dict, dict, _Tray], dict], schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        g = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: g["key"][i])
        fate, tray = _packed(g, limits, header, order)
        return pa.table(list(give(g, fate, tray).values()), schema=wanted)

    wanted = to_arrow_schema(packets.sparkSession.createDataFrame([], schema).schema)
    cut = cut_for_request(packets.select(*columns), [F.col("score").desc(), F.col("key")], most)
    return cut.groupBy("request").applyInArrow(run, schema)


def pack(packets: DataFrame, max_bytes: int, max_tokens: int, excerpt: int, most: int = MOST_PACKETS, source_aware: bool = True, header: int = 120) -> DataFrame:
    """(request, key, position, reason): packets in the order of their admission, or with the reason why they aren't admitted.

    packets have the columns PACKET: a span of an owner, terms of the query that it covers with their weights, what utility()
    asks for, and a child's span or null. The packet of the highest utility is tried, the least key among equals, and utilities are found again
    after each admission, as terms that are covered aren't novel any more. Spans of an owner that meet are one passage. One that an
    admitted passage contains is left out; one that doesn't fit is replaced by its child, of utility score and without terms, which is tried once.
    An owner has at most PER_OWNER_SOURCES passages, PER_OWNER unless source_aware; graph packets take at most half of the bytes.
    """
    limits = {"bytes": max_bytes, "tokens": max_tokens, "excerpt": excerpt, "per_owner": PER_OWNER_SOURCES if source_aware else PER_OWNER}
    kinds = dict(packets.dtypes)
    give = lambda g, fate, tray: {"request": g["request"], "key": g["key"], "position": [fate[i][0] for i in range(len(fate))], "reason": [fate[i][1] for i in range(len(fate))]}
    return _pack(packets, PACKET.split(", "), limits, header, most, give, f"request {kinds['request']}, key {kinds['key']}, position long, reason string")


def pack_rendered(packets: DataFrame, owners: DataFrame, max_bytes: int, max_tokens: int, excerpt: int, most: int = MOST_PACKETS, source_aware: bool = True) -> DataFrame:
    """(request, passages, charged, context): the text of each request's context, and the bytes that its passages were charged while they were packed, which are its own.

    packets have the columns PACKET, and owners (owner, label, body) are what their spans, of bytes, are of. A trial costs what it would print: for each
    passage, in the order in which its first span was admitted, its number, its owner's label and span as a citation, its bytes and an empty line; where
    spans meet the passage is printed once, and later numbers move up. Bodies aren't needed for that: they are read for what is admitted only.
    """
    limits = {"bytes": max_bytes, "tokens": max_tokens, "excerpt": excerpt, "per_owner": PER_OWNER_SOURCES if source_aware else PER_OWNER}
    kinds = dict(packets.dtypes)
    labelled = packets.join(owners.select("owner", "label"), "owner")

    def give(g: dict, fate: dict, tray: _Tray) -> dict:
        found = sorted((x[3], x[0], x[1], owner) for owner, v in tray.spans.items() for x in v)
        n = len(found)
        return {"request": [g["request"][0]] * n, "place": list(range(1, n + 1)), "owner": [x[3] for x in found], "start": [x[1] for x in found], "end": [x[2] for x in found], "charged": [tray.cost()] * n}

    schema = f"request {kinds['request']}, place long, owner {kinds['owner']}, start long, end long, charged long"
    passages = _pack(labelled, [*PACKET.split(", "), "label"], limits, None, most, give, schema)
    body = F.decode(F.substring(F.col("body").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    printed = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "label", F.lit(" bytes "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("\n"), body, F.lit(TAIL))
    rows = passages.join(owners.select("owner", "label", "body"), "owner").select("request", "place", "charged", printed.alias("printed"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "printed"))), lambda x: x["printed"]), "")  # max_bytes at most
    return rows.groupBy("request").agg(F.count("*").alias("passages"), F.max("charged").alias("charged"), lines.alias("context"))


def facility_location(candidates: DataFrame, k: int, exchange: bool = True) -> DataFrame:
    """(request, key, position): k candidates (request, key, weight, vector) that greedily raise sum(weight * max similarity) most.

    Similarity is the cosine, not below 0; ties go to the smaller key. One sweep may then exchange a chosen for
    an unchosen candidate where that raises the sum.
    """

    def choose(g: pd.DataFrame) -> list[int]:
        v = np.stack([np.asarray(x, float) for x in g["vector"]])
        v /= np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None]
        sim, w = np.maximum(np.round(v @ v.T, 12), 0), g["weight"].to_numpy(float)
        gain = lambda picked: float((w * sim[:, picked].max(axis=1)).sum()) if picked else 0.0
        out: list[int] = []
        while len(out) < min(k, len(g)):
            rest = [i for i in range(len(g)) if i not in out]
            out.append(max(rest, key=lambda i: (round(gain([*out, i]), 12), -i)))
        if exchange:
            for p in range(len(out)):
                for i in range(len(g)):
                    tried = [*out[:p], i, *out[p + 1 :]]
                    if i not in out and gain(tried) > gain(out) + 1e-12:
                        out = tried
        return out

    return _by_request(candidates, [F.col("weight").desc(), F.col("key")], choose, SET_CANDIDATES)


def expand_parents(chosen: DataFrame, max_bytes: int) -> DataFrame:
    """(request, key, position, whole): chosen children (request, key, position, parent, bytes, parent_bytes) with whether the parent takes its place.

    In the order of their positions, a child's parent is taken if what is chosen still has max_bytes at most with it; children whose parent is
    there already go, and so do children of a parent that is taken later. Children that don't fit even alone stay children.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["position", "key"]).reset_index(drop=True)
        cost, whole = dict(enumerate(g["bytes"].astype(int))), {}
        for i, parent in enumerate(g["parent"]):
            if i not in cost or pd.isna(parent):
                continue
            family = [j for j in cost if g["parent"][j] == parent]
            if sum(v for j, v in cost.items() if j not in family) + int(g["parent_bytes"][i]) <= max_bytes:
                cost = {j: v for j, v in cost.items() if j not in family} | {i: int(g["parent_bytes"][i])}
                whole[i] = True
        kept = g.loc[sorted(cost)]
        return pd.DataFrame({"request": kept["request"], "key": kept["key"], "position": kept["position"].astype("int64"), "whole": [whole.get(i, False) for i in kept.index]})

    kinds = dict(chosen.dtypes)
    return chosen.groupBy("request").applyInPandas(run, f"request {kinds['request']}, key {kinds['key']}, position long, whole boolean")


def complementary(candidates: DataFrame, k: int, per_region: int = 2, per_owner: int = OWNER_CANDIDATES) -> DataFrame:
    """(request, key, position): passages (request, key, region, strength, terms, weights) by strength, at most per_region of a region,
    then those that add the most weight of terms not covered yet, until none adds any or there are k. Where candidates have an owner, each
    owner's per_owner strongest take part."""
    if "owner" in candidates.columns:
        w = Window.partitionBy("request", "owner").orderBy(F.col("strength").desc(), "key")
        candidates = candidates.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_owner).drop("_n")

    def choose(g: pd.DataFrame) -> list[int]:
        regions, covered, out = {}, set(), []
        worth = [dict(zip(t, w, strict=True)) for t, w in zip(g["terms"], g["weights"], strict=True)]
        for i in g.sort_values(["strength", "key"], ascending=[False, True]).index:
            r = g.loc[i, "region"]
            if len(out) < k and regions.get(r, 0) < per_region and (g.loc[i, "strength"] > 0):
                regions[r] = regions.get(r, 0) + 1
                out.append(i)
                covered |= set(worth[i])
        while len(out) < k:
            gains = [(sum(w for t, w in worth[i].items() if t not in covered), -i) for i in range(len(g)) if i not in out]
            if not gains or max(gains)[0] <= 0:
                break
            i = -max(gains)[1]
            out.append(i)
            covered |= set(worth[i])
        return out

    return _by_request(candidates, [F.col("strength").desc(), F.col("key")], choose, MOST_PACKETS)


def whole_originals(owners: DataFrame, max_bytes: int = WHOLE_BYTES, most: int = WHOLE_PATHS) -> DataFrame:
    """(request, key, position): originals (request, key, rank, bytes) admitted whole, in order of rank, without refill: one that is too large is skipped and later ones are tried."""

    def choose(g: pd.DataFrame) -> list[int]:
        used, out = 0, []
        for i in g.sort_values(["rank", "key"]).index:
            if len(out) < most and used + g.loc[i, "bytes"] <= max_bytes:
                used += g.loc[i, "bytes"]
                out.append(i)
        return out

    return _by_request(owners, [F.col("rank"), F.col("key")], choose, WHOLE_OWNERS)


def bundles(passages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(assertion_id, role, passage_id) of bundles from passages (assertion_id, passage_id, supports, contradicts, current, path, start, support_group).

    Order: current first, path, start. The first passage that both contradicts and supports, else the first that
    contradicts; then the first of at most two support groups, mixed passages left out; no support, no bundle. paths
    (path_id, connected), as access.connected_paths gives them, leave bundles to assertions whose path is connected.
    """
    if paths is not None:
        passages = passages.join(paths.filter("connected").select(F.col("path_id").alias("assertion_id")), "assertion_id", "left_semi")
    order = [~F.col("current"), F.col("path"), F.col("start"), F.col("passage_id")]
    against = passages.filter("contradicts").withColumn("n", F.row_number().over(Window.partitionBy("assertion_id").orderBy(~F.col("supports"), *order))).filter("n = 1")
    pro = passages.filter("supports and not contradicts")
    first = pro.withColumn("n", F.row_number().over(Window.partitionBy("assertion_id", "support_group").orderBy(*order))).filter("n = 1")
    two = first.withColumn("n", F.row_number().over(Window.partitionBy("assertion_id").orderBy(*order))).filter("n <= 2")
    out = two.select("assertion_id", F.lit("supports").alias("role"), "passage_id").unionByName(against.select("assertion_id", F.lit("contradicts").alias("role"), "passage_id"))
    has = passages.filter("supports").select("assertion_id").distinct()
    return out.join(has, "assertion_id", "left_semi")


def reply_errors(replies: DataFrame, originals: DataFrame) -> DataFrame:
    """(request, key, start, end, reason) of a reply's ranges (request, key, start, end) that don't hold against the originals that were shown (request, key, text):
    not shown, empty, outside, inside a character, or given twice (then once for the range)."""
    rows = replies.groupBy("request", "key", "start", "end").agg(F.count("*").alias("n")).join(originals.withColumn("shown", F.lit(True)), ["request", "key"], "left")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    cuts = ~F.is_valid_utf8(F.substring(raw, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("string"))
    reason = (
        F.when(F.col("shown").isNull(), "not shown").when(F.col("end") <= F.col("start"), "empty").when((F.col("start") < 0) | (F.col("end") > F.octet_length(raw)), "outside").when(cuts, "inside a character").when(F.col("n") > 1, "twice")
    )
    return rows.select("request", "key", "start", "end", reason.alias("reason")).filter("reason is not null")
