"""Fill-in-middle, nearest neighbours and conversation repair against brute force, with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, fill_in_middle, multi_index, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_conversation_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def middle_by_hand(ident, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return ident, n, "plain", None, None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return ident, n, form, p, m, s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def test_fill_in_middle_equals_python(spark):
    rng = random.Random(11)
    rows = [(None, "null id."), (None, None), (1, None), (2, ""), (3, "a<P>b"), (4, "x <S"), (4, "x <S"), (5, "<M>"), (6, "<<S <P <M"), (7, "\n\r\n\x0b"), (8, "éß 日本😀 naïve")]
    rows += [(i, "".join(rng.choice(["ab", "Z", " ", "<", "P", ">", "é", "😀", "\n", "\t", "0", ". "]) for _ in range(rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 200, 1000])))) for i in range(20, 220)]
    rows += [(300, "word, " * 100_000), (301, "x" * 200_000), (302, "😀" * 50_000)]
    docs = spark.createDataFrame([(i, t, "mine", [1], "p") for i, t in rows], "doc_id long, text string, blocks string, n array<int>, row string").repartition(3)
    made = fill_in_middle.fill_in_middle(docs)
    got = [tuple(r) for r in made.select("row.doc_id", "n", "form", "prefix", "middle", "suffix", "output", "restored").collect()]
    assert Counter(got) == Counter(middle_by_hand(*r) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert made.select("row.*").columns == docs.columns and made.select("row.n").first()[0] == [1]
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def neighbours_by_hand(rows, k):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in fine:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in fine if (i, x) != (q, v) and len(x) == len(v))
            out[q, v] = near[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_with_odd_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(multi_index, "UNIT", 16)
    monkeypatch.setattr(multi_index, "SHORTLIST", 40)
    rng = np.random.default_rng(5)
    point = lambda: [float(np.float32(x)) for x in rng.normal(size=6)]
    same, far = point(), [float(np.float32(1e30))] + [0.0] * 5
    rows = [(i, point()) for i in range(200)] + [(i, same) for i in range(200, 400)] + [(400, far), (401, [-x for x in far])]
    rows += [(410, [1.0, 2.0]), (411, [1.0, 2.5]), (420, [3.0]), (430, None), (431, []), (440, [0.0] * 6), (441, [float("nan")] * 6), (450, [float("inf")] + [1.0] * 5), (451, [None] + [1.0] * 5), (None, point()), (10, rows[10][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, node string, cell int").repartition(4)
    got = found(multi_index.neighbours(table, F.col("vec_id") % 10 == 0))
    want = neighbours_by_hand(rows, 10)
    assert set(got) == {q for (q, _), near in want.items() if near}
    for (q, _), near in want.items():
        assert [(r, i) for r, _, i in got.get(q, [])] == [(r + 1, i) for r, (_, i) in enumerate(near)]
        assert np.allclose([s for _, s, _ in got.get(q, [])], [s for s, _ in near], rtol=1e-12, atol=0)
    assert multi_index.neighbours(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("clusters", [0, 40])
def test_neighbours_recall(spark, clusters):
    """At least nine in ten of the true neighbours, for vectors without and with structure; with it the second round takes a small part."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 24)) if not clusters else rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 6000)] * 3 + rng.normal(size=(6000, 24)) * 0.2
    x = x.astype("<f4").astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = found(multi_index.neighbours(table, F.col("vec_id") % 100 == 0))
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for _, _, i in got[q]})
        assert [r for r, _, _ in got[q]] == list(range(1, 11)) and [s for _, s, _ in got[q]] == sorted(s for _, s, _ in got[q])
    assert hits >= 0.9 * 600


def test_second_round_leaves_out_what_cannot_matter():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 5000)] * 5 + rng.normal(size=(5000, 16)) * 0.1
    halves = x[:, :8], x[:, 8:]
    index = multi_index.Index(16, False, 0, tuple(multi_index.centroids(h, 32) for h in halves))
    at = [multi_index.nearest(h, c) for h, c in zip(halves, index.books, strict=True)]
    left = [((h - c[a]) ** 2).sum(axis=1) for h, c, a in zip(halves, index.books, at, strict=True)]
    cell, of = np.unique(at[0] * 32 + at[1], return_inverse=True)
    index.learn(cell, np.bincount(of), np.bincount(of, left[0]), np.bincount(of, left[1]))
    d = index.distances(x[0])
    assert index.size[index.shortlist(*d)].sum() >= multi_index.SHORTLIST
    sums = (d[0][:, None] + d[1]).ravel()
    assert sums[index.shortlist(*d)].max() <= np.delete(sums, index.shortlist(*d))[index.size[np.delete(np.arange(1024), index.shortlist(*d))] > 0].min()
    assert index.size[index.remaining(*d, 0.5)].sum() < 500
    assert index.size[index.remaining(*d, float("inf"))].sum() + index.size[index.shortlist(*d)].sum() == 5000


def repaired_by_hand(rows, every=False):
    """By a search over edits in the order of (cost, audit); `every`: no two ways to a state are taken for one."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        talks[conv] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = [t for t, _, _ in talk if t is not None]
        faults, seen = [], set()
        for _, role, text in talk:
            end = re.sub("[\x20\x09-\x0d]+\\Z", "", text)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in talk]
        heap, done = [(0, "", 0, "")], set()
        while True:
            cost, audit, at, roles = heapq.heappop(heap)
            if at == len(talk) and re.fullmatch("(s?(ua)+)?", roles):
                break
            state = (at, roles, audit) if every else (at, roles[-1:])
            if state in done:
                continue
            done.add(state)
            moves = [(2, "I", at, "u"), (2, "I", at, "a")]
            if at < len(talk):
                moves.append((3, "D", at + 1, ""))
                if faults[at] in ("", "truncated"):
                    extra = int(faults[at] == "truncated")
                    moves += [(extra, "K", at + 1, initials[at] or "?"), (2 + extra, "R", at + 1, "u"), (2 + extra, "R", at + 1, "a")]
            for more, edit, to, role in moves:
                if re.fullmatch("s?(ua)*u?", roles + role):
                    heapq.heappush(heap, (cost + more, audit + edit, to, roles + role))
        lines, left, roles = [], iter(talk), iter(roles)
        for edit in audit:
            row = next(left) if edit != "I" else (None, "", "")
            if edit != "D":
                name = {"u": "user", "a": "assistant"}.get(next(roles))
                lines.append(f"{row[1] if edit == 'K' else name}:{row[2]}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        yield (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, k string, copy string, initial int"


@pytest.mark.parametrize("long", [4096, 40, 3])
def test_repair_equals_search(spark, monkeypatch, long):
    """Whole and in segments, with ties, nulls, odd roles, repeated rows and a conversation that has a good part of all rows."""
    monkeypatch.setattr(conversation_repair, "LONG", long)
    rng = random.Random(long)
    words = ["Hi.", "ok", "what? ", "", None, "  \t", "né! ", "a.b", "same.", "same.", "one\ntwo", "\x0bend.\x0c"]
    rows = []
    for conv in [*range(40), None]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            rows.append((conv, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]), rng.choice([*words, f"text {t}."])))
    rows += [(50, i, ["user", "assistant"][i % 2] if rng.random() < 0.8 else "system", rng.choice(["x.", "y", f"w{i}.", f"q{i}."])) for i in range(150)]
    rows += [(51, 7, "user", "again.")] * 50 + [(52, 3, "user", "long " * 2000)]
    table = spark.createDataFrame([(*r, "k", "c", 9) for r in rows], SCHEMA).repartition(5)
    assert sorted(map(repr, map(tuple, conversation_repair.repair(table).collect()))) == sorted(map(repr, repaired_by_hand(rows)))
    assert conversation_repair.repair(table.limit(0)).collect() == []


def test_repair_of_short_conversations_equals_all_edits(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "ok", "", f"t{t}."])) for c in range(120) for t in range(rng.choice([1, 2, 3]))]
    table = spark.createDataFrame([(*r, "k", "c", 9) for r in rows], SCHEMA)
    assert sorted(map(repr, map(tuple, conversation_repair.repair(table).collect()))) == sorted(map(repr, repaired_by_hand(rows, True)))
