"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary is a byte-pair one: pieces are merged in the order of their scores, the leftmost first among equals.
Such an encoding is the one path through a text's pieces on which every two neighbours are what their own
concatenation would be encoded as, for a merge across a boundary depends on the two pieces there alone. So a path is
feasible or not by pairs, and the encoding is the best path in max-plus, where a step to a piece that doesn't go with the one
before it costs infinitely much and any other its piece's score.

A giant text is split into chunks of CHUNK characters at any place. A state at a boundary is the last piece that
starts before it and how far it reaches over it, which the characters around the boundary list. A chunk's transfer
matrix has the best score from each state at its start to each at its end. Matrices are multiplied in max-plus, which
is associative, so a text's chunks can be combined in any grouping; the products give each chunk's entry and exit
states, and every chunk is traced back on its own. A shorter text is one chunk.

Between two places that no piece crosses (a run of spaces begins, or there is a character that is in no longer piece)
the path depends on the characters between them alone: such words are merged many at a time, by arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, lean, sliced, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20  # the largest vocabulary file that is broadcast
CHUNK = 65_536  # characters of a chunk
MEMO = 200_000  # words whose ids a task remembers
WIDE = 256  # characters of the longest word that is merged by arrays; a longer one is walked through piece by piece
SPACE = "▁"
LOW = -(1 << 60)
_NONE = np.int32(1 << 30)
State = tuple[int, str]  # characters that a piece reaches over a boundary, and the piece; "" at the text's start


class PairTable:
    """Which piece two neighbouring symbols merge into: an open-addressed table that is read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, int(4 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.setdiff1d(np.arange(len(keys)), put)
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        slot, out = self._slot(keys), np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        size = sp.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.symbols: dict[str, int] = {}  # pieces by their ids, then characters that are in pieces but are none
        written_, scores = [b""] * size, np.zeros(size, np.int64)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                written_[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unused(i):
                raise ValueError("a vocabulary with unused pieces")
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.symbols[piece] = i
                written_[i] = piece.replace(SPACE, " ").encode()
                scores[i] = round(sp.get_score(i))
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no fallback to bytes")
        pieces = list(self.symbols)
        self.size, self.scores = size, scores
        self.longest = max(map(len, pieces))
        self.widths = np.array([len(x) for x in written_])
        self.at, self.written = np.concatenate([[0], np.cumsum(self.widths)]), np.frombuffer(b"".join(written_), np.uint8)
        for c in sorted({c for p in pieces for c in p} - self.symbols.keys()):
            self.symbols[c] = size + len(self.symbols) - len(pieces)
        self.other = size + len(self.symbols)  # any character that is in no piece
        self.of_char = np.full(0x110000, self.other, np.int32)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        order = np.unique(-scores, return_inverse=True)[1]  # equal scores have equal ranks
        self.ranks = order.astype(np.int32)
        pairs = [(a, b, self.symbols[p]) for p in pieces for k in range(1, len(p)) if (a := self.symbols.get(p[:k])) is not None and (b := self.symbols.get(p[k:])) is not None]
        a, b, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable((a << 32) | b, made.astype(np.int32))
        # places that no piece crosses: before a run of spaces, and around characters that are in no longer piece
        inner = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = [c for c in "\n\t\r" if c not in inner]
        crossed = any(SPACE in p.lstrip(SPACE) for p in pieces)
        stop = re.escape("".join(self.alone))
        self.words = re.compile(f"[{stop}]|{SPACE}+[^{stop}{SPACE}]*|[^{stop}{SPACE}]+" if self.alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not crossed else re.compile("(?s).+")
        self.joints: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the words that are remembered."""
        self.known: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.ends = [0]

    # Words

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of each word's) of words: in each round every word makes its first merge of the best rank."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        live, place = self.of_char[chars], np.arange(len(chars))
        done: list[tuple[np.ndarray, ...]] = []

        def looked_up(at: np.ndarray) -> np.ndarray:
            """What the symbols at these places and after them merge into; those of two words into nothing."""
            there = at[at + 1 < len(live)]
            there = there[of[there] == of[there + 1]]
            made[there] = self.pairs.find(live[there], live[there + 1])
            rank[there] = np.where(made[there] >= 0, self.ranks[made[there]], _NONE)

        made, rank = np.full(len(live), -1, np.int32), np.full(len(live), _NONE, np.int32)
        looked_up(np.arange(len(live)))
        while len(live):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.append(first, len(of)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = best != _NONE
            if not open_.all():
                done.append((place[~open_], live[~open_], of[~open_]))
                live, place, of, made, rank, best = (x[open_] for x in (live, place, of, made, rank, best))
                if not len(live):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])]
            live[at] = made[at]
            stays = np.ones(len(live), bool)
            stays[at + 1] = False
            live, place, of, made, rank = (x[stays] for x in (live, place, of, made, rank))
            at -= np.arange(len(at))
            made[at], rank[at] = -1, _NONE
            before = at[at > 0] - 1
            before = before[of[before] == of[before + 1]]
            looked_up(np.concatenate([before, at]))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        place, live, of = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        place, live, of = place[order], live[order], of[order]
        spelt = np.flatnonzero(live >= self.size)
        if len(spelt):  # characters that are no pieces are spelt in bytes
            raw = [chr(c).encode() for c in chars[place[spelt]].tolist()]
            times = np.ones(len(live), np.int64)
            times[spelt] = [len(x) for x in raw]
            into = np.concatenate([[0], np.cumsum(times)])
            live, of = np.repeat(live, times), np.repeat(of, times)
            put = np.repeat(into[spelt] - np.concatenate([[0], np.cumsum(times[spelt])[:-1]]), times[spelt]) + np.arange(times[spelt].sum())
            live[put] = [self.bytes[b] for x in raw for b in x]
        return live.astype(np.int32), np.searchsorted(of, np.arange(len(words)), side="right")

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has)."""
        if len(self.known) > MEMO:
            self.forget()
        new = list({w for w in words if w not in self.known})
        if new:
            short, wide = [w for w in new if len(w) <= WIDE], [w for w in new if len(w) > WIDE]
            ids, ends = self.merged(short)
            found = [ids, *(self.walk(w) for w in wide)]
            base = self.ends[-1]
            for n, w in enumerate(short + wide):
                self.known[w] = len(self.known)
            self.ends += [base + e for e in ends.tolist()]
            for x in found[1:]:
                self.ends.append(self.ends[-1] + len(x))
            self.parts.append(np.concatenate(found))
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        if not self.parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.array(self.ends)
        at = np.array([self.known[w] for w in words], np.int64)
        count = ends[at + 1] - ends[at]
        into = np.cumsum(count) - count
        return self.parts[0][np.repeat(ends[at] - into, count) + np.arange(count.sum())], count

    # Pieces and states

    def merge(self, text: str) -> list[str]:
        """The symbols of a short text after all merges."""
        out = list(text)
        while len(out) > 1:
            ranks = [self.ranks[i] if (i := self.symbols.get(a + b, self.size)) < self.size else _NONE for a, b in zip(out, out[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == _NONE:
                break
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def joint(self, a: str, b: str) -> bool:
        """Whether piece b can follow piece a, or begin a text if a is empty."""
        found = self.joints.get((a, b))
        if found is None:
            found = self.joints[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def spelling(self, piece: str) -> list[int]:
        i = self.symbols.get(piece, self.size)
        return [i] if i < self.size else [self.bytes[b] for b in piece.encode()]

    def score(self, ids: np.ndarray) -> int:
        return int(self.scores[ids].sum())

    def steps(self, s: str, i: int) -> Iterator[tuple[int, str]]:
        """(end, piece) of what can start at i; a character alone always can."""
        yield i + 1, s[i]
        for j in range(i + 2, min(len(s), i + self.longest) + 1):
            if s[i:j] in self.symbols:
                yield j, s[i:j]

    def around(self, s: str, b: int, end: int) -> list[State]:
        """States at place b of s: pieces that start before b and end in [b, end]."""
        return [(j - b, s[i:j]) for i in range(max(0, b - self.longest), b) for j in range(max(b, i + 1), min(end, i + self.longest) + 1) if j == i + 1 or s[i:j] in self.symbols]

    def spread(self, s: str, states: list[State], base: int, stop: int) -> list[dict[str, np.ndarray]]:
        """For each place of s the last pieces of paths to it and the best scores from each of the states at base, by pieces that start before stop."""
        reach: list[dict[str, np.ndarray]] = [{} for _ in range(len(s) + 1)]
        for k, (x, piece) in enumerate(states):
            row = np.full(len(states), LOW, np.int64)
            row[k] = 0
            old = reach[base + x].get(piece)
            reach[base + x][piece] = row if old is None else np.maximum(old, row)
        for i in range(base, stop):
            for piece, row in reach[i].items():
                for j, new in self.steps(s, i):
                    if self.joint(piece, new):
                        k = self.symbols.get(new, self.size)
                        gained = np.where(row > LOW, row + (self.scores[k] if k < self.size else 0), LOW)
                        old = reach[j].get(new)
                        reach[j][new] = gained if old is None else np.maximum(old, gained)
        return reach

    def trail(self, s: str, state: State, base: int, end: int, piece: str | None, stop: int) -> list[str]:
        """The pieces on the path from a state at base to the place end, with the given last piece if any."""
        last: list[dict[str, tuple[int, str]]] = [{} for _ in range(len(s) + 1)]
        last[base + state[0]][state[1]] = (-1, "")
        for i in range(base, stop):
            for before in list(last[i]):
                for j, new in self.steps(s, i):
                    if self.joint(before, new):
                        last[j].setdefault(new, (i, before))
        if piece is None:
            piece = next(iter(last[end]))
        out = []
        while (end, piece) != (base + state[0], state[1]):
            out.append(piece)
            end, piece = last[end][piece]
        return out[::-1]

    def walk(self, w: str) -> np.ndarray:
        """ids of a word of any length."""
        return np.array([i for p in self.trail(w, (0, ""), 0, len(w), None, len(w)) for i in self.spelling(p)], np.int32)

    # Texts

    def escaped(self, text: str) -> list[str]:
        """The text with its spaces as pieces have them, and one in front; split at characters that look like those."""
        parts = text.split(SPACE)
        return [SPACE + parts[0].replace(" ", SPACE), *(p.replace(" ", SPACE) for p in parts[1:])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); none for an empty one.

        A character that looks like an escaped space is spelt in bytes, so that decoding gives it back.
        """
        words: list[str] = []
        counts, look = [], []
        for text in texts:
            before = len(words)
            if text:
                for n, part in enumerate(self.escaped(text)):
                    if n:
                        look.append(len(words))
                        words.append("")
                    words += self.words.findall(part)
            counts.append(len(words) - before)
        ids, n = self.ids_of(words)
        if look:
            spelt = np.array([self.bytes[b] for b in SPACE.encode()], np.int32)
            at = (np.cumsum(n) - n)[look]
            ids = np.insert(ids, np.repeat(at, len(spelt)), np.tile(spelt, len(look)))
            n[look] += len(spelt)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts that ids, counts of them each, are the pieces of."""
        wide = self.widths[ids]
        into = np.cumsum(wide) - wide
        data = self.written[np.repeat(self.at[ids] - into, wide) + np.arange(wide.sum())].tobytes()
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = (data[i:j].decode() for i, j in zip(ends[:-1], ends[1:], strict=True))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    # A chunk is `left` characters before it, n of its own, and up to longest - 1 that follow.

    def frame(self, s: str, left: int, n: int) -> tuple[int, int]:
        """The first and last places of a chunk that no piece crosses, with room for an entry; (-1, -1) if there is none."""
        cuts = [m.start() for m in self.words.finditer(s, left) if left + self.longest <= m.start() < left + n]
        return (cuts[0], cuts[-1]) if cuts else (-1, -1)

    def entries(self, s: str, left: int) -> list[State]:
        return self.around(s, left, len(s)) if left else [(0, "")]

    def transfer(self, s: str, left: int, n: int) -> tuple[list[State], list[State], np.ndarray]:
        """(states at the start, states at the end, best scores)."""
        enter, leave, end = self.entries(s, left), self.around(s, left + n, len(s)), left + n
        first, last = self.frame(s, left, n)
        out = np.full((len(enter), len(leave)), LOW, np.int64)
        if first < 0:
            reach = self.spread(s, enter, left, end)
            for k, (x, piece) in enumerate(leave):
                row = reach[end + x].get(piece)
                if row is not None:
                    out[:, k] = row
            return enter, leave, out
        ids, _ = self.ids_of(self.words.findall(s[first:last]))
        head = self.spread(s[:first], enter, left, first)[first]
        into = np.max(list(head.values()), axis=0) if head else np.full(len(enter), LOW)
        tail = self.spread(s[last:], [(0, "")], 0, end - last)
        for k, (x, piece) in enumerate(leave):
            row = tail[end - last + x].get(piece)
            if row is not None:
                out[:, k] = np.where(into > LOW, into + self.score(ids) + row[0], LOW)
        return enter, leave, out

    def path(self, s: str, left: int, n: int, enter: State, leave: State) -> np.ndarray:
        """ids of a chunk's pieces on the path from one state to another."""
        end = left + n
        first, last = self.frame(s, left, n)
        spelt = lambda pieces: np.array([i for p in pieces for i in self.spelling(p)], np.int32)
        if first < 0:
            return spelt(self.trail(s, enter, left, end + leave[0], leave[1], end))
        head = self.trail(s[:first], enter, left, first, None, first)
        ids, _ = self.ids_of(self.words.findall(s[first:last]))
        tail = self.trail(s[last:], (0, ""), 0, end - last + leave[0], leave[1], end - last)
        return np.concatenate([spelt(head), ids, spelt(tail)])


Matrix = tuple[list[State], list[State], np.ndarray]


def max_plus(a: Matrix, b: Matrix) -> Matrix:
    """The product of two neighbouring chunks: a's states at its end are b's at its start."""
    at = {state: k for k, state in enumerate(b[0])}
    both = [(k, at[state]) for k, state in enumerate(a[1]) if state in at]
    out = np.full((len(a[0]), len(b[1])), LOW, np.int64)
    for i, j in both:
        np.maximum(out, a[2][:, i : i + 1] + b[2][j : j + 1], out=out)
    return a[0], b[1], np.maximum(out, LOW)


def scan(matrices: list[Matrix]) -> list[Matrix]:
    """Products of the first 1, 2, ... matrices, by doubling: pairs are combined first, as the parts of a scan in parallel are."""
    if len(matrices) == 1:
        return matrices
    pairs = scan([max_plus(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else max_plus(pairs[i // 2 - 1], matrices[i]))
    return out


def boundaries(matrices: list[Matrix]) -> list[State]:
    """The state of the best path at each boundary, the text's start and end included."""
    products = scan(matrices)
    k = int(np.argmax(products[-1][2][0]))
    states = [products[-1][1][k]]
    for before, m in zip(products[-2::-1], matrices[:0:-1], strict=True):
        row = m[2][:, m[1].index(states[-1])]
        at = {state: i for i, state in enumerate(before[1])}
        states.append(max((s for s in m[0] if s in at), key=lambda s: before[2][0, at[s]] + row[m[0].index(s)]))
    return [(0, ""), *reversed(states)]


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(row, ids, n_tokens, score, decoded) of every row; row holds all its columns, decoded is the text from the ids.

    model is a path that the driver reads; its bytes are broadcast. ids are the library's own for texts without the
    character U+2581, which is spelt in bytes here (the library makes it a space). score is the sum of the pieces' scores.
    Null and empty texts have no ids, and a null text stays null when decoded. Texts of more than chunk characters are
    split, their chunks written to the shared folder and traced in tasks of their own; a text's ids meet in its row.
    Repeated rows are encoded alike; null ids and clashing column names are kept in row; an empty table gives an empty one.
    """
    from pathlib import Path

    spark = docs.sparkSession
    raw = Path(model).read_bytes()
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"a vocabulary of more than {MODEL_BYTES} bytes")
    shared = spark.sparkContext.broadcast(raw)

    def codec() -> Codec:
        key = hashlib.sha256(shared.value).digest()
        if _codecs.get("key") != key:
            _codecs.update(key=key, codec=Codec(shared.value))
        _codecs["codec"].forget()  # a worker that goes on to other tasks keeps the vocabulary alone
        return _codecs["codec"]

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kind = rows.schema["row"].dataType.simpleString()
    short = F.coalesce(F.length("text") <= chunk, F.lit(True))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in sliced(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            yield _result(c, b.column("row"), *c.encode([t or "" for t in texts]), texts)
        c.forget()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in sliced(batches, "text", 1 << 20):
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                no = 0
                for p, part in enumerate(c.escaped(text)):
                    for i in range(0, max(len(part), 1), chunk):
                        left, n = min(i, c.longest), min(chunk, len(part) - i)
                        s = part[i - left : i + n + c.longest - 1]
                        enter, leave, scores = c.transfer(s, left, n) if n else ([], [], np.zeros((0, 0), np.int64))
                        yield pa.RecordBatch.from_pylist(
                            [{"rid": rid, "no": no, "part": p, "begins": i == 0, "chars": s, "before": left, "n": n, "enter": _states(enter), "leave": _states(leave), "scores": scores.tobytes()}], schema=CHUNKS
                        )
                        no += 1

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, chunks in zip(b.column("rid").to_pylist(), b.column("chunks").to_pylist(), strict=True):
                chunks.sort(key=lambda x: x["no"])
                of_part: dict[int, list[dict]] = {}
                for x in chunks:
                    of_part.setdefault(x["part"], []).append(x)
                states: list[State] = []
                for mine in of_part.values():
                    if mine[0]["n"]:
                        got = [[(s["over"], s["piece"]) for s in x[k]] for x in mine for k in ("enter", "leave")]
                        found = boundaries([(e, v, np.frombuffer(x["scores"], np.int64).reshape(len(e), len(v))) for x, e, v in zip(mine, got[::2], got[1::2], strict=True)])
                        states += list(zip(found[:-1], found[1:], strict=True))
                    else:
                        states.append(((0, ""), (0, "")))
                yield pa.RecordBatch.from_pylist([{"rid": rid, "no": x["no"], "from": _states([e])[0], "to": _states([v])[0]} for x, (e, v) in zip(chunks, states, strict=True)], schema=pa.schema([("rid", pa.int64()), ("no", pa.int64()), ("from", STATE), ("to", STATE)]))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        looks = np.array([c.bytes[x] for x in SPACE.encode()], np.int32)
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids = c.path(r["chars"], r["before"], r["n"], *((r[k]["over"], r[k]["piece"]) for k in ("from", "to"))) if r["n"] else looks[:0]
                out.append(np.concatenate([looks, ids] if r["begins"] and r["part"] else [ids]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("no"), pa.array(out, pa.binary())], ["rid", "no", "ids"])
        c.forget()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in sliced(batches, "text", 1 << 20):
            ids = [np.frombuffer(b"".join(x["ids"] for x in sorted(v, key=lambda x: x["no"])), np.int32) for v in b.column("chunks").to_pylist()]
            yield _result(c, b.column("row"), np.concatenate(ids), np.array([len(x) for x in ids]), b.column("text").to_pylist())

    schema = f"row {kind}, ids array<int>, n_tokens long, score long, decoded string"
    giants = written(rows.filter(~short).withColumn("rid", F.monotonically_increasing_id()), "giants", few=docs)
    state = "struct<over: int, piece: string>"
    chunks = written(giants.select("rid", "text").mapInArrow(lean(split), f"rid long, no long, part long, begins boolean, chars string, before int, n int, enter array<{state}>, leave array<{state}>, scores binary"), "chunks", few=docs)
    states = chunks.groupBy("rid").agg(F.collect_list(F.struct("no", "part", "n", "enter", "leave", "scores")).alias("chunks")).mapInArrow(lean(bound), f"rid long, no long, from {state}, to {state}")
    paths = chunks.select("rid", "no", "part", "begins", "chars", "before", "n").join(states, ["rid", "no"])
    ids = paths.mapInArrow(lean(traced), "rid long, no long, ids binary").groupBy("rid").agg(F.collect_list(F.struct("no", "ids")).alias("chunks"))
    long_ones = giants.join(ids, "rid").select("row", "text", "chunks").mapInArrow(lean(joined), schema)
    return bounded(rows.filter(short)).mapInArrow(lean(whole), schema).unionByName(long_ones)


_codecs: dict = {}
STATE = pa.struct([("over", pa.int32()), ("piece", pa.string())])
CHUNKS = pa.schema([("rid", pa.int64()), ("no", pa.int64()), ("part", pa.int64()), ("begins", pa.bool_()), ("chars", pa.string()), ("before", pa.int32()), ("n", pa.int32()), ("enter", pa.list_(STATE)), ("leave", pa.list_(STATE)), ("scores", pa.binary())])


def _states(states: list[State]) -> list[dict]:
    return [{"over": x, "piece": piece} for x, piece in states]


def _result(c: Codec, row: pa.Array, ids: np.ndarray, counts: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(c.scores[ids])])
    decoded = [None if t is None else d for t, d in zip(texts, c.decode(ids, counts), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([row, lists, pa.array(counts, pa.int64()), pa.array(total[ends[1:]] - total[ends[:-1]]), pa.array(decoded, pa.string())], ["row", "ids", "n_tokens", "score", "decoded"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "score", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.col("row.text").eqNullSafe(F.col("decoded")).alias("round_trip"))
