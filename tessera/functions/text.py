"""Text functions over UTF-8 bytes: tokens with spans, readable text, segments, blocks, excerpts, quotes, links.

Columns are built-in functions where those can say it. What needs a scanner is a plain function over bytes, run by
mapInArrow on whole batches; spans are half-open byte offsets [start, end) that fall on characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.model import TOKEN, fold

#: Grammatical words that say little about where a passage is; negations and restrictions are not among them.
FUNCTION_WORDS = (
    "a", "an", "the", "and", "or", "but", "as", "at", "by", "for", "from", "in", "into", "of", "on", "onto", "to", "with", "about", "after", "before", "between",
    "during", "over", "through", "how", "what", "when", "where", "which", "who", "whom", "whose", "why", "i", "me", "my", "we", "us", "our", "you", "your", "he", "him",
    "his", "she", "her", "it", "its", "they", "them", "their", "this", "that", "these", "those", "there", "here", "am", "is", "are", "was", "were", "be", "been", "being",
    "do", "does", "did", "have", "has", "had", "having", "can", "could", "would", "should", "will", "shall", "may", "might", "if", "then", "than", "also", "each", "some",
    "any", "such",
)
_TOKEN = regex.compile(TOKEN)
_HEADING = re.compile(r"^(#{1,6}) (.*)$")
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
_BLANK = re.compile(rb"(?m)^(?:\r*\n|\r+\Z)")
#: Where a token stands as a name: after one of `_-/\\: or before one of `_-( or after a dot that ends a word or, without a dot before it, before one that begins a word.
_NAMED = re.compile(r"(?<![^\W_])(?:(?<=[`_\-/\\:])[^\W_]+|[^\W_]+(?=[`_\-(])|(?<=\w\.)[^\W_]+|(?<!\.)[^\W_]+(?=\.\w))")


#: Of what a Python task holds or hands on at a time: results, bytes of kept columns, and groups of rows.
PIECE_ROWS, PIECE_BYTES, PIECE_GROUPS = 8192, 4 << 20, 256


def mapped(df: DataFrame, run: Callable, inputs: tuple[str, ...], schema: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows keep + one or many results of run(*inputs) for each row; run returns a list of tuples for schema.

    Results go on in pieces of PIECE_ROWS rows and PIECE_BYTES of kept columns, which are repeated for each result, so that neither many results nor wide rows add up.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    target = df.sparkSession.createDataFrame([], schema).schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)

        def piece(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            picked = [b.column(c).take(pa.array(at, pa.int64())) for c in keep]
            made = [pa.array([r[j] for r in rows], arrow.field(j).type) for j in range(len(names))]
            return pa.RecordBatch.from_arrays([*picked, *made], [*keep, *names])

        for b in batches:
            at, rows, held = [], [], 0
            for i in range(b.num_rows):
                wide = sum(b.column(c).slice(i, 1).nbytes for c in keep)
                for r in run(*[b.column(c)[i].as_py() for c in inputs]):
                    at.append(i)
                    rows.append(r)
                    held += wide
                    if len(rows) >= PIECE_ROWS or held >= PIECE_BYTES:
                        yield piece(b, at, rows)
                        at, rows, held = [], [], 0
            yield piece(b, at, rows)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(go, f"{kinds}, {schema}")


def folded(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """Rows key + results of run for the rows of each key, which it gets as a list of tuples of the other columns, in no order; run returns a list of tuples for schema.

    For many keys of few rows: a key costs its rows, no table of its own. All rows of a key are in one list.
    """
    names, rest = [x.split()[0] for x in schema.split(", ")], [c for c in df.columns if c != key]
    target = df.sparkSession.createDataFrame([], schema).schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for whole in batches:
            for first in range(0, whole.num_rows, PIECE_GROUPS):
                b = whole.slice(first, PIECE_GROUPS)
                lists = b.column("rows")
                flat = lists.flatten()
                members = list(zip(*[flat.field(c).to_pylist() for c in rest], strict=True))
                at, rows, n = [], [], 0
                for i, size in enumerate(pc.list_value_length(lists).to_pylist()):
                    for r in run(members[n : n + size]):
                        at.append(i)
                        rows.append(r)
                    n += size
                made = [pa.array([r[j] for r in rows], arrow.field(j).type) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *made], [key, *names])

    grouped = df.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    return grouped.mapInArrow(go, f"{key} {dict(df.dtypes)[key]}, {schema}")


def token_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(token, start, end): runs of letters and digits and marks inside them, folded, with their byte spans."""
    out, at, byte = [], 0, 0
    text = text or ""
    for m in _TOKEN.finditer(text):
        byte += len(text[at : m.start()].encode())
        size = len(m.group().encode())
        out.append((fold(m.group()), byte, byte + size))
        byte, at = byte + size, m.end()
    return out


def char_start(raw: bytes, i: int) -> int:
    """i or the first character start after it."""
    while i < len(raw) and raw[i] & 0xC0 == 0x80:
        i += 1
    return i


def char_end(raw: bytes, i: int) -> int:
    """i or the last character start before it."""
    i = min(i, len(raw))
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i


def term_key(t: Column) -> Column:
    """A light stem: of ASCII terms of 5 and more, ing, ed or s goes, then e, if 4 letters are left."""
    can = t.rlike(r"^[\x00-\x7F]{5,}$")
    base = (
        F.when(t.rlike("^.{4,}ing$"), F.regexp_replace(t, "ing$", "")).when(t.rlike("^.{4,}ed$"), F.regexp_replace(t, "ed$", "")).when(t.rlike("^.{3,}[^s]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)
    )
    return F.when(can, F.when(base.rlike("^.{4,}e$"), F.regexp_replace(base, "e$", "")).otherwise(base)).otherwise(t)


def is_function_word(t: Column) -> Column:
    return t.isin(*sorted(FUNCTION_WORDS))


def content_terms(query: str) -> list[str]:
    """A query's distinct tokens in order without function words, but for those that its marks show to be names (_NAMED)."""
    named = {m.start() for m in _NAMED.finditer(query)}
    terms = ((fold(m.group()), m.start()) for m in _TOKEN.finditer(query))
    return list(dict.fromkeys(t for t, at in terms if at in named or t not in FUNCTION_WORDS))


def literal_spans(text: str | None, needle: str, most: int = 64) -> list[tuple[int, int]]:
    """Byte spans of the first places of needle that don't overlap."""
    raw, n, out, i = (text or "").encode(), needle.encode(), [], 0
    while n and len(out) < most and (i := raw.find(n, i)) >= 0:
        out.append((i, i + len(n)))
        i += len(n)
    return out


def literal_starts(text: Column, needle: str, most: int = 64) -> Column:
    """literal_spans() as columns: the byte starts of the first places of needle that don't overlap."""
    parts = F.split(text, "\\Q" + needle + "\\E", most + 1)
    sizes = F.transform(parts, lambda p: F.octet_length(p).cast("long") + len(needle.encode()))
    to = F.sequence(F.lit(1), F.size(parts) - 1)
    starts = F.transform(to, lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x) - len(needle.encode()))
    return F.when(F.size(parts) > 1, starts).otherwise(F.array().cast("array<bigint>"))


def unique_start(text: Column, quote: Column) -> Column:
    """unique_quote() as a column: the byte start of quote if it stands exactly once in the text, overlaps counted; else null."""
    at = F.instr(text, quote)
    once = (at > 0) & (F.position(quote, text, at + 1) == 0)
    return F.when((F.length(quote) > 0) & once, F.octet_length(F.left(text, at - 1)).cast("long"))


def unique_quote(text: str | None, quote: str, start: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """The byte span of quote if it stands exactly once in the window, overlaps counted."""
    raw, q = (text or "").encode()[start:end], quote.encode()
    i = raw.find(q) if q else -1
    if i < 0 or raw.find(q, i + 1) >= 0:
        return None
    return start + i, start + i + len(q)


def readable(text: str | None) -> list[tuple[str, int, int]]:
    """(run, start, end): readable runs of HTML with the byte spans they came from; no tags, comments, scripts or styles."""
    raw, out, i = (text or "").encode(), [], 0
    low = raw.lower()
    while i < len(raw):
        lt = raw.find(b"<", i)
        run = raw[i : lt if lt >= 0 else len(raw)]
        if run.strip():
            a = i + len(run) - len(run.lstrip())
            out.append((run.strip().decode(errors="replace"), a, a + len(run.strip())))
        if lt < 0:
            break
        if raw.startswith(b"<!--", lt):
            end = raw.find(b"-->", lt)
            i = len(raw) if end < 0 else end + 3
            continue
        end = raw.find(b">", lt)
        i = len(raw) if end < 0 else end + 1
        for name in (b"script", b"style"):
            if low.startswith(b"<" + name, lt) and not raw[lt:i].endswith(b"/>"):
                close = low.find(b"</" + name, i)
                i = len(raw) if close < 0 else max(i, raw.find(b">", close) + 1 or len(raw))
    return out


_FENCED = re.compile(rb"(?m)^ {0,3}(?:`{3,}|~{3,})[^\n]*\n?")
#: What Markdown puts around readable text: marks of headings, items and quotes, images' and links' brackets and targets, code marks, emphasis, HTML.
_MARKS = re.compile(
    rb"(?m)<!--(?s:.*?)-->|<(?:script|style)\b(?s:.*?)</(?:script|style)\s*>|</?[A-Za-z][^>\n]*>|^ {0,3}#{1,6}[ \t]+|[ \t]+#+[ \t]*$|^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+|^ {0,3}>[ \t]?|"
    rb"\[\[[^\]|\n]*\||\[\[|\]\]|!?\[(?=[^\]\n]*\]\()|\]\([^)\n]*\)|`+|\*{1,3}|(?<![A-Za-z0-9])_{1,3}|_{1,3}(?![A-Za-z0-9])"
)


def readable_markdown(text: str | None) -> list[tuple[str, int, int]]:
    """(run, start, end): readable runs of Markdown with the byte spans that they are, line by line; without marks, targets of links, comments, scripts, styles and fence lines."""
    raw, out, at = (text or "").encode(), [], 0
    holes = sorted([m.span() for m in _FENCED.finditer(raw)] + [m.span() for m in _MARKS.finditer(raw)])
    for a, b in [*holes, (len(raw), len(raw))]:
        for line in _LINE.finditer(raw, at, max(a, at)):
            run = line.group().strip()
            if run:
                start = line.start() + len(line.group()) - len(line.group().lstrip())
                out.append((run.decode(), start, start + len(run)))
        at = max(at, b)
    return out


def heading(line: str) -> tuple[int, str] | None:
    m = _HEADING.match(line)
    return (len(m[1]), m[2].strip().rstrip("#").strip()) if m else None


def heading_chains(raw: bytes) -> tuple[list[int], list[list[str]]]:
    """(starts of heading lines, with each the labels of the headings that it stands under, its own the last)."""
    starts, chains, above = [], [], []
    for line in _LINE.finditer(raw):
        h = heading(line.group().rstrip(b"\r\n").decode(errors="replace"))
        if h:
            above = [x for x in above if x[0] < h[0]] + [h]
            starts.append(line.start())
            chains.append([label for _, label in above])
    return starts, chains


def segments(text: str | None, capacity: int) -> list[tuple[int, int, int, list[str]]]:
    """(ordinal, start, end, headings): the text cut at the last heading inside the capacity, else after the last blank line, else at a character.

    No overlap and nothing lost; headings are those above the segment's first line, its own included. An empty or null
    text is one empty segment.
    """
    raw = (text or "").encode()
    starts, chains = heading_chains(raw)
    cuts = [0]
    while cuts[-1] < len(raw):
        at = cuts[-1]
        most = char_end(raw, at + capacity)
        if most <= at:
            raise ValueError("the capacity can't hold a character")
        if most < len(raw):
            last = bisect_left(starts, most) - 1  # the last heading that fits
            blank = [m.end() for m in _BLANK.finditer(raw[at:most])]
            most = starts[last] if last >= 0 and starts[last] > at else at + blank[-1] if blank else most
        cuts.append(most)
    of = [chains[k - 1] if (k := bisect_right(starts, at)) else [] for at in cuts]
    return [(i, at, end, of[i]) for i, (at, end) in enumerate(zip(cuts, cuts[1:] or [0], strict=False))]


_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(rb" {0,3}([-*+]|\d{1,9}[.)])[ \t\n]")
_RULE = re.compile(rb" {0,3}([-*_])[ \t]*(\1[ \t]*){2,}\r?\n?$")
_UNDERLINE = re.compile(rb" {0,3}(=+|-+)[ \t]*\r?\n?$")


def blocks(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a Markdown text's outer blocks: heading, prose, code (fenced or indented), list.

    A fence is closed by one of its kind that is no shorter; what a list or a quote holds belongs to it, a quote being prose; an underline
    makes a heading of the prose before it; a rule is no block and ends one. Lines that follow prose without a blank continue it.
    """
    raw, out, fence, blank = (text or "").encode(), [], b"", True

    def grow(kind: str, line: re.Match, new: bool) -> None:
        if new or not out or out[-1][0] != kind:
            out.append([kind, line.start(), line.end()])
        out[-1][2] = line.end()

    for line in _LINE.finditer(raw):
        s = line.group()
        last = out[-1][0] if out and (not blank or out[-1][0] in ("list", "code")) else None
        mark = _FENCE.match(s)
        if fence:
            grow(last, line, False)
            if mark and mark[1].startswith(fence) and not s[mark.end() :].strip():
                fence = b""
            blank = False
            continue
        if not s.strip():
            blank = True
            continue
        inside = last == "list" and (s[:1] in (b" ", b"\t") or not blank and not mark)
        if mark and not inside:
            fence = mark[1]
            grow("code", line, True)
        elif heading(s.decode(errors="replace").rstrip("\r\n")):
            grow("heading", line, True)
        elif last == "prose" and not blank and _UNDERLINE.match(s) and raw[out[-1][1] : out[-1][1] + 1] != b">":
            out[-1][0], out[-1][2] = "heading", line.end()
        elif _RULE.match(s):
            blank = True
            out.append(["rule", line.start(), line.end()])
            continue
        elif inside or _ITEM.match(s):
            fence = mark[1] if mark else b""
            grow("list", line, last != "list")
        elif s.startswith((b"    ", b"\t")) and last != "prose":
            grow("code", line, blank and last != "code" or last is None)
        else:
            grow("prose", line, blank)
        blank = False
    return [tuple(b) for b in out if b[0] != "rule"]


def teaching_blocks(found: list[tuple[str, int, int]], capacity: int, tiny: int = 48, run: int = 8) -> list[tuple[str, int, int]]:
    """Blocks in groups of at most capacity bytes, by one rule for a group and the block behind it.

    Prose takes the code or list that follows and becomes of its kind; prose of at most tiny bytes takes prose too, and what can't
    take anything joins prose before it. Code takes up to run blocks of code and prose; prose with no code behind it is the last.
    """
    groups: list[list] = []  # kind, start, end, blocks that it may still take

    def settled() -> None:
        """The last group is complete: left-over tiny prose goes to the prose before it."""
        if len(groups) > 1 and groups[-1][0] == "prose" and groups[-1][3] and groups[-1][2] - groups[-1][1] <= tiny:
            before, last = groups[-2:]
            if before[0] == "prose" and last[2] - before[1] <= capacity:
                groups[-2:] = [["prose", before[1], last[2], 0]]

    for (kind, start, end), behind in zip(found, [*(b[0] for b in found[1:]), None], strict=False):
        if groups and groups[-1][3] and end - groups[-1][1] <= capacity:
            group = groups[-1]
            small = group[2] - group[1] <= tiny
            if group[0] == "code" and kind in ("prose", "code"):
                groups[-1] = ["code", group[1], end, 0 if kind == "prose" and behind != "code" else group[3] - 1]
                continue
            if group[0] == "prose" and (kind in ("code", "list") or small and kind != "heading"):
                groups[-1] = [kind, group[1], end, run if kind == "code" else 0]
                continue
        settled()
        groups.append([kind, start, end, {"prose": 1, "code": run}.get(kind, 0)])
    settled()
    return [(kind, start, end) for kind, start, end, _ in groups]


def excerpt_window(raw: bytes, anchor: int, size: int) -> tuple[int, int]:
    """A window of at most size bytes that begins a third of them before the anchor."""
    start = char_start(raw, max(0, anchor - size // 3))
    return start, max(start, char_end(raw, min(len(raw), start + size)))


def query_matches(text: str | None, query: str, size: int, most: int = 64) -> list[tuple[int, int]]:
    """Byte spans that an excerpt of size bytes should show.

    Places of the whole query, if it has several tokens, that take at most two thirds of the window; else the
    occurrences in the window, begun at one, with the highest sum of weights of its distinct terms, the earliest such;
    a term's weight is round((1 + ln(tokens / occurrences)) * 1e6). The window's anchor comes first.
    """
    raw, phrase = (text or "").encode(), [t for t, _, _ in token_spans(query)]
    spans = token_spans(text)
    term_of = {t: i for i, t in enumerate(dict.fromkeys(phrase))}
    term = np.array([term_of.get(t, -1) for t, _, _ in spans], np.int64)
    start, end = np.array([s[1:] for s in spans], np.int64).reshape(-1, 2).T
    width = len(phrase)
    if 1 < width <= len(spans):
        whole = np.ones(len(spans) - width + 1, bool)
        for j, t in enumerate(phrase):
            whole &= term[j : len(spans) - width + 1 + j] == term_of[t]
        at = np.flatnonzero(whole)
        at = at[end[at + width - 1] - start[at] <= size * 2 // 3][:most]
        if len(at):
            return list(zip(start[at].tolist(), end[at + width - 1].tolist(), strict=True))
    hit = np.flatnonzero(term >= 0)
    if not len(hit):
        return []
    term, start, end = term[hit], start[hit], end[hit]
    low, high = np.array([excerpt_window(raw, a, size) for a in start.tolist()]).T
    first, behind = np.searchsorted(start, low), np.searchsorted(end, high, side="right")
    votes = np.zeros(len(hit), np.int64)
    for t, n in enumerate(np.bincount(term, minlength=len(term_of)).tolist()):
        seen = np.concatenate([[0], np.cumsum(term == t)])
        votes += (seen[behind] > seen[first]) * floor((1 + log(len(spans) / max(n, 1))) * 1e6 + 0.5)
    best = int(votes.argmax())
    rest = [k for k in range(first[best], behind[best]) if k != best]
    return [(int(start[k]), int(end[k])) for k in [best, *rest][:most]]


def excerpt(text: str | None, query: str, size: int) -> list[tuple[str, int, int, int]]:
    """(excerpt, start, end, matches) around the query's best place; nothing if no token is there."""
    found = query_matches(text, query, size)
    if not found:
        return []
    raw = (text or "").encode()
    lo, hi = excerpt_window(raw, found[0][0], size)
    return [(raw[lo:hi].decode(), lo, hi, len(found))]


_LINK = re.compile(r"(?<!\\)\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]|(?<![\\!\]])\[([^\[\]]*)\]\(([^()\s]+)\)")
_CODE = re.compile(r"(?s)```.*?(?:```|\Z)|`[^`\n]*`")


def links(text: str | None) -> list[tuple[int, str, str]]:
    """(start, target, label) of Markdown and [[target|label]] links, byte offsets; those in code or escaped are left out."""
    text = text or ""
    hidden = _CODE.sub(lambda m: " " * len(m.group()), text)
    return [(len(text[: m.start()].encode()), (m[1] or m[4]).strip(), (m[2] or m[3] or "").strip()) for m in _LINK.finditer(hidden)]


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text's bytes [start, end) as a string; null if that cuts a character."""
    raw = F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))


def mapping(lines: list[str]) -> tuple[list[tuple[str, str]], str | None]:
    """(fields, error) of a block of `key: value` lines: nested keys are joined by dots, lists ([a, b] or - items) are JSON arrays.

    Quotes around values go; comments and blank lines are skipped. Errors: a line that is neither, a key that is repeated.
    """
    import json

    values: dict[str, str | list[str]] = {}
    above: list[tuple[int, str]] = []  # indentation and name of the keys that a line may stand under
    error = None
    plain = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    for line in lines:
        part = line.strip()
        indent = len(line) - len(line.lstrip())
        if not part or part.startswith("#"):
            continue
        item = part == "-" or part.startswith("- ")
        while above and (above[-1][0] > indent or above[-1][0] == indent and not item):
            above.pop()
        if item and above and values.get(above[-1][1]) in ("", None) or item and above and isinstance(values.get(above[-1][1]), list):
            name = above[-1][1]
            values[name] = [*(values[name] or []), plain(part[1:].strip())]
            continue
        key, colon, value = part.partition(":")
        if item or not colon or not key.strip():
            error = "not a mapping"
            continue
        name, value = ".".join([*([above[-1][1]] if above else []), plain(key.strip())]), value.strip()
        if name in values:
            error = "repeated key"
        if value.startswith("[") and value.endswith("]"):
            values[name] = [plain(v.strip()) for v in value[1:-1].split(",") if v.strip()]
        else:
            values[name] = plain(value)
        above.append((indent, name))
    return [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in values.items()], error


def parse_note(text: str | None, most: int = 256 * 1024) -> list[tuple[str, list[tuple[str, str]], int, str | None]]:
    """(state, fields, body_start, error) of a note: a mapping() between --- lines, an optional BOM before.

    A note without an envelope is plain; an unterminated, too long or repeated-key envelope is invalid but stays readable.
    """
    raw = (text or "").encode()
    at = 3 if raw.startswith(b"\xef\xbb\xbf") else 0
    if not re.match(rb"---\r?\n", raw[at:]):
        return [("plain", [], at, None)]
    body = re.search(rb"\n---(\r?\n|\Z)", raw[at:])
    if not body:
        return [("invalid", [], 0, "unterminated")]
    if body.start() > most:
        return [("invalid", [], 0, "too long")]
    fields, error = mapping(raw[at : at + body.start()].decode(errors="replace").splitlines()[1:])
    return [("invalid" if error else "record", fields, at + body.end(), error)]


def packet_windows(text: str | None, capacity: int = 12_000, most: int = 16) -> list[tuple[int, int, int, list[str]]]:
    """(ordinal, start, end, headings) of an extraction packet: up to `most` slices cut after the last newline that fits, never between CR and LF.

    A line that is longer than the capacity is cut at a character. headings are those in force at the slice's start.
    """
    raw, out, at, above = (text or "").encode(), [], 0, []
    while at < len(raw) and len(out) < most:
        end = char_end(raw, at + capacity)
        if end < len(raw):
            newline = raw.rfind(b"\n", at, end)
            end = newline + 1 if newline >= at else end
            if raw[end - 1 : end] == b"\r" and raw[end : end + 1] == b"\n" and end - 1 > at:
                end -= 1
        out.append((len(out), at, end, [label for _, label in above]))
        for line in raw[at:end].decode().split("\n"):
            h = heading(line.rstrip("\r"))
            if h:
                while above and above[-1][0] >= h[0]:
                    above.pop()
                above.append(h)
        at = end
    return out


def rewrite_links(text: str | None, old: str, new: str) -> str | None:
    """The text with links to old leading to new; labels, code and escaped links stay."""
    if text is None:
        return None
    raw, out, at = text.encode(), [], 0
    for start, target, _ in links(text):
        if target == old:
            i = raw.index(old.encode(), start if raw.startswith(b"[[", start) else raw.index(b"](", start))
            out += [raw[at:i], new.encode()]
            at = i + len(old.encode())
    return b"".join([*out, raw[at:]]).decode()


_CITATIONS = re.compile(r"(?s)<!-- citations\n(.*?)\n-->")


def page_citations(text: str | None) -> list[tuple[str, str, int, int]]:
    """(source, revision, start, end) of a page's one citation block: a JSON line each; nothing if the block is missing, repeated or broken."""
    import json

    found = _CITATIONS.findall(text or "")
    if len(found) != 1:
        return []
    try:
        rows = [json.loads(line) for line in found[0].splitlines()]
        return [(str(r["source_id"]), str(r["revision"]), int(r["start"]), int(r["end"])) for r in rows]
    except (ValueError, KeyError, TypeError):
        return []


def original_span(runs: list[tuple[str, int, int]], start: int, end: int) -> tuple[int, int] | None:
    """The original bytes of readable bytes [start, end), runs being joined by a newline; none if a run is left or its bytes were changed."""
    at = 0
    for run, a, b in runs:
        size = len(run.encode())
        if at <= start and end <= at + size:
            return (a + start - at, a + end - at) if size == b - a else None
        at += size + 1
    return None
