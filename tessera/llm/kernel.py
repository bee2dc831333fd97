"""Array kernels over the UTF-8 bytes of many texts at once: word hashes, shingles, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and its inverse modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", MULT), ("down", INVERSE)):
            a = np.full(m, base)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"][:n], _powers["down"][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with (P[j] - P[i]) * MULT**-i a hash of data[i:j] that is the same wherever the bytes stand."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=out[1:])
    return out


def runs(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges [i, j) of ascending places that are less than most apart each."""
    out, i = [], 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + most, side="left"))
        out.append((i, max(j, i + 1)))
        i = out[-1][1]
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, most: int, over: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each piece, its place in the text, bytes, offsets of pieces) of texts, some most bytes at a time.

    A text of more than most bytes is several pieces, each with `over` bytes of the one behind it.
    """
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        size = int(offsets[j] - offsets[i])
        if j > i + 1 or size <= most + over:
            yield np.arange(i, j), np.zeros(j - i, np.int64), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        else:
            for a in range(0, size - over, most):
                part = data[offsets[i] + a : offsets[i] + min(size, a + most + over)]
                yield np.array([i]), np.array([a]), part, np.array([0, len(part)])
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of each text's first word and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts, stops = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    p = prefix_hash(LOWER[data])
    _, down = powers(n + 1)
    return mix((p[stops] - p[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, their offsets).

    Shingles are k words in a row; a text with fewer words has one, all of them; one without words has none.
    """
    h, first = words(data, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at, end = np.arange(len(h)), first[1:][doc]
    acc = np.zeros(len(h), np.uint64)
    for j in range(k):
        term = np.zeros(len(h), np.uint64)
        if j < len(h):
            term[: len(h) - j] = h[j:]
        term *= U((2 * j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        term[at + j >= end] = 0
        acc += term
    kept = (at + k <= end) | ((at == first[:-1][doc]) & (n_words[doc] < k))
    acc, doc = mix(acc[kept]), doc[kept]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    acc, doc = acc[new], doc[new]
    return acc, np.searchsorted(doc, np.arange(len(n_words) + 1))
