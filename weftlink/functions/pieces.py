"""Pieces of texts as 64-bit hashes, over whole batches of texts: in Python what the columns of weftlink.functions.text give.

A bag is (codes, row, at, count): distinct codes in order, and for each row and code that it has, by row, the code's place
and how often the row has it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions import text as tx

Bag = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Pieces that are counted at once.
BATCH = 1 << 20


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(32)


def spots(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then n[1] from begin[1], and so on."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def stable(places: np.ndarray) -> np.ndarray:
    """The order that sorts numbers of 31 bits, equal ones as they are; by a sort of plain numbers, which is faster."""
    key = places.astype(np.int64)
    key <<= 32
    key |= np.arange(len(places))
    key.sort()
    key &= 0xFFFFFFFF
    return key


def _windows(texts: list[str], low: int, high: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, code) of all windows of low to high characters; short: a text of fewer than low is one itself."""
    size = np.array([len(s) for s in texts], np.int64)
    start = np.cumsum(size) - size
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owners, codes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for n in range(1 if short else low, high + 1):
        count = np.maximum(size - n + 1, 0) if n >= low else (size == n).astype(np.int64)
        at, h = spots(start, count), np.full(int(count.sum()), n, np.uint64)
        for k in range(n):
            h = _mix(h, points[at + k])
        owners.append(np.repeat(np.arange(len(texts), dtype=np.int32), count))
        codes.append(_mix(h, np.uint64(n)).view(np.int64))
    return np.concatenate(owners), np.concatenate(codes)


def _slices(row: np.ndarray, size: np.ndarray | None = None):
    """Slices of whole rows with about BATCH pieces."""
    edges = np.append(np.append(0, np.flatnonzero(np.diff(row)) + 1), len(row))
    upto = edges if size is None else np.append(0, np.cumsum(size))[edges]
    a = 0
    while a < len(edges) - 1 and len(row):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + BATCH, "right")) - 1)
        yield slice(edges[a], edges[b])
        a = b


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none)


def _counted(row: np.ndarray, at: np.ndarray, count: np.ndarray | None, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, count) with equal rows and places summed, in order; without count each is one. The rows are in order
    already."""
    out = []
    for part in _slices(row):
        base, many = int(row[part.start]), np.ones(part.stop - part.start, np.int64) if count is None else count[part]
        key = (row[part].astype(np.int64) - base) * wide + at[part]
        bits = int(many.max()).bit_length()
        if (int(row[part.stop - 1]) - base + 1) * wide << bits < 1 << 62:
            key = np.sort(key << bits | many)
            key, many = key >> bits, key & (1 << bits) - 1
        else:
            order = np.argsort(key, kind="stable")
            key, many = key[order], many[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        one = key[new]
        out.append(((one // wide + base).astype(np.int32), (one % wide).astype(np.int32), np.add.reduceat(many, new).astype(np.int32)))
    return _joined(out)


def _words(texts: pa.Array, rows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, each word's row, its text's place, and its place among the distinct words)."""
    lists = pc.split_pattern(texts, " ")
    size = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    if "" in words:
        full = ids != words.index("")
        ids, text = ids[full], text[full]
    return words, rows[text], text, ids


def _by_unit(units: list[str], row: np.ndarray, at: np.ndarray, low: int, high: int, short: bool) -> Bag:
    """The windows of each row's units."""
    owner, code = _windows(units, low, high, short)
    codes, place = np.unique(code, return_inverse=True)
    order = stable(owner)
    place = place[order].astype(np.int32)
    size = np.bincount(owner, minlength=len(units))
    begin = np.cumsum(size) - size
    row, at, many = _counted(row, at, None, max(len(units), 1))
    n, out = size[at], []
    for part in _slices(row, n):
        m = n[part]
        out.append(_counted(np.repeat(row[part], m), place[spots(begin[at[part]], m)], np.repeat(many[part].astype(np.int64), m), max(len(codes), 1)))
    return codes, *_joined(out)


def grams(texts: pa.Array, rows: np.ndarray, low: int, high: int) -> Bag:
    coded = texts.dictionary_encode()
    return _by_unit(coded.dictionary.to_pylist(), rows, coded.indices.to_numpy(), low, high, False)


def word_grams(texts: pa.Array, rows: np.ndarray, low: int, high: int) -> Bag:
    words, row, _, at = _words(texts, rows)
    return _by_unit([f" {w} " if w else "" for w in words], row, at, low, high, True)


def word_pairs(texts: pa.Array, rows: np.ndarray) -> Bag:
    words, row, text, at = _words(texts, rows)
    h = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words], np.uint64)
    wide = max(len(words), 1)
    follows = np.append(text[1:] == text[:-1], False)[: len(text)]
    paired = lambda near: at[near].astype(np.int64) * wide + at[near + 1]
    pair = np.unique(paired(np.flatnonzero(follows)))
    codes = np.concatenate([h, _mix(_mix(h[pair // wide], np.uint64(2)), h[pair % wide])]).view(np.int64)
    order = np.argsort(codes)
    spot = np.empty(len(codes), np.int32)
    spot[order] = np.arange(len(codes))
    codes, out = codes[order], []
    for part in _slices(row):
        near = part.start + np.flatnonzero(follows[part])
        asked, place = paired(near), np.empty(len(near), np.int64)
        order = np.argsort(asked)
        place[order] = np.searchsorted(pair, asked[order])  # in order, which is faster
        both, ats = np.concatenate([row[part], row[near]]), np.concatenate([spot[at[part]], spot[len(words) + place]])
        order = stable(both)
        out.append(_counted(both[order], ats[order], None, max(len(codes), 1)))
    return codes, *_joined(out)


def listed(lists: pa.Array, rows: np.ndarray) -> Bag:
    """Of lists of codes."""
    flat = np.repeat(rows, np.diff(lists.offsets.to_numpy()))
    codes, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    return codes, *_counted(flat, at, None, max(len(codes), 1))


def of_column(made: Callable[[Column], Column]) -> tuple[Callable[[Column], Column], Callable, Callable[[Column], Column]]:
    """For a function that gives a text's pieces as a column: (the column to hand over, the bag of its values and rows in
    order, about how many pieces it has). Functions other than those of weftlink.functions.text give hashes in Spark."""
    name, more = getattr(made, "func", made), getattr(made, "keywords", {})
    same = lambda c: c
    if name is tx.grams:
        return same, functools.partial(grams, **more), lambda c: F.length(c) * (more["high"] - more["low"] + 1)
    if name is tx.word_grams:  # each piece about as often as there are lengths
        return same, functools.partial(word_grams, **more), F.length
    if name is tx.word_pairs:
        return same, word_pairs, lambda c: 2 * (F.length(c) - F.length(tx.compact(c)) + 1)
    return lambda c: F.transform(made(c), lambda g: F.xxhash64(g)), listed, lambda c: F.size(made(c))
