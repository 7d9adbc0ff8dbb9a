"""Quality rules on repetition within a document, from word-level suffix arrays.

All documents of a slice are sorted together: suffixes by document and their first three words, then by doubling ranks
among those that are still tied. Common prefixes of neighbours come from the ranks of each doubling. Their intervals
give the maximal repeats: a suffix repeats as far as it agrees with a neighbour, and where the words before both agree
too, the repeat belongs to a longer one. The union of the repeats' spans is the covered part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

#: Words of the shortest repeat that counts; the largest share of words in such repeats; words of the longest repeat;
#: words in repeats that the share lets pass in any text, as where one short line stands twice.
LEAST, COVERED, LONGEST, SPARED = 8, 0.15, 50, 32
#: Base rules: fewest words; the largest percentage of words in repeated three-word windows.
FEWEST, REPEATED = 50, 50
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
STARTS = np.ones(256, np.int64)
STARTS[0x80:0xC0] = 0
SLICE = 1 << 18


def suffix_array(ids: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of word ids (from 1) in the order of (row, words), and the ranks after each doubling with their depths.

    end: for each word, the position behind its row's last word. A suffix that ends first is the smaller one. Where a
    rank was settled at an earlier depth, it is kept, so equal ranks of a depth mean equal words up to that depth.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), []
    at = np.arange(n)
    look = np.append(ids, 0)

    def nth(k: int) -> np.ndarray:
        return np.where(at + k < end, look[np.minimum(at + k, n)], 0)

    base = int(ids.max()) + 1
    if (int(row.max()) + 1) * base**3 < 1 << 62:
        key = ((row * base + ids) * base + nth(1)) * base + nth(2)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
    else:
        second, third = nth(1), nth(2)
        order = np.lexsort((third, second, ids, row))
        new = np.ones(n, bool)
        new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (row, ids, second, third)], axis=0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0)) + 1
    ranks, depth = [(3, rank)], 3
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        sub = np.flatnonzero(tied)
        if not len(sub):
            return order, ranks
        s = order[sub]
        nxt = np.where(s + depth < end[s], rank[np.minimum(s + depth, n - 1)], 0)
        own = rank[s]
        o = np.lexsort((nxt, own))
        s, own, nxt = s[o], own[o], nxt[o]
        order[sub] = s
        split = np.ones(len(sub), bool)
        split[1:] = (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])
        new = new.copy()
        new[sub] = split
        rank = rank.copy()
        rank[s] = np.maximum.accumulate(np.where(split, sub, 0)) + 1
        depth *= 2
        ranks.append((depth, rank))


def common_prefixes(order: np.ndarray, ranks: list[tuple[int, np.ndarray]], ids: np.ndarray, row: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with the one before it in the order; 0 under three words."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[1:].copy(), order[:-1].copy()
    live = np.flatnonzero((ranks[0][1][a] == ranks[0][1][b]) & (a + 3 <= end[a]) & (b + 3 <= end[b]))
    a, b, got = a[live], b[live], np.zeros(len(live), np.int64)
    for depth, rank in reversed(ranks):
        # equal ranks agree on `depth` words or to both ends; only the first counts here
        ok = (a + depth <= end[order[1:][live]]) & (b + depth <= end[order[:-1][live]])
        ok[ok] = rank[a[ok]] == rank[b[ok]]
        a, b, got = a + depth * ok, b + depth * ok, got + depth * ok
    ea, eb = end[order[1:][live]], end[order[:-1][live]]
    for _ in range(2):
        ok = (a < ea) & (b < eb)
        ok[ok] = ids[a[ok]] == ids[b[ok]]
        a, b, got = a + ok, b + ok, got + ok
    out[1:][live] = got
    return out


def _union(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie under a span."""
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, start, start + length)
    return np.maximum.accumulate(reach) > np.arange(n)


def measure(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> dict[str, np.ndarray]:
    """The figures of each row of a slice of texts."""
    rows = len(offsets) - 1
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    starts, ends, per = common.words(data, offsets)
    bounds = np.concatenate([[0], np.cumsum(per)])
    by_words = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
    out = {"n_words": per, "word_chars": sums(np.where(common.SPACE[data], 0, STARTS[data])), "n_symbols": sums(SYMBOL[data]), "n_dup_lines": _dup_lines(data, offsets)}
    hashes, ids = np.unique(common.span_hash(data, starts, ends), return_inverse=True)
    ids = ids.astype(np.int64) + 1
    row = np.repeat(np.arange(rows), per)
    end = np.repeat(bounds[1:], per)
    order, ranks = suffix_array(ids, row, end)
    lcp = common_prefixes(order, ranks, ids, row, end)
    n = len(ids)
    reach = np.zeros(n, np.int64)  # how far the suffix repeats
    if n:
        reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    three = np.flatnonzero(reach >= 3)
    out["n_repeat_words"] = by_words(_union(three, np.full(len(three), 3), n)) if n else np.zeros(rows, np.int64)
    # a suffix one word on from a repeat that is longer by one adds nothing: only left-maximal ones are kept
    first = np.ones(n, bool)
    first[1:] = (row[1:] != row[:-1]) | (reach[1:] >= reach[:-1])
    maximal = np.flatnonzero((reach >= least) & first)
    covered = _union(maximal, reach[maximal], n) if n else np.zeros(0, bool)
    out["n_covered_words"] = by_words(covered) if n else np.zeros(rows, np.int64)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, reach)
    out["longest_repeat"] = longest
    return out


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many lines of each row have a word and equal an earlier line of the row."""
    rows, n = len(offsets) - 1, len(data)
    if not n:
        return np.zeros(rows, np.int64)
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feed + 1]))
    begin = begin[begin < n]
    stop = np.append(begin[1:], n)
    stop = np.where(data[stop - 1] == 10, stop - 1, stop)
    full = np.concatenate([[0], np.cumsum(~common.SPACE[data])])
    some = full[stop] > full[begin]
    begin, stop = begin[some], stop[some]
    if not len(begin):
        return np.zeros(rows, np.int64)
    row = np.searchsorted(offsets, begin, "right") - 1
    h = common.span_hash(data, begin, stop)
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=rows)


def _rules(least: int, covered: float, longest: int, spared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            for a, b in common.slices(offsets, SLICE):
                at = offsets[a : b + 1]
                m = measure(data[at[0] : at[-1]], at - at[0], least)
                base = (m["n_words"] < FEWEST) | (100 * m["n_repeat_words"] > REPEATED * m["n_words"])
                kept = ~base & (m["n_covered_words"] <= np.maximum(covered * m["n_words"], spared)) & (m["longest_repeat"] <= longest)
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                more = ("n_covered_words", "longest_repeat")
                arrays = [pa.array(m[c].astype(np.int64)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *arrays, pa.array(base), pa.array(kept), *[pa.array(m[c].astype(np.int64)) for c in more]],
                    ["doc_id", *names, "base_failed", "kept", *more],
                )

    return run


def repetition_rules(docs: DataFrame, least: int = LEAST, covered: float = COVERED, longest: int = LONGEST, spared: int = SPARED) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_covered_words, longest_repeat (0 if under three words).

    kept: not base_failed, at most `spared` words or a share `covered` of them lie in repeats of `least` words or more,
    and no repeat is longer than `longest` words. Occurrences may overlap and the first counts. A null or empty text has no word and
    so fails the base rules. Repeated rows each get a row; other columns are ignored; no rows give none.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_rules(least, covered, longest, spared), schema)
