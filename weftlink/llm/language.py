"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods of each document.

Each language is a distribution over hashed byte trigrams of letters, smoothed towards the mean of all. A document's
trigrams are a mixture of languages; expectation-maximisation finds its proportions. The set of languages grows from the
one with the largest proportion by the next largest, is fitted again each time, and goes on growing, up to all languages,
while the likelihood less PENALTY * log(trigrams) for each language after the first rises. All documents of a slice are
fitted together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

BITS, STEPS, PENALTY, SMOOTH = 14, 12, 2.0, 0.5
SLICE = 1 << 19
#: Letters keep their place; other ASCII is one gap; bytes of longer characters stay.
FOLD = np.where(np.arange(256) >= 0x80, np.arange(256), 0).astype(np.uint8)
FOLD[97:123] = np.arange(1, 27)
FOLD[65:91] = np.arange(1, 27)
LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct trigram buckets of each row, row by row. Trigrams of gaps alone, or across
    rows, don't count; a row of letters stands between two gaps."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    f = np.zeros(len(data) + 2 * rows, np.uint32)  # each row between gaps
    at = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, size)
    f[at] = FOLD[data]
    if len(f) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = f[:-2], f[1:-1], f[2:]
    h = ((a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA6B) + c) * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
    good = (b > 0) | (c > 0) & (a > 0)
    begin = offsets + 2 * np.arange(rows + 1)
    out_row, out_bucket, out_count = [], [], []
    for k in range(rows):
        i, j = int(begin[k]), int(begin[k + 1]) - 2
        if j > i:
            n = np.bincount(h[i:j][good[i:j]], minlength=1 << BITS)
            on = np.flatnonzero(n)
            out_row.append(np.full(len(on), k))
            out_bucket.append(on)
            out_count.append(n[on])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_bucket), np.concatenate(out_count)


@dataclass
class Model:
    """names: the learned languages, in order; p: buckets by languages, each column a distribution."""

    names: list[str]
    p: np.ndarray

    def mixture(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the chosen languages, and of all languages, for each row; zeros without a trigram."""
        rows, k = len(offsets) - 1, len(self.names)
        row, bucket, count = grams(data, offsets)
        chosen, free = np.zeros((rows, k)), np.zeros((rows, k))
        if not len(row) or not k:
            return chosen, free
        like = self.p[bucket]
        n = count.astype(np.float32)
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        seen = row[at]
        inner = np.repeat(np.arange(len(seen)), np.diff(np.append(at, len(row))))

        def fit(pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            total = np.add.reduceat(n, at)
            for _ in range(steps):
                part = like * pi[inner]
                part *= (n / part.sum(1))[:, None]
                pi = np.add.reduceat(part, at) / total[:, None]
            mix = (like * pi[inner]).sum(1)
            return pi, np.add.reduceat(n * np.log(np.maximum(mix, 1e-30)), at), np.log(total)

        pi, _, _ = fit(np.full((len(seen), k), 1 / k, np.float32), STEPS)
        order = np.argsort(-pi, axis=1, kind="stable")
        best, kept, open_ = np.full(len(seen), -np.inf), np.zeros_like(pi), np.arange(len(seen))
        for size in range(1, k + 1):
            mask = np.zeros((len(open_), k), pi.dtype)
            np.put_along_axis(mask, order[open_, :size], 1, axis=1)
            start = pi[open_] * mask + 1e-6 * mask
            own, ll, log_n = fit((start / start.sum(1, keepdims=True)).astype(np.float32), 1 if size == 1 else STEPS)
            value = ll - PENALTY * (size - 1) * log_n
            better = value > best[open_]
            best[open_[better]], kept[open_[better]] = value[better], own[better]
            if not better.any():
                break
            on = better[inner]  # documents that go on
            like, n, inner = like[on], n[on], np.cumsum(better)[inner[on]] - 1
            at = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
            open_ = open_[better]
        chosen[seen], free[seen] = kept, pi
        return chosen, free


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        data, offsets = common.buffers(batch.column("text"))
        for a, b in common.slices(offsets, SLICE):
            at = offsets[a : b + 1]
            row, bucket, count = grams(data[at[0] : at[-1]], at - at[0])
            for lang in set(langs[a:b]):
                on = np.isin(row, [k for k in range(b - a) if langs[a + k] == lang])
                own = sums.setdefault(lang, np.zeros(1 << BITS))
                own += np.bincount(bucket[on], count[on], 1 << BITS)
    for lang, n in sums.items():
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(on), "bucket": pa.array(on.astype(np.int32)), "n": pa.array(n[on].astype(np.int64))})


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of all rows that aren't held out. What reaches the driver is bounded by the number of
    languages times 2 ** BITS. Without a labelled row the model has no language and predicts none."""
    rows = docs.where(~common.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    p = np.zeros((1 << BITS, len(names)))
    p[counts["bucket"].to_numpy(), counts["lang"].map({n: k for k, n in enumerate(names)}).to_numpy(dtype=int)] = counts["n"].to_numpy()
    if names:
        mean = (p.sum(1) + SMOOTH) / (p.sum() + SMOOTH * len(p))
        p = (p + SMOOTH * len(p) * 0.05 * mean[:, None]) / (p.sum(0) + SMOOTH * len(p) * 0.05)
    return Model(names, p.astype(np.float32))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.names, "und"], object)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            texts = batch.column("text")
            data, offsets = common.buffers(texts)
            for a, b in common.slices(offsets, SLICE):
                at = offsets[a : b + 1]
                part = data[at[0] : at[-1]]
                chosen, free = model.mixture(part, at - at[0])
                lang, score, shares = [], [], []
                ascii_letter = np.concatenate([[0], np.cumsum((FOLD[part] > 0) & (part < 0x80))])[at - at[0]]
                for k in range(b - a):
                    letters = ascii_letter[k + 1] > ascii_letter[k] or bool(LETTER.search(texts[a + k].as_py() or ""))
                    if not letters or not len(model.names):
                        lang.append("und")
                        score.append(0.0)
                        shares.append([])
                        continue
                    own = chosen[k] if chosen[k].any() else np.full(len(model.names), 1 / len(model.names))
                    top = int(own.argmax())
                    lang.append(names[top])
                    score.append(float(min(1.0, max(free[k][top], own[top] if not free[k].any() else 0.0))))
                    shares.append([{"lang": names[i], "share": float(own[i])} for i in np.flatnonzero(own > 0)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred (the largest share of the chosen set; of equal ones the first in code point order), score (the
    share of lang_pred among all languages), languages (the chosen set with shares) of each row of docs(doc_id, text, ...). A text that is null or has no letter is `und` with score 0 and no languages.
    Repeated rows each get a row; other columns are ignored; no rows give none."""
    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(model), schema)


def languages(docs: DataFrame) -> DataFrame:
    """identify(docs) with held_out, by a model learned from docs' own rows that aren't held out."""
    return identify(docs, fit(docs)).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "languages")
