"""Toxic spans by a two-label linear-chain conditional random field; marginals give document scores and offsets.

Only documents carry labels, so tokens are labelled from them: among words and beginnings of words that are far more
frequent in toxic documents, those are offending that explain toxic documents which no better one explains. The field is
fitted to windows round them, where tokens outside this lexicon share one feature. A run of such neutral
tokens multiplies the same 2 x 2 matrix, so the exact forward and backward messages need one step for each lexicon
token and one power of that matrix for each run, at any document length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import held_out

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled documents of each class that the field is fitted to: the first in the order of a hash of doc_id. They bound
#: what reaches the driver: features that three toxic ones hold at least, and those documents' places of them.
SAMPLE = 4000
WINDOW = 6


def lower(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] or c for c in text)


@dataclass
class Field:
    """index: the lexicon, words and word beginnings marked by *. Weights: emission for label 1 over label 0 (0: neutral), transitions, and the document scale."""

    index: dict[str, int]
    emit: np.ndarray
    trans: np.ndarray
    scale: float = 1.0
    shift: float = -3.0

    def step(self, word: int) -> np.ndarray:
        """The matrix of one token: from the label before to this label."""
        return np.exp(self.trans) * np.exp([0.0, self.emit[word]])

    def marginals(self, ids: list[int], at: list[int], n: int) -> np.ndarray:
        """Probability of label 1 at the lexicon tokens ids, at token positions at, of a document of n tokens."""
        quiet = self.step(0)

        def power(k: int) -> np.ndarray:
            m = np.linalg.matrix_power(quiet / quiet.max(), k) if k < 64 else self._limit(quiet, k)
            return m / m.max()

        gaps = [power(b - a - 1) for a, b in zip([-1, *at], [*at, n], strict=True)]
        forward, v = [], np.array([1.0, 0.0]) @ np.eye(2)
        for word, gap in zip(ids, gaps, strict=False):
            v = v @ gap @ self.step(word)
            v /= v.sum()
            forward.append(v)
        back = np.ones(2) @ gaps[-1].T if len(ids) else np.ones(2)
        out = np.zeros(len(ids))
        for k in range(len(ids) - 1, -1, -1):
            both = forward[k] * back
            out[k] = both[1] / both.sum()
            back = gaps[k] @ (self.step(ids[k]) @ back)
            back /= back.sum()
        return out

    @staticmethod
    def _limit(m: np.ndarray, k: int) -> np.ndarray:
        w, v = np.linalg.eig(m)
        w = w / np.abs(w).max()
        return np.maximum(np.real(v @ np.diag(w**k) @ np.linalg.inv(v)), 1e-300)

    def score(self, p: np.ndarray) -> float:
        """From the chance that some token is toxic, on the scale fitted to the labels."""
        some = 1 - np.prod(1 - np.clip(p, 0, 1 - 1e-9)) if len(p) else 0.0
        return float(1 / (1 + np.exp(-(self.scale * np.log((some + 1e-4) / (1 - some + 1e-4)) + self.shift))))


def fit_chain(x: np.ndarray, y: np.ndarray, mask: np.ndarray, words: int, steps: int = 150, l2: float = 0.05, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent of the conditional likelihood of labelled windows.

    x: word ids, y: labels, mask: which cells are tokens; windows are rows, padded on the right; times: how often each
    comes (once).
    """
    times = np.ones(len(x)) if times is None else times
    each = np.broadcast_to(times[:, None], x.shape)
    emit, trans = np.zeros(words), np.zeros((2, 2))
    emit[0] = -2.0
    n, length = x.shape
    memory = [np.zeros(words + 4), np.zeros(words + 4)]
    for t in range(1, steps + 1):
        e = np.stack([np.zeros_like(x, float), emit[x]], -1)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        start = trans[0]
        alpha[:, 0] = start + e[:, 0]
        for k in range(1, length):
            step = np.logaddexp(alpha[:, k - 1, :1] + trans[0], alpha[:, k - 1, 1:] + trans[1]) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
        for k in range(length - 2, -1, -1):
            nxt = e[:, k + 1] + beta[:, k + 1]
            step = np.logaddexp(nxt[:, None, 0] + trans[:, 0], nxt[:, None, 1] + trans[:, 1])
            beta[:, k] = np.where(mask[:, k + 1, None], step, beta[:, k + 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        p = np.exp(alpha + beta - z)
        g_emit = np.bincount(x[mask], (each * (y - p[..., 1]))[mask], words) - l2 * emit
        g_trans = -l2 * trans
        g_trans[0] += [(times * ((1 - y[:, 0]) - p[:, 0, 0])).sum(), (times * (y[:, 0] - p[:, 0, 1])).sum()]
        for k in range(1, length):
            on = mask[:, k]
            pair = np.exp(alpha[on, k - 1, :, None] + trans + (e + beta)[on, k, None, :] - z[on])
            for a in (0, 1):
                for b in (0, 1):
                    g_trans[a, b] += (times[on] * (((y[on, k - 1] == a) & (y[on, k] == b)) - pair[:, a, b])).sum()
        g = np.concatenate([g_emit, g_trans.ravel()]) / times.sum()
        memory[0] = 0.9 * memory[0] + 0.1 * g
        memory[1] = 0.99 * memory[1] + 0.01 * g * g
        move = 0.2 * (memory[0] / (1 - 0.9**t)) / (np.sqrt(memory[1] / (1 - 0.99**t)) + 1e-8)
        emit, trans = emit + move[:words], trans + move[words:].reshape(2, 2)
    return emit, trans


#: Characters of the word beginnings that count as features beside whole words.
STEMS = (6, 5, 4, 3)


def keys(word: str) -> list[str]:
    """The features of a token: the word, and its beginnings with a mark, longest first."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in {k for t in set(TOKEN.findall(lower(text or ""))) for k in keys(t)}:
                seen[w][toxic] += 1
    yield pa.RecordBatch.from_pydict({"word": list(seen), "clean": pa.array([v[0] for v in seen.values()], pa.int64()), "toxic": pa.array([v[1] for v in seen.values()], pa.int64())})


def _occurrences(index: dict[str, int]):
    """For each text its tokens that have a feature in index: feature and place, a row for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, n = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = TOKEN.findall(lower(text or ""))
                where = [(index[w], k) for k, t in enumerate(tokens) for w in keys(t) if w in index]
                ids.append([i for i, _ in where])
                at.append([k for _, k in where])
                n.append(len(tokens))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "ids": pa.array(ids, pa.list_(pa.int32())), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.int32())})

    return run


def explain(rows: list, names: int, odds: np.ndarray) -> set[int]:
    """Greedily, the features that explain toxic documents: at each step the one with the most documents still
    unexplained, weighted by its log odds, while it explains at least three of them and one in four hundred. Then those
    that stand beside a chosen one, nearly as often and as exclusively."""
    docs = [np.unique(r["ids"]).astype(np.int64) for r in rows if r["toxic"]]
    doc, key = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([*docs, np.zeros(0, np.int64)])
    open_, chosen = np.ones(len(docs), bool), []
    while True:
        on = open_[doc]
        gain = np.bincount(key[on], minlength=names) * np.maximum(odds, 0)
        best = int(gain.argmax())
        got = doc[on & (key == best)]
        if len(got) < max(3, len(docs) / 400):
            break
        chosen.append(best)
        open_[got] = False
    count = np.bincount(key, minlength=names)
    beside = np.zeros(names)
    for c in chosen:
        with_c = np.zeros(len(docs), bool)
        with_c[doc[key == c]] = True
        beside = np.maximum(beside, np.where(np.bincount(key[with_c[doc]], minlength=names) > 0, count / max(1, count[c]), 0))
    least = min((odds[c] for c in chosen), default=np.inf)
    return set(chosen) | set(np.flatnonzero((beside >= 0.4) & (odds >= max(least, 3.0)) & (count >= 3)).tolist())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field fitted to labelled documents whose id isn't held out. Rows without a label or a text teach nothing;
    without a toxic or a clean one the field finds nothing toxic."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    picked = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    counts = texts.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = texts.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in total}
    if not n.get(0) or not n.get(1):
        return Field({}, np.array([-5.0]), np.zeros((2, 2)))
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(n[1] + 0.5) - F.col("toxic"))) - F.log((F.col("clean") + 0.5) / (F.lit(n[0] + 0.5) - F.col("clean")))
    top = counts.where("toxic >= 3").withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), F.desc(F.length("word")), "word").collect()
    tried = {r["word"]: k for k, r in enumerate(top, 1)}
    strength = np.array([0.0] + [r["odds"] for r in top])
    rows = texts.mapInArrow(_occurrences(tried), "toxic int, ids array<int>, at array<int>, n int").collect()
    offending = explain(rows, len(tried) + 1, strength)
    final = {k: i for i, k in enumerate(sorted(offending), 1)}
    index = {w: final[k] for w, k in tried.items() if k in final}
    windows: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()  # the same windows count together
    lengths = {k: len(w) + (not w.endswith("*")) for w, k in tried.items()}
    compact = []
    for r in rows:
        word: dict[int, int] = {}
        for k, i in zip(r["at"], r["ids"], strict=True):  # of a token's features the longest that offends
            if i in final and (k not in word or lengths[i] > lengths[word[k]]):
                word[k] = i
        word = {k: final[i] for k, i in word.items()}
        compact.append((sorted(word), [word[k] for k in sorted(word)], r["n"]))
        for k in sorted(word) or [r["n"] // 2]:
            ids = tuple(word.get(i, 0) for i in range(max(0, k - WINDOW), min(r["n"], k + WINDOW + 1)))
            if ids:
                windows[ids, tuple(int(bool(r["toxic"]) and i > 0) for i in ids)] += 1
    width = 2 * WINDOW + 1
    seen = sorted(windows)
    if not seen:
        return Field({}, np.array([-5.0]), np.zeros((2, 2)))
    mask = np.array([[k < len(ids) for k in range(width)] for ids, _ in seen])
    pad = lambda side: np.array([w[side] + (0,) * (width - len(w[side])) for w in seen])
    field = Field(index, *fit_chain(pad(0), pad(1), mask, len(index) + 1, times=np.array([windows[w] for w in seen], float)))
    some = np.array([1 - np.prod(1 - np.clip(field.marginals(ids, at, n), 0, 1 - 1e-9)) if ids else 0.0 for at, ids, n in compact])
    z, t = np.log((some + 1e-4) / (1 - some + 1e-4)), np.array([float(r["toxic"]) for r in rows])
    weight = np.where(t == 1, 1.0, n[1] / n[0] if n[1] > n[0] else 1.0)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit, lightly held to a = 1
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((t - p) * weight * z).sum() - 0.1 * (a - 1), ((t - p) * weight).sum() - 0.1 * b])
        v = p * (1 - p) * weight
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    field.scale, field.shift = float(a), float(b)
    return field


def _tag(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {w[:3] for w in field.index}
        whole = {w for w in field.index if len(w) < 3}

        def feature(token: str) -> int:
            return next((field.index[k] for k in keys(token) if k in field.index), 0)

        empty = field.score(np.zeros(0))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                low = lower(text or "")
                tokens = TOKEN.findall(low)
                likely = {t for t in tokens if t[:3] in heads}
                if not any(map(feature, likely)) and whole.isdisjoint(tokens):
                    scores.append(empty)
                    spans.append([])
                    continue
                where = [(k, m) for k, m in enumerate(TOKEN.finditer(low)) if feature(m[0])]
                at = [k for k, _ in where]
                p = field.marginals([feature(m[0]) for _, m in where], at, len(tokens))
                found: list[dict] = []
                for (k, m), v in zip(where, p, strict=True):
                    if v >= 0.5:
                        if found and found[-1]["k"] == k - 1:
                            found[-1] |= {"k": k, "end": m.end(), "probability": max(v, found[-1]["probability"])}
                        else:
                            found.append({"k": k, "start": m.start(), "end": m.end(), "probability": float(v)})
                scores.append(field.score(p))
                spans.append([{n: f[n] for n in ("start", "end", "probability")} for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return run


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score in 0 to 1, spans (array of start, end in code points, probability) for docs(doc_id, text, ...).

    A null or empty text, and any without a lexicon word, has no span and the score of an empty one. Repeated rows each
    get a row; other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tag(field), "doc_id long, score double, spans array<struct<start:long,end:long,probability:double>>")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and spans of every document, by a field fitted to labels."""
    tagged = tag(docs, fit(docs, labels))
    return tagged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def _keep(field: Field):
    tagger = _tag(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            seen = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])
            scores = next(tagger(iter([seen]))).column("score").to_numpy()
            yield batch.filter(pa.array(scores < 0.5))

    return run


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the field fitted to labels doesn't call toxic, with all their columns."""
    return docs.mapInArrow(_keep(fit(docs, labels)), docs.schema)
