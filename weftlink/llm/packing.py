"""Order-preserving packing: cuts of the token stream by dynamic programming over document and sentence ends.

The documents of an input partition, in their order, are one stream of token ids. A sequence is a window of at most
`width` tokens; its cost is its padding (none at a power of two: half the width counts), the cost of its cut (none at a document's end, little
at a sentence's, more elsewhere) and a constant. best(j) = cut(j) + min over i of best(i) + padding(i, j), where the
minimum over the window runs on a monotone queue of best(i) + i, so that each candidate is handled once. The stream is
packed in stretches of some ten thousand windows, each starting where the one before it was cut, so memory is bounded
by a stretch and its longest document. No shuffle is needed, and a lost task gives the same sequences again.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1024
#: Costs in tokens of padding: a cut at a sentence's end, a cut elsewhere, a sequence.
SENTENCE, INSIDE, SEQUENCE = 4.0, 16.0, 16.0
#: Inside a longer sentence a cut may fall after each so many tokens.
STRIDE = 24
STRETCH = 1 << 18


class Ids:
    """Ids of texts under a byte-level BPE file.

    Where each merge of the file makes a later id than the one before it, ids are merge ranks; then the faster of the
    two libraries gives the same ids. Texts that hold a special token's string go to the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tokenizer, vocabulary = Tokenizer.from_file(path), model["vocab"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, k in vocabulary.items():
            self.ends[k] = token[-1] in ".!?" or token[-1] == "Ċ"  # Ċ stands for a line feed
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        self.fast = None
        byte = {c: bytes([b]) for b, c in _byte_letters().items()}
        own = {token: k for token, k in vocabulary.items() if token not in self.special}
        if made == sorted(set(made)) and set("".join(own)) <= set(byte):
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {b"".join(byte[c] for c in token): k for token, k in own.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.fast(text)).tobytes() if array("I").itemsize == 4 else np.array(self.fast(text), "<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_known: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _known:
        _known[path] = Ids(path)
    return _known[path]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall, ascending, with the cost of each; 0 and the stream's end are among them."""
    cost = np.full(len(ids) + 1, np.inf)
    at = np.append(np.flatnonzero(ends[ids]) + 1, len(ids))
    gaps = np.diff(np.insert(at, 0, 0))
    many = np.maximum(gaps - 1, 0) // stride
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
    cost[np.repeat(at - gaps, many) + inner * stride] = INSIDE
    cost[at[:-1]] = SENTENCE
    cost[doc_ends] = 0.0
    cost[0] = 0.0
    near = np.flatnonzero(np.isfinite(cost))
    return near, cost[near]


def cut(at: np.ndarray, cost: np.ndarray, width: int = WIDTH, final: bool = True) -> list[int]:
    """The cuts of the cheapest windows, from at[0]; all of the stream if final, else up to the best cut near its end."""
    pos, pen = at.tolist(), cost.tolist()
    n = len(pos)
    best, back = [0.0] * n, [0] * n
    place = {pos[0]: 0}
    queue: deque[tuple[float, int]] = deque([(float(pos[0]), 0)])
    half = width // 2
    for j in range(1, n):
        p = pos[j]
        low = p - width
        while pos[queue[0][1]] < low:
            queue.popleft()
        least, i = queue[0]
        value = least + width - p
        k = place.get(p - half)  # a power of two has no padding
        if k is not None and best[k] < value:
            value, i = best[k], k
        best[j] = value = value + pen[j] + SEQUENCE
        back[j] = i
        place[p] = j
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if not final:
        first = int(np.searchsorted(at, pos[-1] - width))
        j = min(range(max(first, 1), n), key=lambda k: best[k] - 0.02 * pos[k])
    out = []
    while j > 0:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Takes the documents of a stream in turn and gives rows of pieces."""

    def __init__(self, ids: Ids, width: int, base: int, with_ids: bool):
        self.ids, self.width, self.next, self.with_ids = ids, width, base, with_ids
        self.docs: list[tuple[int, bytes, int]] = []  # doc_id, ids, tokens that earlier stretches took
        self.held = 0

    def add(self, doc_id: int | None, text: str) -> None:
        raw = self.ids.of(text) + b"\0\0\0\0"
        self.docs.append((doc_id, raw, 0))
        self.held += len(raw) // 4

    def flush(self, final: bool) -> dict[str, list]:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(("ids",) if self.with_ids else ()))
        out: dict[str, list] = {n: [] for n in names}
        if not self.docs:
            return out
        left = [len(raw) // 4 - done for _, raw, done in self.docs]
        ends = np.cumsum(left)
        stream = np.frombuffer(b"".join(raw[4 * done :] for _, raw, done in self.docs), "<u4")
        cuts = cut(*candidates(stream, ends, self.ids.ends), self.width, final)
        k, begin, at = 0, 0, 0
        for end in cuts:
            offset = 0
            while begin < end:
                doc_id, raw, done = self.docs[k]
                stop = min(end, int(ends[k]))
                start = done + begin - at
                piece = raw[4 * start : 4 * (start + stop - begin)]
                row = (doc_id, start, stop - begin, zlib.crc32(piece), len(raw) // 4, self.next, offset)
                for name, v in zip(names, row, strict=False):
                    out[name].append(v)
                if self.with_ids:
                    out["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32))
                offset += stop - begin
                begin = stop
                if stop == ends[k]:
                    at, k = stop, k + 1
            self.next += 1
        self.docs = [(d, raw, done + (begin - at if j == 0 else 0)) for j, (d, raw, done) in enumerate(self.docs[k:])]
        self.held -= begin
        return out


def _pack(path: str, width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(ids_of(path), width, (context.partitionId() if context else 0) << 32, with_ids)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))] * with_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, text.as_py() or "")
                if packer.held >= STRETCH:
                    yield pa.RecordBatch.from_pydict(packer.flush(False), schema)
        yield pa.RecordBatch.from_pydict(packer.flush(True), schema)

    return run


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) as pieces of sequences of at most `width` token ids, in the order of docs' partitions.

    A document's ids are those of the tokenizer file (byte-level BPE) without special tokens, then id 0. One row for
    each piece: doc_id, start (its document's ids before it), length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id, offset (its place in the sequence, gapless from 0), and ids if with_ids. A null or empty
    text is one id; rows that repeat are packed as often as they come; a null doc_id stays null. Only the last sequence
    of a partition may be much shorter than the others. Other columns are ignored; an empty table gives no piece.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(tokenizer, width, with_ids), schema)
