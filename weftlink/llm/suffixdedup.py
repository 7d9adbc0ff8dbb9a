"""Repeated 50-byte strings across documents, by suffix arrays built with two-stage sorting.

Every LENGTH-byte window has an anchor: the least hash among its Q-byte grams. Equal windows have equal anchors, so they
meet wherever windows are dealt out by anchor. Consecutive windows of one anchor are a run. Three exchanges of packed
arrays, one row for each pair of a document group and an anchor bucket, settle everything:

1. anchors found in one document only go no further;
2. for the others each group sends its distinct runs, each once with the least document that has it. In a bucket, runs
   of an anchor with a single distinct run are settled by that least document: all windows of it are equal. Where an
   anchor has different runs (at the borders of matches) a suffix array over the distinct runs finds equal windows:
   suffixes smaller than their successors are sorted directly, the others are induced by scans of the first-byte
   buckets, and windows whose adjacent common prefix reaches LENGTH form one class with the least document of its runs.
   Hashes only bring runs together; they count as one run where their bytes are compared and equal;
3. each document removes the bytes under windows whose class has a smaller document.

Groups are dealt by a hash of doc_id and send a run once, however many copies they hold, so a hot passage costs one
entry for each group. An anchor with more than HOT documents (a passage's border, with a context of its own in each) is
dealt again by its single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

LENGTH, Q = 50, 16
#: Windows in a run at most; text bytes in a group; anchor buckets for each group; documents from which an anchor is
#: dealt by windows.
RUN, GROUP_BYTES, BUCKETS_EACH, HOT = 64, 8 << 20, 2, 20_000
SLICE = 1 << 18


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(raw)
    n = np.frombuffer(data, "<i8", 1 + len(kinds))
    at, out = 8 * len(n), []
    for k, size in zip(kinds, n[1:], strict=True):
        out.append(np.frombuffer(data, k, int(size) // np.dtype(k).itemsize, at))
        at += int(size)
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones and so on: bytes alike stand together."""
    return np.ascontiguousarray(x).view("u1").reshape(len(x), x.dtype.itemsize).T.ravel()


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def anchors(data: np.ndarray, length: int = LENGTH, q: int = Q) -> np.ndarray:
    """The least q-gram hash in the window at each position at which a whole window starts."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, span, p = data.astype(np.uint64) + np.uint64(1), 1, int(common._P)
    while span < q:  # q is a power of two
        h = h[: len(h) - span] + h[span:] * np.uint64(p)
        p, span = p * p % (1 << 64), span * 2
    h, span, wide = common.mix(h), 1, length - q + 1
    while span * 2 <= wide:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    rest = wide - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in data, number of windows, and anchor of each run of each row; a long row is cut at will."""
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in common.slices(offsets, SLICE):
        for lo in range(int(offsets[a]), int(offsets[b]), 16 * SLICE):
            hi = min(int(offsets[b]), lo + 16 * SLICE + length - 1)
            m = anchors(data[lo:hi], length)
            if not len(m):
                continue
            whole = np.ones(len(m), bool)
            for e in offsets[a + 1 : b]:  # windows that would cross rows
                whole[max(0, int(e) - lo - length + 1) : max(0, int(e) - lo)] = False
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (whole[1:] != whole[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(m)))
            at, n = at[whole[at]], n[whole[at]]
            parts = -(-n // RUN)
            if parts.max(initial=1) > 1:
                k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                at, n = np.repeat(at, parts) + k * RUN, np.minimum(np.repeat(n, parts) - k * RUN, RUN)
            found.append((at + lo, n, m[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaders(new: np.ndarray, order: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """new, which marks the first of each run of entries that hashes say are the same, in order; with those marked too
    whose bytes (size bytes of text from start on) aren't those of the marked one before them."""
    new = new.copy()
    while True:
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        rest = np.flatnonzero(~new)
        own, first = order[rest], lead[rest]
        wrong = size[own] != size[first]
        ends = np.cumsum(size[own])
        i = 0
        while i < len(rest):  # so many bytes at a time
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            n = np.minimum(size[own[i:j]], size[first[i:j]])
            differ = text[spread(start[own[i:j]], n)] != text[spread(start[first[i:j]], n)]
            wrong[i:j] |= np.logical_or.reduceat(differ, np.cumsum(n) - n)
            i = j
        if not wrong.any():
            return new
        new[rest[wrong]] = True


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Of size bytes, at most `most`, from each start on."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    inverse = pow(int(common._P), -1, 1 << 64)
    for lo in range(0, len(data), SLICE):
        a, b = np.searchsorted(start[order], [lo, lo + SLICE])
        if a < b:
            part = data[lo : lo + SLICE + most].astype(np.uint64) + np.uint64(1)
            pw, back = common.powers(len(part)), common.powers(len(part), np.uint64(inverse))
            pre = np.concatenate([[np.uint64(0)], np.cumsum(part * pw)])
            k = order[a:b]
            s = start[k] - lo
            out[k] = common.mix((pre[s + size[k]] - pre[s]) * back[s] + size[k].astype(np.uint64))
    return out


class Group:
    """The runs of a group of documents, and which of them leave the group."""

    def __init__(self, t: pa.Table, length: int):
        self.length = length
        self.ids = t.column("doc_id").to_numpy()
        self.data, self.offsets = common.buffers(t.column("text"))
        self.start, self.n, anchor = runs(self.data, self.offsets, length)
        self.key = common.mix(anchor) >> np.uint64(16)  # a least hash is small; mixed, keys are spread evenly
        self.doc = self.ids[np.searchsorted(self.offsets, self.start, "right") - 1] if len(self.start) else np.zeros(0, np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and in how many documents each is, counted up to HOT from runs."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return np.unique(key[new], return_counts=True)

    def entries(self, shared: np.ndarray, hot: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct runs of shared keys, by key and hash: key, hash, least doc, start, n; and entry, run and first window
        of each run that takes part. Runs of hot keys count as single windows, keyed by their own hash."""
        spot = np.searchsorted(known, self.key)
        on, heat = (shared[spot], hot[spot]) if len(known) else (np.zeros(0, bool), np.zeros(0, bool))
        cold = np.flatnonzero(on & ~heat)
        warm = np.flatnonzero(on & heat)
        n = self.n[warm]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        run = np.concatenate([cold, np.repeat(warm, n)])
        start = np.concatenate([self.start[cold], np.repeat(self.start[warm], n) + inner])
        size = np.concatenate([self.n[cold], np.ones(len(inner), np.int64)])
        digest = self._hash(start, size + self.length - 1)
        key = self.key[run]
        key[len(cold) :] = common.mix(digest[len(cold) :]) >> np.uint64(16)
        doc = self.doc[run]
        order = np.lexsort((doc, digest, key))
        key, digest, doc, start, size = key[order], digest[order], doc[order], start[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        new = leaders(new, np.arange(len(key)), self.data, start, size + self.length - 1)
        entry = np.cumsum(new) - 1
        return {"key": key[new], "hash": digest[new], "doc": doc[new], "start": start[new], "n": size[new], "of": entry, "at": start, "own": doc, "size": size}

    def _hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return hashes(self.data, start, size, self.length + RUN)


def _buckets(key: np.ndarray, count: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) over ascending 48-bit keys."""
    if not len(key):
        return
    b = ((key >> np.uint64(32)) * np.uint64(count) >> np.uint64(16)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for i, j in zip(at, [*at[1:], len(b)], strict=True):
        yield int(b[i]), int(i), int(j)


PACKED = "bucket int, g int, kind int, payload binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table({"bucket": pa.array(columns[0], pa.int32()), "g": pa.array(columns[1], pa.int32()), "kind": pa.array(columns[2], pa.int32()), "payload": pa.array(columns[3], pa.binary())})


def _send_keys(buckets: int, length: int):
    def run(key, t):
        known, docs = Group(t, length).keys()
        many = docs > 1
        return _table([(b, key[0].as_py(), 0, _pack(_planes(np.diff(known[i:j], prepend=known[i : i + 1])), known[i : i + 1], np.packbits(many[i:j]), docs[i:j][many[i:j]].astype("<i4"))) for b, i, j in _buckets(known, buckets)])

    return run


def _match_keys(hot: int):
    def run(key, t):
        groups, known, docs = t.column("g").to_pylist(), [], []
        for raw in t.column("payload").to_pylist():
            step, first, bits, counts = _unpack(raw, "u1", "<u8", "u1", "<i4")
            k = np.cumsum(_from_planes(step, "<u8"), dtype=np.uint64) + first[:1]
            n = np.ones(len(k), np.int64)
            n[np.unpackbits(bits, count=len(k)).astype(bool)] = counts
            known.append(k)
            docs.append(n)
        every, total = np.concatenate(known), np.concatenate(docs)
        order = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        sums = np.repeat(np.add.reduceat(total[order], at), np.diff(np.append(at, len(every))))
        found = np.empty(len(every), np.int64)
        found[order] = sums
        rows, a = [], 0
        for g, k in zip(groups, known, strict=True):
            n = found[a : a + len(k)]
            a += len(k)
            rows.append((key[0].as_py(), g, 1, _pack(np.packbits(n > 1), np.packbits(n > hot))))
        return _table(rows)

    return run


def _replies(group: Group, replies: pa.Table, buckets: int) -> dict[str, np.ndarray]:
    known, _ = group.keys()
    shared, hot = np.zeros(len(known), bool), np.zeros(len(known), bool)
    got = {b: raw for b, kind, raw in zip(*(replies.column(c).to_pylist() for c in ("rbucket", "rkind", "rpayload")), strict=True) if kind == 1}
    for b, i, j in _buckets(known, buckets):
        if b in got:
            x, y = _unpack(got[b], "u1", "u1")
            shared[i:j], hot[i:j] = np.unpackbits(x, count=j - i), np.unpackbits(y, count=j - i)
    return group.entries(shared, hot, known)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, in a row."""
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(start, size) + inner


def _offered(raw: bytes) -> tuple[np.ndarray, ...]:
    """key, doc, n and text of the runs that a group sent; their hashes are made anew from the text."""
    step, first, doc, n, text = _unpack(raw, "u1", "<u8", "u1", "u1", "u1")
    return np.cumsum(_from_planes(step, "<u8"), dtype=np.uint64) + first[:1], _from_planes(doc, "<i8"), n, text


def _send_runs(buckets: int, length: int):
    def run(key, left, right):
        if not left.num_rows:
            return _table([])
        group = Group(left, length)
        e = _replies(group, right, buckets)
        rows = []
        for b, i, j in _buckets(e["key"], buckets):
            text = group.data[spread(e["start"][i:j], e["n"][i:j] + length - 1)]
            rows.append((b, key[0].as_py(), 2, _pack(_planes(np.diff(e["key"][i:j], prepend=e["key"][i : i + 1])), e["key"][i : i + 1], _planes(e["doc"][i:j]), e["n"][i:j].astype("u1"), text)))
        return _table(rows)

    return run


def words8(chars: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number."""
    pad = np.concatenate([chars, np.zeros(64, np.uint8)])
    out = np.zeros(len(chars) + 56, np.uint64)
    for k in range(8):
        out |= pad[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sort_directly(at: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of their next `length` bytes at least: by eight bytes, then ties by the next eight."""
    order = np.argsort(w[at])
    at = at[order]
    value = w[at]
    new = np.ones(len(at), bool)
    new[1:] = value[1:] != value[:-1]
    for depth in range(8, length + 7, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        sub = np.flatnonzero(tied)
        if not len(sub):
            break
        group, value = np.cumsum(new)[sub], w[np.minimum(at[sub] + depth, len(w) - 1)]
        one = np.argsort(value)
        order = one[np.argsort(group[one], kind="stable")]
        at[sub] = at[sub][order]
        group, value = group[order], value[order]
        split = np.ones(len(sub), bool)
        split[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        new[sub] = split
    return at


def two_stage(chars: np.ndarray, first: np.ndarray, windows: np.ndarray, w: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The window positions of all strings in suffix order (by `length` bytes at least).

    chars: strings of bytes above 0, each ended by a 0; first: where each starts; windows: how many suffixes of each
    count. A suffix is small if it is smaller than its successor. Small ones, up to the first one behind the windows,
    are sorted directly. A scan of the first-byte buckets in order induces each large suffix from its successor: large
    suffixes stand before the small ones of their bucket, in the order in which their successors come up.
    """
    n = len(chars)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(chars[1:].astype(np.int16) - chars[:-1])
    step[chars == 0] = 1  # the end counts as small
    index = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(index[::-1])[::-1]] > 0
    index = np.where(small, np.arange(n), n)
    root = np.minimum.accumulate(index[::-1])[::-1][first + windows]
    used = np.zeros(n + 1, np.int8)
    used[first] = 1
    used[root + 1] -= 1
    used = np.cumsum(used[:n], dtype=np.int8).astype(bool)
    large = used & ~small
    direct = sort_directly(np.flatnonzero(used & small), w, length)
    heads = np.searchsorted(chars[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(from_: np.ndarray, c: int) -> np.ndarray:
        p = from_[from_ > 0] - 1
        p = p[large[p]]
        if not len(p):
            return p
        b = chars[p]
        order = np.argsort(b, kind="stable")
        b = b[order]
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        same = p[:0]
        for i, j in zip(at, [*at[1:], len(b)], strict=True):
            if b[i] == c:
                same = p[order[i:j]]
            else:
                waiting[b[i]].append(p[order[i:j]])
        return same

    out = []
    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(now):
            out.append(now)
            now = induce(now, c)
        own = direct[heads[c] : heads[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    order = np.concatenate(out) if out else direct
    string = np.searchsorted(first, order, "right") - 1
    return order[order - first[string] < windows[string]]


def prefixes(order: np.ndarray, w: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The common prefix, up to length, of each suffix with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, length, 8):
        x = w[order[live] + depth] ^ w[order[live - 1] + depth]
        same = x == 0
        stop = live[~same]
        x = x[~same]
        high = x >> np.uint64(32)
        bits = np.frexp(np.where(high > 0, high, x).astype(np.float64))[1] + np.where(high > 0, 32, 0)
        out[stop] = depth + (64 - bits) // 8
        live = live[same]
    out[live] = length
    return np.minimum(out, length)


def window_classes(text: np.ndarray, n: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each run (runs of n windows in a row in text), the least doc of the runs with an equal window."""
    size = n + length - 1
    first = np.cumsum(size + 1) - size - 1
    chars = np.zeros(int((size + 1).sum()), np.uint8)
    chars[spread(first, size)] = text + 1  # UTF-8 has no byte 255
    w = words8(chars)
    order = two_stage(chars, first, n, w, length)
    start = np.flatnonzero(prefixes(order, w, length) < length)
    string = np.searchsorted(first, order, "right") - 1
    least = np.repeat(np.minimum.reduceat(doc[string], start), np.diff(np.append(start, len(order))))
    out = np.empty(int(n.sum()), np.int64)
    out[(np.cumsum(n) - n)[string] + order - first[string]] = least
    return out


def _settle(length: int, most: int = 1 << 20):
    def run(key, t):
        groups, got = t.column("g").to_pylist(), [_offered(raw) for raw in t.column("payload").to_pylist()]
        k, d, n, text = (np.concatenate(x) for x in zip(*got, strict=True))
        n = n.astype(np.int64)
        at = np.cumsum(n + length - 1) - n - length + 1
        h = hashes(text, at, n + length - 1, length + RUN)
        order = np.lexsort((d, h, k))
        new = np.ones(len(k), bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
        new = leaders(new, order, text, at, n + length - 1)
        rep = order[new]  # the least document of each distinct run
        run_of = np.empty(len(k), np.int64)
        run_of[order] = np.cumsum(new) - 1
        _, back, count = np.unique(k[rep], return_inverse=True, return_counts=True)
        odd = count[back] > 1
        which = np.flatnonzero(odd)
        first = np.cumsum(np.where(odd, n[rep], 0)) - np.where(odd, n[rep], 0)
        values, ends = [], np.cumsum(n[rep][which] + length)
        i = 0
        while i < len(which):  # whole anchors at a time
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
            j = max(j, i + 1)
            while j < len(which) and back[which[j]] == back[which[j - 1]]:
                j += 1
            r = rep[which[i:j]]
            values.append(window_classes(text[spread(at[r], n[r] + length - 1)], n[r], d[r], length))
            i = j
        value = np.concatenate(values) if values else np.zeros(0, np.int64)
        rows, a = [], 0
        for g, x in zip(groups, got, strict=True):
            own = run_of[a : a + len(x[0])]
            a += len(x[0])
            o = odd[own]
            rows.append((key[0].as_py(), g, 3, _pack(np.packbits(o), _planes(d[rep[own[~o]]]), _planes(value[spread(first[own[o]], n[rep[own[o]]])]))))
        return _table(rows)

    return run


def _remove(buckets: int, length: int):
    def run(key, left, right):
        group = Group(left, length)
        covered = np.full(len(group.data) + 1, -length, np.int64 if len(group.data) >> 31 else np.int32)
        if len(group.start) and right.num_rows:
            e = _replies(group, right, buckets)
            got = {b: raw for b, kind, raw in zip(*(right.column(c).to_pylist() for c in ("rbucket", "rkind", "rpayload")), strict=True) if kind == 3}
            first = np.cumsum(e["n"]) - e["n"]
            least = np.full(int(e["n"].sum()), np.iinfo(np.int64).max)
            for b, i, j in _buckets(e["key"], buckets):
                bits, whole, single = _unpack(got[b], "u1", "u1", "u1")
                whole, single = _from_planes(whole, "<i8"), _from_planes(single, "<i8")
                odd = np.unpackbits(bits, count=j - i).astype(bool)
                at, n = first[i:j], e["n"][i:j]
                least[spread(at[~odd], n[~odd])] = np.repeat(whole, n[~odd])
                least[spread(at[odd], n[odd])] = single
            start = spread(e["at"], e["size"])
            gone = start[least[spread(first[e["of"]], e["size"])] < np.repeat(e["own"], e["size"])]
            covered[gone] = gone
        del group.start, group.n, group.key
        np.maximum.accumulate(covered, out=covered)
        off = covered[:-1] > np.arange(-length, len(group.data) - length, dtype=covered.dtype)
        off &= covered[:-1] >= 0
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for k, doc in enumerate(group.ids):
            a, b = int(group.offsets[k]), int(group.offsets[k + 1])
            mask, text = off[a:b], group.data[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            spans = edge.reshape(-1, 2)
            row = (int(doc), b - a, int(mask.sum()), len(spans), hashlib.sha256((text[~mask] if len(spans) else text).tobytes()).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in spans])
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.buffers(batch.column("text"))
        kept = [hashlib.sha256(data[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        zero = np.zeros(len(kept), np.int64)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(kept), pa.int64()), pa.array(np.diff(offsets)), pa.array(zero), pa.array(zero), pa.array(kept, pa.string()), pa.array([[]] * len(kept), kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    docs(doc_id, text, ...): texts are UTF-8 bytes, null ones empty. Returns doc_id, n_bytes, n_removed, n_spans, spans
    (maximal removed runs: start, end in bytes), kept_sha256 (of the remaining bytes in a row). Rows that repeat a
    doc_id don't count against each other; rows with a null doc_id lose nothing and take nothing from others. Other
    columns are ignored; an empty table gives an empty result. length must be at least 31.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    buckets = BUCKETS_EACH * groups
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    dealt = texts.where("doc_id is not null").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).repartition(groups, "g")
    back = lambda df: df.select(F.col("g").alias("rg"), F.col("bucket").alias("rbucket"), F.col("kind").alias("rkind"), F.col("payload").alias("rpayload")).repartition(groups, "rg")
    sent = dealt.groupBy("g").applyInArrow(_send_keys(buckets, length), PACKED)
    shared = common.Scratch(docs.sparkSession, "suffixes").keep(sent.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_match_keys(hot), PACKED), "shared")
    offered = dealt.groupBy("g").cogroup(back(shared).groupBy("rg")).applyInArrow(_send_runs(buckets, length), PACKED)
    settled = offered.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_settle(length), PACKED)
    out = dealt.groupBy("g").cogroup(back(shared.union(settled)).groupBy("rg")).applyInArrow(_remove(buckets, length), schema)
    return out.union(texts.where("doc_id is null").mapInArrow(_alone, schema))
