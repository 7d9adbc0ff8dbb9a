"""Media columns as progressive JPEG, encoded and decoded in numpy.

Scans of spectral selection and successive approximation accumulate into coefficient arrays; the inverse transform,
chroma upsampling and colour conversion give full-resolution RGB tensors. Entropy-coded segments (between restart
markers) are lanes: each step decodes one symbol in every lane of all images of a batch with the same scans.

A text is stored as coefficients, the unit of the format: byte b becomes coefficient b - 128 with a quantiser of 1, in
zigzag order, block by block, 4:2:0 units of six blocks. What the file holds is read back bit by bit.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm import common

UNIT, PAD = 576, 255
SLICE = 1 << 18
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: (component numbers, first and last coefficient, high and low bit): the scans that the encoder writes.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]
SAMPLING = ((2, 2), (1, 1), (1, 1))
BITS = np.array([k.bit_length() for k in range(4096)])


def canonical(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) from a table as a DHT segment holds it."""
    code, at, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


# The encoder's tables, by a rule: four bits for what text needs, ten for everything else.
DC_SYMBOLS = bytes(range(12))
_SHORT = [0x00, 0xF0, *range(1, 11)]
AC_SYMBOLS = bytes([*_SHORT, *(r << 4 | s for r in range(1, 16) for s in range(1, 11))])
DC_COUNTS = [0, 0, 0, 12] + [0] * 12
AC_COUNTS = [0, 0, 0, len(_SHORT), 0, 0, 0, 0, 0, len(AC_SYMBOLS) - len(_SHORT)] + [0] * 6


def _arrays(table: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in table.items():
        code[s], length[s] = c, n
    return code, length


DC_CODE, DC_LEN = _arrays(canonical(DC_COUNTS, DC_SYMBOLS))
AC_CODE, AC_LEN = _arrays(canonical(AC_COUNTS, AC_SYMBOLS))


def _segments(value: np.ndarray, bits: np.ndarray, block: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of `bits` bits, ordered by block, as byte-aligned segments: the bytes and each block's length in bytes."""
    per = np.bincount(block, bits, count).astype(np.int64)
    size = (per + 7) // 8
    begin = np.cumsum(size) - size
    before = np.cumsum(bits) - bits
    lead = np.zeros(count + 1, np.int64)
    lead[1:] = np.cumsum(per)
    pos = before - lead[block] + 8 * begin[block]
    pad = 8 * size - per  # ones up to the byte's end
    pos = np.concatenate([pos, 8 * begin + per])
    value = np.concatenate([value, (1 << pad) - 1])
    bits = np.concatenate([bits, pad])
    wide = value.astype(np.uint64) << (64 - (pos & 31) - bits).astype(np.uint64) if len(pos) else np.zeros(0, np.uint64)
    wide[bits == 0] = 0
    word, total = pos >> 5, int(size.sum())
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), total // 4 + 3)
    words[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), total // 4 + 3)[:-1]
    return words.astype(np.uint32).astype(">u4").view(np.uint8)[:total], size


def _marked(data: np.ndarray, size: np.ndarray, turn: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments with stuffed zeros and, but for an image's last one, restart markers; and the new sizes."""
    full = data == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    end = np.cumsum(size)
    grown = size + stuffed[end] - stuffed[end - size] + 2 * ~last
    place = np.arange(len(data)) + stuffed[:-1] + 2 * np.repeat(np.cumsum(~last) - ~last, size)
    out = np.zeros(int(grown.sum()), np.uint8)
    out[place] = data
    mark = np.cumsum(grown)[~last] - 2
    out[mark] = 255
    out[mark + 1] = 0xD0 + (turn[~last] & 7)
    return out, grown


def _dc_items(v: np.ndarray, low: int, refine: bool) -> tuple[np.ndarray, ...]:
    """v: DC values of the blocks of each unit. The prediction starts again with each unit and component."""
    n, k = v.shape
    v = v >> low
    if refine:
        return (v & 1).ravel(), np.ones(n * k, np.int64), np.repeat(np.arange(n), k)
    diff = v.copy()
    diff[:, 1:4] -= v[:, 0:3]
    s = BITS[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
    return (DC_CODE[s] << s | extra).ravel(), (DC_LEN[s] + s).ravel(), np.repeat(np.arange(n), k)


def _ac_items(v: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
    """First pass over a band: zero runs with the value that ends them."""
    n, width = v.shape
    a = np.abs(v) >> low
    row, k = np.nonzero(a)
    a = a[row, k]
    prev = np.empty_like(k)
    prev[:1], prev[1:] = -1, np.where(row[1:] == row[:-1], k[:-1], -1)
    run = k - prev - 1
    if len(run):
        run[0] = k[0]
    s = BITS[a]
    extra = np.where(v[row, k] < 0, (1 << s) - 1 - a, a)
    symbol = (run & 15) << 4 | s
    value, bits = AC_CODE[symbol] << s | extra, AC_LEN[symbol] + s
    last = np.full(n, -1)
    last[row] = k  # the last assignment of a row stands
    eob = last < width - 1
    many = 1 + (run >> 4)
    shift = np.cumsum(eob) - eob
    place = np.cumsum(many) - 1 + shift[row]
    total = int(many.sum() + eob.sum())
    out_v, out_b, out_r = np.full(total, AC_CODE[0xF0]), np.full(total, AC_LEN[0xF0]), np.zeros(total, np.int64)
    out_v[place], out_b[place] = value, bits
    upto = np.cumsum(np.bincount(row, many, n).astype(np.int64) + eob)
    out_v[upto[eob] - 1], out_b[upto[eob] - 1] = AC_CODE[0], AC_LEN[0]
    out_r[:] = np.repeat(np.arange(n), np.diff(np.concatenate([[0], upto])))
    return out_v, out_b, out_r


def _refine_items(v: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
    """A later pass over a band: values that become nonzero, and a correction bit for each that already is."""
    n, width = v.shape
    a = np.abs(v) >> low
    plain = (a > 1).all(axis=1)  # only corrections: an end of block, then a bit for each value
    rows = np.flatnonzero(plain)
    bit = (a[rows] & 1).astype(np.int64)
    step = 21
    parts = [(bit[:, i : i + step] @ (1 << np.arange(min(step, width - i))[::-1]), min(step, width - i)) for i in range(0, width, step)]
    value = np.stack([np.full(len(rows), AC_CODE[0]), *[p for p, _ in parts]], 1).ravel()
    bits = np.tile([int(AC_LEN[0]), *[w for _, w in parts]], len(rows))
    block = np.repeat(rows, 1 + len(parts))
    key = block * (4 * 64 * 64) + np.tile(np.arange(1 + len(parts)), len(rows))
    rest = np.flatnonzero(~plain)
    if len(rest):
        x, w = a[rest], v[rest]
        at = np.broadcast_to(np.arange(width), x.shape)
        fresh, zero, old = x == 1, x == 0, x > 1
        zeros = np.cumsum(zero, axis=1)
        base = np.maximum.accumulate(np.where(fresh, zeros, 0), axis=1)  # zeros up to the last fresh value
        before = np.concatenate([np.zeros((len(rest), 1), np.int64), base[:, :-1]], axis=1)
        run = zeros - before
        final = np.where(fresh, at, -1).max(axis=1)
        skip = zero & (run % 16 == 0) & (at < final[:, None])
        event = fresh | skip
        end = np.where(event, at, -1).max(axis=1)
        nxt = np.minimum.accumulate(np.where(event, at, width)[:, ::-1], axis=1)[:, ::-1]
        rank = lambda r, e: (rest[r] * 64 + e) * 256
        r, k = np.nonzero(fresh)
        symbol = (run[r, k] % 16) << 4 | 1
        got = [(AC_CODE[symbol] << 1 | (w[r, k] > 0), AC_LEN[symbol] + 1, rest[r], rank(r, k))]
        r, k = np.nonzero(skip)
        got.append((np.full(len(r), AC_CODE[0xF0]), np.full(len(r), AC_LEN[0xF0]), rest[r], rank(r, k)))
        r = np.flatnonzero(end < width - 1)
        got.append((np.full(len(r), AC_CODE[0]), np.full(len(r), AC_LEN[0]), rest[r], rank(r, np.full(len(r), width))))
        r, k = np.nonzero(old)
        got.append((x[r, k].astype(np.int64) & 1, np.ones(len(r), np.int64), rest[r], rank(r, nxt[r, k]) + 64 + k))
        value, bits, block, key = (np.concatenate([p, *q]) for p, q in zip((value, bits, block, key * 1), zip(*got, strict=True), strict=True))
        order = np.argsort(key, kind="stable")
        value, bits, block = value[order], bits[order], block[order]
    return value, bits, block


@lru_cache(maxsize=512)
def _raster(w: int, h: int) -> np.ndarray:
    """For each luma block in raster order: unit * 4 + block in the unit."""
    y, x = np.divmod(np.arange(4 * w * h), 2 * w)
    return (y // 2 * w + x // 2) * 4 + y % 2 * 2 + x % 2


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + DC_SYMBOLS + b"\x10" + bytes(AC_COUNTS) + AC_SYMBOLS) + _segment(0xDD, b"\x00\x01")


def encode(units: np.ndarray, shapes: list[tuple[int, int]], notes: list[bytes]) -> list[bytes]:
    """Images of units (blocks of 6 x 64 coefficients in zigzag order, one image after another) as progressive JPEG with
    restarts after each unit; shapes: (width, height) in units; notes: a comment for each."""
    count = np.array([w * h for w, h in shapes])
    first = np.cumsum(count) - count
    luma = np.concatenate([_raster(w, h) + 4 * f for (w, h), f in zip(shapes, first, strict=True)])
    planes = (units[:, :4].reshape(-1, 64)[luma], units[:, 4], units[:, 5])
    streams = []
    for parts, lo, hi, high, low in SCRIPT:
        if lo == 0:
            per, items = count, _dc_items(units[:, :, 0].astype(np.int64), low, high > 0)
        else:
            per, band = count * (4 if parts == (0,) else 1), planes[parts[0]][:, lo : hi + 1]
            items = _refine_items(band, low) if high else _ac_items(band, low)
        total = int(per.sum())
        turn = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
        data, size = _segments(*items, total)
        data, size = _marked(data, size, turn, turn == np.repeat(per, per) - 1)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per)])]
        head = _segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, 0)), lo, hi, high << 4 | low]))
        streams.append((head, data.tobytes(), ends.tolist()))
    out = []
    for k, (w, h) in enumerate(shapes):
        frame = _segment(0xC2, bytes([8]) + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, *(x for c, (a, b) in enumerate(SAMPLING, 1) for x in (c, a << 4 | b, 0))]))
        body = b"".join(x for head, data, ends in streams for x in (head, data[ends[k] : ends[k + 1]]))
        out.append(b"\xff\xd8" + _segment(0xFE, notes[k]) + _TABLES + frame + body + b"\xff\xd9")
    return out


@dataclass
class Image:
    """What the headers of a file say. scans: (header, restart interval, tables, places of the segments)."""

    width: int = 0
    height: int = 0
    parts: tuple = ()
    quant: dict = field(default_factory=dict)
    note: bytes = b""
    scans: list = field(default_factory=list)
    wide: int = 0
    high: int = 0


def parse(raw: bytes) -> Image:
    """The headers of a progressive JPEG, and where the entropy-coded segments lie."""
    data = np.frombuffer(raw, np.uint8)
    full = np.flatnonzero(data[:-1] == 255)
    code = data[full + 1]
    marks = full[(code != 0) & (code != 255)]
    kinds = data[marks + 1]
    restart = (kinds >= 0xD0) & (kinds <= 0xD7)
    stops, resets = marks[~restart].tolist(), marks[restart]
    out, tables, interval, at = Image(), {}, 0, 2
    while True:
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if kind == 0xD9:
            return out
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            out.note = body
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 65 + 64 * wide
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xC2:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.parts = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3))
            a, b = max(p[1] for p in out.parts), max(p[2] for p in out.parts)
            out.wide, out.high = -(-out.width // (8 * a)), -(-out.height // (8 * b))
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("only progressive Huffman-coded images are read")
        elif kind == 0xDA:
            end = stops[bisect_left(stops, at)]
            i, j = np.searchsorted(resets, (at, end))
            begin = np.empty(j - i + 1, np.int64)
            begin[0], begin[1:] = at, resets[i:j] + 2
            out.scans.append((body, interval, tuple(sorted(tables.items())), begin))
            at = end


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol << 5 | length of the code that they start with."""
    out = np.zeros(1 << 16, np.int64)
    for s, (code, length) in canonical(list(table[:16]), table[16:]).items():
        out[code << 16 - length : code + 1 << 16 - length] = s << 5 | length
    return out


class Lanes:
    """Bit positions in many segments at once."""

    def __init__(self, w: np.ndarray, begin: np.ndarray):
        self.w, self.p = w, begin * 8

    def ahead(self, lane) -> np.ndarray:
        p = self.p[lane]
        return self.w[p >> 3] << (p & 7).astype(np.uint64)


def words8(data: np.ndarray) -> np.ndarray:
    pad = np.concatenate([data, np.full(16, 255, np.uint8)])
    out = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):
        out |= pad[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _extend(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << s) >> 1, bits - (1 << s) + 1, bits)


def _take(w: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (0 to 16) behind the first `skip` of the bits ahead."""
    return ((w << skip.astype(np.uint64)) >> np.uint64(47) >> (17 - n).astype(np.uint64)).astype(np.int64)


def _first(lanes: Lanes, blocks: np.ndarray, count: np.ndarray, coef: np.ndarray, table: np.ndarray, lo: int, hi: int, low: int) -> None:
    skip = np.zeros(len(count), np.int64)
    for j in range(blocks.shape[1]):
        lane = np.flatnonzero((count > j) & (skip == 0))
        skip[(count > j) & (skip > 0)] -= 1
        k, block, p = np.full(len(lane), lo), blocks[lane, j], lanes.p[lane]
        while len(lane):
            w = lanes.w[p >> 3] << (p & 7).astype(np.uint64)
            e = table[(w >> np.uint64(48)).astype(np.int64)]
            n, s, r = e & 31, e >> 5 & 15, e >> 9
            end = (s == 0) & (r < 15)
            k += np.where(end, 0, r)
            value = _extend(_take(w, n, s), s)
            if end.any():
                on = s > 0
                coef[block[on], k[on]] = value[on] << low
                run = lane[end]
                skip[run] = (1 << r[end]) - 1 + _take(w[end], n[end], r[end])
                p += n + np.where(end, r, s)
                k += 1
                lanes.p[run] = p[end]
                go = ~end
            else:
                coef[block, k] = value << low  # a run of sixteen zeros writes a zero
                p += n + s
                k += 1
                go = k <= hi
            go &= k <= hi
            if not go.all():
                lanes.p[lane[~go]] = p[~go]
                lane, k, block, p = lane[go], k[go], block[go], p[go]


def _later(lanes: Lanes, blocks: np.ndarray, count: np.ndarray, coef: np.ndarray, table: np.ndarray, lo: int, hi: int, low: int) -> None:
    skip = np.zeros(len(count), np.int64)
    for j in range(blocks.shape[1]):
        lane = np.flatnonzero(count > j)
        block = blocks[lane, j]
        over = skip[lane] > 0
        skip[lane[over]] -= 1
        run, fresh = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        need = ~over
        p, one = lanes.p[lane], 1 << low
        now = coef[block, lo : hi + 1].astype(np.int64)
        for k in range(hi - lo + 1):
            ask = np.flatnonzero(need)
            if len(ask):
                w = lanes.w[p[ask] >> 3] << (p[ask] & 7).astype(np.uint64)
                e = table[(w >> np.uint64(48)).astype(np.int64)]
                n, s, r = e & 31, e >> 5 & 15, e >> 9
                end = (s == 0) & (r < 15)
                sign = _take(w, n, np.ones_like(n))
                fresh[ask] = np.where(s > 0, np.where(sign > 0, one, -one), 0)
                run[ask] = np.where(end, 0, r)
                tail = np.where(end, r, (s > 0).astype(np.int64))
                skip[lane[ask[end]]] = (1 << r[end]) - 1 + _take(w[end], n[end], r[end])
                over[ask[end]] = True
                p[ask] += n + tail
                need[ask] = False
            c = now[:, k]
            old = c != 0
            bit = (lanes.w[p >> 3] >> (63 - (p & 7)).astype(np.uint64)).astype(np.int64) & 1
            step = bit & old
            if step.any():
                c += step * np.sign(c) * one
            p += old
            idle = ~old & ~over
            if idle.any():
                stop = idle & (run == 0)
                c[stop] = fresh[stop]
                need |= stop
                run[idle & ~stop] -= 1
        coef[block, lo : hi + 1] = now
        lanes.p[lane] = p


def coefficients(files: list[bytes], images: list[Image]) -> list[list[np.ndarray]]:
    """For each file and component its blocks (raster order, whole units) of coefficients in zigzag order. All files
    must have the same components, scans and tables."""
    raw = np.frombuffer(b"".join(files), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 255)
    moved = np.concatenate([[0], np.cumsum(keep)])
    w = words8(raw[keep])
    parts = images[0].parts
    grids = [[(im.wide * p[1], im.high * p[2]) for im in images] for p in parts]
    sizes = [np.array([a * b for a, b in g]) for g in grids]
    starts = [np.cumsum(s) - s for s in sizes]
    coef = [np.zeros((int(s.sum()), 64), np.int32) for s in sizes]
    number = {p[0]: k for k, p in enumerate(parts)}
    for s, (head, interval, tables, _) in enumerate(images[0].scans):
        used = [(number[head[1 + 2 * k]], head[2 + 2 * k]) for k in range(head[0])]
        lo, hi, high, low = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
        tables = dict(tables)
        begin = moved[np.concatenate([im.scans[s][3] + b for im, b in zip(images, base.tolist(), strict=False)])]
        which = tuple(c for c, _ in used)
        lists = [_order(im.width, im.height, im.wide, im.high, parts, which) for im in images]
        units = np.array([len(x) for x, _ in lists])
        column = lists[0][1]
        shift = np.stack([starts[c] for c in column], 1)
        every = np.concatenate([x for x, _ in lists]) + np.repeat(shift, units, axis=0)
        step = interval or max(int(units.max(initial=0)), 1)
        lanes_of = -(-units // step)
        count = np.full(int(lanes_of.sum()), step)
        final = np.cumsum(lanes_of)[units > 0] - 1
        count[final] = (units - (lanes_of - 1) * step)[units > 0]
        first = np.cumsum(count) - count
        pick = np.minimum(first[:, None] + np.arange(int(count.max(initial=0))), max(len(every) - 1, 0))
        lanes = Lanes(w, begin[: len(count)])
        if lo == 0:
            _dc(lanes, every, pick, count, column, coef, [_lookup(tables[t >> 4]) for c, t in used] if not high else [], used, high, low)
        else:
            c, t = used[0]
            (_later if high else _first)(lanes, every[:, 0][pick], count, coef[c], _lookup(tables[16 | t & 15]), lo, hi, low)
    return [[coef[c][starts[c][k] : starts[c][k] + sizes[c][k]] for c in range(len(parts))] for k in range(len(files))]


@lru_cache(maxsize=512)
def _order(width: int, height: int, wide: int, high: int, parts: tuple, used: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """Units of a scan: for each the block numbers that it codes, and the component of each column."""
    if len(used) == 1:
        p = parts[used[0]]
        a, b = max(q[1] for q in parts), max(q[2] for q in parts)
        w, h = -(-width * p[1] // (8 * a)), -(-height * p[2] // (8 * b))
        return (np.arange(h)[:, None] * (wide * p[1]) + np.arange(w)).reshape(-1, 1), list(used)
    columns, which = [], []
    y, x = np.divmod(np.arange(wide * high), wide)
    for c in used:
        _, h, v, _ = parts[c]
        for dy in range(v):
            for dx in range(h):
                columns.append((y * v + dy) * (wide * h) + x * h + dx)
                which.append(c)
    return np.stack(columns, 1), which


def _dc(lanes: Lanes, every: np.ndarray, pick: np.ndarray, count: np.ndarray, which: list[int], coef: list, tables: list, used: list, high: int, low: int) -> None:
    table = {c: t for (c, _), t in zip(used, tables, strict=False)}
    last = {c: np.zeros(len(count), np.int64) for c, _ in used}
    for j in range(pick.shape[1]):
        lane = np.flatnonzero(count > j)
        unit = pick[lane, j]
        for k, c in enumerate(which):
            w, block = lanes.ahead(lane), every[unit, k]
            if high:
                coef[c][block, 0] |= ((w >> np.uint64(63)).astype(np.int32)) << low
                lanes.p[lane] += 1
            else:
                e = table[c][(w >> np.uint64(48)).astype(np.int64)]
                n, s = e & 31, e >> 5
                last[c][lane] += _extend(_take(w, n, s), s)
                coef[c][block, 0] = last[c][lane] << low
                lanes.p[lane] += n + s


def _basis() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: samples; whole numbers, so that sums are exact in any order."""
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)  # sample by frequency
    both = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.round(both[ZIGZAG] * 8192)


BASIS = _basis()


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples of blocks, 0 to 255."""
    flat = (coef * quant).astype(np.float64) @ BASIS
    flat *= 1 / 8192
    flat += 128.5
    return np.clip(flat, 0, 255.5, out=flat).astype(np.int32).reshape(-1, 8, 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)], -1)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def tensor(im: Image, coef: list[np.ndarray]) -> np.ndarray:
    """height x width x 3, chroma repeated up to full resolution; a grey image has three equal channels."""
    a, b = max(p[1] for p in im.parts), max(p[2] for p in im.parts)
    planes = []
    for (_, h, v, q), x in zip(im.parts, coef, strict=True):
        s = samples(x, im.quant[q]).reshape(im.high * v, im.wide * h, 8, 8).transpose(0, 2, 1, 3).reshape(im.high * v * 8, im.wide * h * 8)
        planes.append(s.repeat(b // v, axis=0).repeat(a // h, axis=1)[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    return to_rgb(*planes)


def decode(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Headers and coefficients of progressive files; those with the same components, scans and tables go together."""
    images = [parse(f) for f in files]
    alike = defaultdict(list)
    for k, im in enumerate(images):
        alike[im.parts, tuple(s[:3] for s in im.scans)].append(k)
    out: list = [None] * len(files)
    for members in alike.values():
        for k, c in zip(members, coefficients([files[k] for k in members], [images[k] for k in members]), strict=True):
            out[k] = (images[k], c)
    return out


def store_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Texts of a slice as files: bytes, then PAD up to a positive multiple of UNIT, as coefficients."""
    size = np.diff(offsets)
    padded = UNIT * np.maximum(1, -(-size // UNIT))
    shapes = []
    for p in padded.tolist():
        n = -(-p // 384)
        w = isqrt(n - 1) + 1
        shapes.append((w, -(-n // w)))
    count = np.array([w * h for w, h in shapes])
    first = 384 * (np.cumsum(count) - count)
    flat = np.zeros(384 * int(count.sum()), np.int16)
    for k, (f, p) in enumerate(zip(first.tolist(), padded.tolist(), strict=True)):
        flat[f : f + p] = PAD - 128
        flat[f : f + size[k]] = data[offsets[k] : offsets[k + 1]].astype(np.int16) - 128
    return encode(flat.reshape(-1, 6, 64), shapes, [b"payload %d" % p for p in padded])


def unit_coefficients(im: Image, coef: list[np.ndarray]) -> np.ndarray:
    """Coefficients of a 4:2:0 image unit by unit: n x 6 x 64."""
    out = np.empty((len(coef[1]), 6, 64), np.int32)
    luma = np.empty_like(coef[0])
    luma[_raster(im.wide, im.high)] = coef[0]
    out[:, :4], out[:, 4], out[:, 5] = luma.reshape(-1, 4, 64), coef[1], coef[2]
    return out


def read_payload(im: Image, units: np.ndarray) -> bytes:
    """The bytes that store_payloads stored, from the coefficients of a file."""
    return (units.ravel()[: int(im.note.split()[1])] + 128).astype(np.uint8).tobytes()


def unit_rgb(luma: np.ndarray, chroma: np.ndarray) -> np.ndarray:
    """Units of 4:2:0 images in full resolution: n x 3 x 16 x 16, from n x 4 x 8 x 8 and n x 2 x 8 x 8 samples."""
    n = len(luma)
    y = luma.astype(np.int16).reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 8, 2, 8, 2)
    cb, cr = chroma[:, 0] - 128, chroma[:, 1] - 128
    out = np.empty((n, 3, 8, 2, 8, 2), np.uint8)
    for k, add in enumerate((91881 * cr + 32768 >> 16, -(22554 * cb + 46802 * cr + 32768 >> 16), 116130 * cb + 32768 >> 16)):
        out[:, k] = np.clip(y + add.astype(np.int16)[:, :, None, :, None], 0, 255)
    return out.reshape(n, 3, 16, 16)


def layout(units: np.ndarray, wide: int) -> np.ndarray:
    """Units of an image as height x width x 3."""
    high = len(units) // wide
    return units.reshape(high, wide, 3, 16, 16).transpose(0, 3, 1, 4, 2).reshape(16 * high, 16 * wide, 3)


def features(wide: int, units: np.ndarray) -> str:
    """Size, and of each channel the mean in thousandths, the least and the most."""
    flat = units.transpose(1, 0, 2, 3).reshape(3, -1)
    mean = flat.sum(1, dtype=np.int64) * 1000 // flat.shape[1]
    return f"{16 * wide}x{16 * (len(units) // wide)} mean={','.join(map(str, mean.tolist()))} least={','.join(map(str, flat.min(1).tolist()))} most={','.join(map(str, flat.max(1).tolist()))}"


FIELDS = [("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]


def _media(outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            for a, b in common.slices(offsets, SLICE):
                at = offsets[a : b + 1]
                files = store_payloads(data[at[0] : at[-1]], at - at[0])
                rows: dict[str, list] = {n: [] for n in [f[0] for f in FIELDS] + list(outputs)}
                images = decode(files)
                units = [unit_coefficients(im, coef) for im, coef in images]
                every = np.concatenate(units)
                rgb = unit_rgb(samples(every[:, :4].reshape(-1, 64), images[0][0].quant[0]).reshape(-1, 4, 8, 8), samples(every[:, 4:].reshape(-1, 64), images[0][0].quant[0]).reshape(-1, 2, 8, 8))
                done = 0
                for file, n, (im, _), own in zip(files, np.diff(at).tolist(), images, units, strict=True):
                    payload, full = read_payload(im, own), rgb[done : done + len(own)]
                    done += len(own)
                    row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(im.wide, full))
                    for (name, *_), v in zip(FIELDS, row, strict=True):
                        rows[name].append(v)
                    for name in outputs:
                        rows[name].append(file if name == "media" else layout(full, im.wide).tobytes())
                kinds = [f[2] for f in FIELDS] + [pa.binary() for n in outputs]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]], ["doc_id", *rows])

    return run


def media(docs: DataFrame, outputs: tuple[str, ...] = ("media", "rgb")) -> DataFrame:
    """Texts of docs(doc_id, text, ...) stored as progressive JPEG and read back.

    Returns doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes,
    media_sha256, feature (of the RGB tensor), and as outputs ask: media (the file), rgb (height x width x 3 bytes; the
    feature starts with width x height). A null text is an empty one, whose payload is padding alone. Equal texts give
    equal rows; other columns are ignored; no rows give none. Memory follows a slice or the longest text.
    """
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(n, k) for n, k, _ in FIELDS], *[T.StructField(n, T.BinaryType()) for n in outputs]]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_media(outputs), T.StructType(fields))
