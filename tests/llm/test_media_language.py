"""Operators 1 and 2."""

import hashlib
import zlib

import numpy as np
import pytest

from weftlink.llm import language, progressive


@pytest.mark.parametrize("density", [0, 0.02, 0.1, 0.5, 1])
def test_coefficients_survive(density):
    rng = np.random.default_rng(int(density * 100))
    for _ in range(4):
        shapes = [(int(rng.integers(1, 4)), int(rng.integers(1, 4))) for _ in range(3)]
        n = sum(w * h for w, h in shapes)
        units = rng.integers(-500, 500, (n, 6, 64)) * (rng.random((n, 6, 64)) < density)
        units = np.where(rng.random(units.shape) < 0.4, np.sign(units), units).astype(np.int16)
        at = 0
        for (w, h), (im, coef) in zip(shapes, progressive.decode(progressive.encode(units, shapes, [b"x"] * 3)), strict=True):
            assert (progressive.unit_coefficients(im, coef) == units[at : at + w * h]).all()
            assert (im.width, im.height) == (16 * w, 16 * h)
            at += w * h


def _bits(items):
    text = "".join(format(v, f"0{n}b") for v, n in items if n)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_end_of_band_runs_without_restarts():
    """A grey image of 3 x 1 blocks, one segment a scan, an end-of-band run over two blocks, and a refinement."""
    dc = {2: (0, 2), 3: (1, 2), 0: (2, 2)}
    ac = {0x02: (0, 3), 0x10: (1, 3), 0x00: (2, 3), 0x01: (3, 3)}
    seg = progressive._segment
    table = lambda kind, t: bytes([kind]) + bytes(sum(n == k for _, n in t.values()) for k in range(1, 17)) + bytes(sorted(t, key=lambda s: t[s]))
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC4, table(0, dc) + table(0x10, ac)) + seg(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    scan = lambda lo, hi, high, low: seg(0xDA, bytes([1, 1, 0, lo, hi, high << 4 | low]))
    first = scan(0, 0, 0, 0) + _bits([dc[3], (0b101, 3), dc[0], dc[2], (0b00, 2)])  # 5, 5, 2
    band = scan(1, 63, 0, 1) + _bits([ac[0x02], (0b10, 2), ac[0x10], (0, 1), ac[0x02], (0b11, 2), ac[0x00]])
    # block 0: value 2 << 1, then a run of two blocks; block 2 begins anew with 3 << 1
    later = scan(1, 63, 1, 0) + _bits([ac[0x01], (0, 1), (1, 1), ac[0x00], ac[0x10], (0, 1), (1, 1)])
    # block 0: a fresh -1 behind the old value, whose correction bit is 1; then a run of blocks 1 and 2, correction 1
    (im, (coef,)) = progressive.decode([head + first + band + later + b"\xff\xd9"])[0]
    assert coef[:, 0].tolist() == [5, 5, 2]
    assert coef[:, 1].tolist() == [5, 0, 7] and coef[0, 2] == -1 and np.count_nonzero(coef[:, 2:]) == 1
    assert progressive.tensor(im, [coef]).shape == (8, 24, 3)


def test_inverse_transform_is_the_cosine_one():
    rng = np.random.default_rng(0)
    coef = np.zeros((5, 64), np.int32)
    coef[:, :20] = rng.integers(-60, 60, (5, 20))
    got = progressive.samples(coef, np.ones(64, int))
    for b in range(5):
        square = np.zeros(64)
        square[progressive.ZIGZAG] = coef[b]
        square = square.reshape(8, 8)
        k = np.arange(8)
        c = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
        assert np.abs(np.clip(c @ square @ c.T + 128, 0, 255) - got[b]).max() <= 1.01


def test_media_reads_back_every_payload(awkward, awkward_rows, none):
    got = progressive.media(awkward).collect()
    assert len(got) == len(awkward_rows)
    texts = {}
    for i, t, *_ in awkward_rows:
        texts.setdefault(i, (t or "").encode())
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        w, h = map(int, r.feature.split()[0].split("x"))
        im, coef = progressive.decode([bytes(r.media)])[0]
        assert (progressive.tensor(im, coef).reshape(-1) == np.frombuffer(bytes(r.rgb), np.uint8)).all() and len(r.rgb) == 3 * w * h
    same = {(r.payload_sha256, r.media_sha256, r.feature) for r in got}
    assert len(same) == len({r.payload_sha256 for r in got})
    assert progressive.media(none).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(awkward, none, clashing):
    got = {r.doc_id: r for r in language.languages(awkward).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (4, 5, 6, 9))
    assert got[7].lang_pred != "und" and got[11].lang_pred != "und"
    assert language.languages(none).count() == 0
    assert language.languages(clashing).count() == awkward.count()
    assert {r.lang_pred for r in language.languages(awkward.where("doc_id in (4, 7)").drop("lang").withColumnRenamed("source", "lang").selectExpr("*", "'s' source").where("false")).collect()} == set()


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(3)
    a, b = ["".join(rng.choice(list(x), 5)) for x in ("abcde",) * 300], ["".join(rng.choice(list(x), 5)) for x in ("vwxyz",) * 300]
    texts = [" ".join(a), " ".join(b)]
    p = []
    for t in texts:
        _, bucket, count = language.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        p.append(np.bincount(bucket, count, 1 << language.BITS) + 0.01)
    model = language.Model(["a", "b"], np.stack([x / x.sum() for x in p], 1).astype(np.float32))
    both = (" ".join(a[:100] + b[:100]) + " " + " ".join(a[:100])).encode()
    chosen, _ = model.mixture(np.frombuffer(both, np.uint8), np.array([0, len(both)]))
    assert chosen[0][0] == pytest.approx(2 / 3, abs=0.03) and chosen[0][1] == pytest.approx(1 / 3, abs=0.03)
    one, _ = model.mixture(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])]))
    assert one[0].tolist() == [1, 0]


def _toy(languages=5, buckets=40, seed=1):
    rng = np.random.default_rng(seed)
    return language.Model([f"l{k}" for k in range(languages)], rng.dirichlet(np.full(buckets, 0.15), languages).T.astype(np.float32) + 1e-4)


def test_chosen_sets_equal_a_search_of_all_sets(monkeypatch):
    """Expectation-maximisation over every subset of five languages, by hand; the chosen set has the best value."""
    import itertools

    model, rng = _toy(), np.random.default_rng(5)
    truth = [s for size in (1, 2, 3, 4, 5) for s in itertools.islice(itertools.combinations(range(5), size), 4)]
    counts = [rng.multinomial(3000, (model.p[:, list(s)] / model.p.sum(0)[list(s)]).mean(1) / (model.p[:, list(s)] / model.p.sum(0)[list(s)]).mean(1).sum()) for s in truth]
    row = np.concatenate([np.full(np.count_nonzero(c), k) for k, c in enumerate(counts)])
    monkeypatch.setattr(language, "grams", lambda data, offsets: (row, np.concatenate([np.flatnonzero(c) for c in counts]), np.concatenate([c[c > 0] for c in counts])))
    chosen, _ = model.mixture(np.zeros(0, np.uint8), np.zeros(len(truth) + 1, np.int64))

    def value(c, pick):
        pi, p = np.full(len(pick), 1 / len(pick)), model.p[:, list(pick)].astype(float)
        for _ in range(300):
            part = p * pi
            pi = (c[:, None] * part / part.sum(1, keepdims=True)).sum(0) / c.sum()
        return float((c * np.log((p * pi).sum(1))).sum()) - language.PENALTY * (len(pick) - 1) * np.log(c.sum()), pi

    for k, (c, want) in enumerate(zip(counts, truth, strict=True)):
        values = {s: value(c, s) for size in range(1, 6) for s in itertools.combinations(range(5), size)}
        best = max(values, key=lambda s: values[s][0])
        got = tuple(np.flatnonzero(chosen[k] > 0).tolist())
        assert got == best == want
        assert chosen[k][list(best)] == pytest.approx(values[best][1], abs=0.03)
