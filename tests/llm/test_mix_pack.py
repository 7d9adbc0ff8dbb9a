"""Operators 7 and 8."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import mixing, packing
from weftlink.llm.registry import tokenizer_path


def test_targets_stop_at_three_times_the_source():
    got = mixing.targets({"a": 1000, "b": 10, "c": 500, None: 5})
    assert got["b"] == 30 and got[None] == 15  # null is last and weighs 1
    assert sum(got.values()) == pytest.approx(1515) and got["c"] == pytest.approx(3 * got["a"])
    assert list(mixing.targets({"é": 1, "z": 1, None: 1})) == ["z", "é", None]
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_split_tree_keeps_every_unit():
    units = np.array([1000, 1, 0, 37, 512])
    out = mixing.split_tree(units, 7, 1)
    assert (out.sum(0) == units).all() and (out >= 0).all()
    assert out.sum(1).max() - out.sum(1).min() <= 3
    assert (out == mixing.split_tree(units, 7, 1)).all() and (out != mixing.split_tree(units, 7, 2)).any()


def test_draw_comes_near():
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice([1, 5, 50, 400]) for _ in range(60)]
        want = rng.random() * sum(words)
        got = sum(words[b] for b in mixing.draw(words, list(range(60)), want))
        assert abs(got - want) <= 25.5


def test_draw_is_nearest():
    """No subset comes nearer, by all subsets; large sizes come as near as rounding lets them."""
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice([0, 1, 3, 7, 50, 400, 401]) for _ in range(rng.randrange(11))]
        want = rng.random() * (sum(words) + 5)
        sums = {0}
        for w in words:
            sums |= {s + w for s in sums}
        order = rng.sample(range(len(words)), len(words))
        got = mixing.draw(words, order, want)
        assert len(set(got)) == len(got)
        assert abs(sum(words[b] for b in got) - want) == min(abs(s - want) for s in sums)
    words = [rng.randrange(10**8, 10**9) for _ in range(1000)]
    want = 0.37 * sum(words)
    got = mixing.draw(words, list(range(1000)), want)
    assert len(set(got)) == len(got) and abs(sum(words[b] for b in got) - want) < 1e-4 * want
    assert set(range(300)) <= set(got)  # the permuted order decides all but the last


def test_layout_follows_the_words():
    for words in (0, 10**6, 10**9, 10**13):
        shards, runs, blocks = mixing.layout(words, 10)
        assert shards * runs * mixing.RUN_WORDS >= words and 10 * shards <= max(mixing.MOST_ENDS, 10 * mixing.SHARDS) and blocks >= 16 * shards


def test_mix_over_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).withColumn("taken", F.col("size") * F.size("draws")).collect()
    assert len(rows) == docs.count()
    size = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target and sum(r["size"] for r in own) == own[0].source_size
    again = {r.doc_id: r.draws for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.draws for r in rows}
    full = mixing.mixed_rows(docs)
    assert full.columns == docs.columns
    assert {r.doc_id: r["count"] for r in full.groupBy("doc_id").count().collect()} == {r.doc_id: len(r.draws) for r in rows if r.draws}


def test_mix_edge_cases(awkward, awkward_rows, none, clashing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(awkward_rows)
    for r in rows:
        assert r.source_size >= r["size"] and len(r.draws) <= 3 and r.target <= 3 * r.source_size
    assert {r.source for r in rows if r.doc_id in (4, 6)} == {None} and all(r.target == 0 and not r.draws for r in rows if r.source is None)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert mixing.mix(clashing).count() == len(rows)
    own = "mix_none mix_src mix_block mix_draws mix_draw mix_rank row rank shard draw words pass turn".split()
    more = clashing.withColumns({n: F.lit(f"my {n}") for n in own})
    back = mixing.mixed_rows(more)
    assert back.columns == more.columns and back.schema == more.schema
    assert all(r[n] == f"my {n}" for r in back.collect() for n in own)


def test_ids_equal_the_tokenizer():
    ids, rng = packing.ids_of(tokenizer_path()), random.Random(5)
    parts = ["a", " ", "\n", "  ", "é", "##", "It's", " \n", "1", "23", ".", "\t", "Éx", "\r\n", "日本", " b", "<|endoftext|>", " ", "\x85"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert ids.of(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def _cheapest(at, cost, width):
    best = [0.0] + [np.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= width:
                pad = 0 if n == width // 2 else width - n
                best[j] = min(best[j], best[i] + pad + cost[j] + packing.SEQUENCE)
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        at = [0]
        while len(at) < 40:
            at.append(at[-1] + rng.choice([1, 3, 8, 12, 16]))
        cost = [0.0] + [rng.choice([0.0, 4.0, 16.0]) for _ in at[1:]]
        cuts = packing.cut(np.array(at), np.array(cost), 32)
        total, last, by = 0.0, 0, dict(zip(at, cost, strict=True))
        for c in cuts:
            n = c - last
            assert 0 < n <= 32
            total += (0 if n == 16 else 32 - n) + by[c] + packing.SEQUENCE
            last = c
        assert last == at[-1] and total == pytest.approx(_cheapest(at, cost, 32))


def _check(pieces, texts):
    ids = packing.ids_of(tokenizer_path())
    want = [np.append(np.frombuffer(ids.of(t or ""), "<u4"), 0).astype("<u4") for t in texts]
    assert sum(p.length for p in pieces) == sum(map(len, want))
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 1024
    return want


def test_pack_edge_cases(awkward, awkward_rows, none):
    pieces = packing.pack(awkward, tokenizer_path(), with_ids=True).collect()
    want = _check(pieces, [t for _, t, *_ in awkward_rows])
    by = {i: w for (i, *_), w in zip(awkward_rows, want, strict=True)}
    for p in pieces:
        own = by[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(by[p.doc_id]) and p.ids_crc32 == zlib.crc32(own.tobytes()) and own.tolist() == p.ids
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_pack_pads_little(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 1 << 14)  # many stretches
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    pieces = packing.pack(docs, tokenizer_path()).collect()
    _check(pieces, [r.text for r in docs.collect()])
    sums = {}
    for p in pieces:
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sums.values()) / sum(sums.values()) < 0.02
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert list(dict.fromkeys(order)) == [r.doc_id for r in docs.collect()]
