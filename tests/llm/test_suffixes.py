"""Operators 3 and 5 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftlink.llm import repetition, suffixdedup


def _removed(rows, length=50):
    seen, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh\xc3\xa9"])
def test_two_stage_order_and_prefixes(alphabet):
    rng, length = random.Random(5), 50
    for _ in range(40):
        strings = [bytes(rng.choices(alphabet, k=rng.randint(50, 90))) for _ in range(rng.randint(1, 8))]
        strings += [s[:-5] + b"aaaaa" for s in strings[:2]]
        n = np.array([len(s) - length + 1 for s in strings])
        first = np.cumsum([0] + [len(s) + 1 for s in strings[:-1]])
        chars = np.frombuffer(b"".join(bytes(c + 1 for c in s) + b"\0" for s in strings), np.uint8)
        w = suffixdedup.words8(chars)
        order = suffixdedup.two_stage(chars, first, n, w)
        text = chars.tobytes()
        assert sorted(order.tolist()) == sorted(int(f) + k for f, m in zip(first, n, strict=True) for k in range(m))
        assert all(text[a : a + 50] <= text[b : b + 50] for a, b in zip(order, order[1:], strict=False))
        lcp = suffixdedup.prefixes(order, w)
        for k in range(1, len(order)):
            a, b = text[order[k] : order[k] + 50], text[order[k - 1] : order[k - 1] + 50]
            assert lcp[k] == next((j for j in range(50) if a[j] != b[j]), 50)


@pytest.mark.parametrize("options", [{}, {"group_bytes": 4000}, {"group_bytes": 4000, "hot": 1}])
def test_removed_bytes(spark, awkward, awkward_rows, options):
    rng = random.Random(7)
    passage = " ".join(rng.choice(["moss", "fern", "oak", "ash"]) + str(rng.randrange(99)) for _ in range(30))
    rows = [(i, t) for i, t, *_ in awkward_rows if i != 10]
    rows += [(100 + k, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(40))) + passage + "x" * k) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.remove_repeats(docs, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(_removed(rows), key=key)
    for r in got:
        assert len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_bytes_decide_where_hashes_are_equal(spark, awkward_rows, monkeypatch):
    """All runs of an anchor share one hash: the result stays."""
    monkeypatch.setattr(suffixdedup.Group, "_hash", lambda self, start, size: np.zeros(len(start), np.uint64))
    rows = [(i, t) for i, t, *_ in awkward_rows if i not in (10, 11) and i is not None]
    got = []
    for part in np.array_split(np.arange(len(rows)), 2):  # two groups, in one process, where the patch holds
        ids = [rows[k][0] for k in part]
        got.append(suffixdedup.Group(_table(ids, [rows[k][1] for k in part]), 50))
    for group in got:
        known, _ = group.keys()
        e = group.entries(np.ones(len(known), bool), np.zeros(len(known), bool), known)
        text = group.data.tobytes()
        for k, start, n in zip(e["of"], e["at"], e["size"]):
            assert n == e["n"][k] and text[start : start + n + 49] == text[e["start"][k] : e["start"][k] + n + 49]
        seen = {}
        for k, a, n in zip(e["key"], e["start"], e["n"], strict=True):
            seen.setdefault(int(k), set()).add(text[a : a + n + 49])
        assert sum(map(len, seen.values())) <= len(e["key"])


def _table(ids, texts):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})


def test_runs_travel_without_what_the_text_tells():
    """A bucket's offer is well under its columns packed as they are, and gives the same runs back."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    text = " ".join(f"{w}" for w in rng.integers(0, 500, 20000))
    key, groups = (pa.scalar(0, pa.int32()),), [_table([k], [text]) for k in (1, 2)]
    sent = [suffixdedup._send_keys(1, 50)(key, g) for g in groups]
    asked = pa.concat_tables([s.set_column(1, "g", pa.array([k] * s.num_rows, pa.int32())) for k, s in enumerate(sent)])
    told = suffixdedup._match_keys(suffixdedup.HOT)(key, asked).slice(0, 1).rename_columns(["rbucket", "rg", "rkind", "rpayload"])
    raw = suffixdedup._send_runs(1, 50)(key, groups[0], told).column("payload")[0].as_py()
    e = suffixdedup._replies(suffixdedup.Group(groups[0], 50), told, 1)
    data = np.frombuffer(text.encode(), np.uint8)
    plain = [data[a : a + n + 49] for a, n in zip(e["start"], e["n"], strict=True)]
    assert len(raw) < 0.85 * len(suffixdedup._pack(e["key"], e["hash"], e["doc"], e["n"].astype("u1"), np.concatenate(plain)))
    k, d, n, back = suffixdedup._offered(raw)
    assert (k == e["key"]).all() and (d == e["doc"]).all() and (n == e["n"]).all() and (back == np.concatenate(plain)).all()
    size = n.astype(np.int64) + 49
    assert (suffixdedup.hashes(back, np.cumsum(size) - size, size, 50 + suffixdedup.RUN) == e["hash"]).all()


def test_buckets_are_even():
    rng = np.random.default_rng(3)
    words = [b"%d" % w for w in rng.integers(0, 5000, 60000)]
    group = suffixdedup.Group(_table([1], [b" ".join(words).decode()]), 50)
    sizes = np.bincount((group.key >> np.uint64(32)).astype(np.int64) * 64 >> 16, minlength=64)
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > sizes.mean() / 2


def test_removal_of_nothing(none, clashing):
    assert suffixdedup.remove_repeats(none).count() == 0
    assert suffixdedup.remove_repeats(clashing).count() == clashing.count()


def _measure(t, least=repetition.LEAST):
    w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    n, seen, dup = len(w), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    three = {k for i in range(n - 2) if count[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    reach = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            reach[i] = max(reach[i], k if k >= 3 else 0)
    covered = {k for i in range(n) if reach[i] >= least for k in range(i, i + reach[i])}
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(three), len(covered), max(reach, default=0)


def test_repetition_figures():
    rng, texts = random.Random(3), ["", "\n\n", " a ", "same line\nsame line\nsame line", "a " * 60]
    for k in range(80):
        words = rng.choices(["a", "b", "é#", "dd", "x%"], k=rng.choice([0, 1, 2, 5, 30, 70])) if k % 2 else [str(rng.randint(0, 500)) for _ in range(70)]
        words += words[:20] + words if k % 3 == 0 else []
        texts.append("".join(x + rng.choice([" ", " ", "\n", "  "]) for x in words))
    raw = [t.encode() for t in texts]
    m = repetition.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
    for k, t in enumerate(texts):
        assert tuple(int(m[c][k]) for c in names) == _measure(t)


def test_repetition_verdicts(awkward, awkward_rows, none, clashing):
    rows = repetition.repetition_rules(awkward).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(awkward_rows)
    assert all(got[k].base_failed and not got[k].kept for k in (4, 5, 6, 7, 11, 13)) and got[4].n_words == 0
    assert got[1].kept and got[2].kept and got[10].n_words == 20000
    assert got[13].n_dup_lines == 39 and got[13].n_repeat_words == 120
    assert repetition.repetition_rules(none).count() == 0 and repetition.repetition_rules(clashing).count() == len(rows)


def test_repetition_rejects_what_the_base_rules_pass(spark):
    words = lambda a, n: " ".join(f"w{k}" for k in range(a, a + n))
    lines = [words(1000 * k, 12) for k in range(1, 11)]
    texts = [
        words(0, 880) + "\n" + words(0, 120) + "\n" + words(5000, 1000),  # one long passage twice
        "\n".join([*lines, words(20000, 800), *lines]),  # many short ones: 240 of 1040 words
        words(0, 9) + "\n" + words(100, 35) + "\n" + words(0, 9),  # one short line twice
        words(0, 1000),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[k].kept for k in range(4)] == [False, False, True, True]
    assert (got[0].longest_repeat, got[1].n_covered_words, got[2].n_covered_words) == (120, 240, 18)
