"""Small exact cases for what SQL can't check: text, similarity, contracts, folds, learning, files, streams."""

import collections
import functools
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.functions import similarity as sim
from weftlink.functions import text as tx
from weftlink.functions.metrics import fbeta, macro_entity_fbeta
from weftlink.operators import audit, blocking, evaluate, features, learning, retrieval, sampling, splits, submission
from weftlink.plans.fixtures import fixture
from weftlink.schema import RECORD, TRUTH, ContractError
from weftlink.sources import tables
from weftlink.streaming.scoring import stream_candidates

RECORDS = [
    ("S1-1", "Acme & Sons, Pvt. Ltd.", "12 Main Road 560001", "India"), ("S1-2", "Café Bleu", "4 Rue du Lac", "France"), ("S1-3", "Lone Star", "", "US"),
    ("S2-1", "ACME and Sons Pvt Ltd", "12 Main Rd 560001", "India"), ("S2-2", "Cafe Bleu", "4 Rue du Lac", "France"), ("S3-1", "acme & sons pvt ltd", "", "India"),
]
TRUTHS = [("S1-1", "S2-1,S3-1"), ("S1-2", "S2-2"), ("S1-3", "")]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, RECORD)


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(TRUTHS, TRUTH)


def _sides(records):
    part = lambda p: records.where(F.col("entity_id").startswith(p))
    return blocking.queries_of(part("S1-")), blocking.targets_of(("source2", part("S2-")), ("source3", part("S3-")))


def test_normalizers_differ(spark):
    row = spark.createDataFrame([("  ACME & Sons_1, Pvt. Ltd.  Straße ﬁ",)], "t string").select(tx.normalize_sql("t").alias("a"), tx.normalize_unicode("t").alias("b")).first()
    assert row.a == "acme and sons 1 pvt ltd straße ﬁ"
    assert row.b == "acme and sons_1 pvt ltd strasse fi"


def test_nulls_are_empty(spark):
    row = spark.createDataFrame([(None,)], "t string").select(tx.normalize_sql("t").alias("a"), tx.normalize_unicode("t").alias("b"), tx.with_bare_accents("t").alias("c")).first()
    assert tuple(row) == ("", "", "")


def test_retrieval_text_has_bare_accents(spark):
    rows = spark.createDataFrame([("Café_A & B",), ("plain",)], "t string").select(tx.with_bare_accents("t").alias("a")).collect()
    assert [r.a for r in rows] == ["café_a and b cafe_a and b", "plain"]


def test_grams(spark):
    row = spark.createDataFrame([("ab cd",)], "t string").select(tx.grams(F.col("t"), 2, 3).alias("g"), tx.word_grams(F.col("t"), 2, 3).alias("w"), tx.word_pairs(F.col("t")).alias("p")).first()
    assert sorted(row.g) == sorted(["ab", "b ", " c", "cd", "ab ", "b c", " cd"])
    assert sorted(row.w) == sorted([" a", "ab", "b ", " ab", "ab ", " c", "cd", "d ", " cd", "cd "])
    assert row.p == ["ab", "cd", "ab cd"]


def test_measures_of_long_texts(spark):
    """Against the plain tables and scans, and over texts on both sides of the length from which bits are used."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    def matches(a, b):
        reach, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
            if j is not None:
                used.add(j)
                hits.append(c)
        other, m = [b[j] for j in sorted(used)], len(hits)
        return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(hits, other, strict=True)) // 2) / m) / 3 if m else 0.0

    rng = random.Random(3)
    made = [tuple("".join(rng.choice("abcé") for _ in range(rng.randint(1, n))) for _ in range(2)) for n in [12] * 300 + [200] * 8]
    made += [("x" * 150 + "abc" + "y" * 90, "x" * 150 + "acb" + "y" * 90), ("z" * 140, "z" * 140)]
    for a, b in made:
        a, b = a.encode(), b.encode()
        assert sim.edit_distance(a, b) == distance(a, b)
        if a != b:
            assert sim._jaro(a, b) == pytest.approx(matches(a, b))
    df = spark.createDataFrame([*made, (None, "z" * 200)], "a string, b string")
    got = [r.d for r in df.select(sim.byte_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [distance(a.encode(), b.encode()) for a, b in made] + [None]


def test_edit_distance_steps_over_the_shorter_text():
    """In either order a short text and a long one take time in proportion to the long one, or little more."""
    rng = random.Random(2)
    short, long = (bytes(rng.choice(b"abcdef") for _ in range(n)) for n in (60, 200_000))

    def took(a, b):
        began = time.process_time()
        assert sim.edit_distance(a, b) == len(long) - len(short)
        return time.process_time() - began

    plain = time.process_time()
    assert sum(1 for c in long if c in short) > 0
    plain = time.process_time() - plain
    assert max(min(took(*x) for _ in range(3)) for x in ((short, long), (long, short))) < 8 * plain


@pytest.mark.parametrize("floor", [0.1, 0.4])
def test_retrieval_finds_all_pairs_above_the_floor(spark, floor, monkeypatch):
    """Common grams that join late change nothing: the same pairs as with a floor of 0, cut afterwards."""
    monkeypatch.setattr(retrieval, "PER_LIST", 3)
    rng, words = random.Random(5), [f"w{i}" for i in range(40)]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(1, 15)))
    q = spark.createDataFrame([(f"S1-{i}", "x", text(), text()) for i in range(20)], "source1_entity_id string, country string, name string, address string")
    t = spark.createDataFrame([(f"S2-{i}", "source2", "x", text(), text()) for i in range(30)], "candidate_entity_id string, candidate_source string, country string, name string, address string")
    for a in (0.0, 0.35):
        found = lambda f: {(r[0], r[1]): r.char_name_score for r in retrieval.top_k(q, t, retrieval.RetrievalConfig(min_similarity=f, address_weight=a), grams=tx.word_pairs).select("source1_entity_id", "candidate_entity_id", "char_name_score").collect()}  # noqa: B023, E731
        everything = found(0.0)
        want = {k: v for k, v in everything.items() if v >= floor}
        got = found(floor)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_retrieval_keeps_no_pairs(spark, monkeypatch):
    """Records that all share grams: what is stored grows with records, not with their pairs, and blocks change nothing."""
    kept, keep = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    rng = random.Random(3)
    text = lambda: "the common start " + " ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(4))
    q = spark.createDataFrame([(f"S1-{i}", "x", text(), "") for i in range(60)], "source1_entity_id string, country string, name string, address string")
    t = spark.createDataFrame([(f"S2-{i}", "source2", "x", text(), "") for i in range(60)], "candidate_entity_id string, candidate_source string, country string, name string, address string")
    config = retrieval.RetrievalConfig(top_k=3)
    one = sorted(map(tuple, retrieval.top_k(q, t, config).collect()))
    assert len(one) == 180 and sum(df.count() for df in kept) <= 60 + 60 + 1
    monkeypatch.setattr(retrieval, "PER_LIST", 7)
    monkeypatch.setattr(retrieval, "PER_BLOCK", 1)
    many = sorted(map(tuple, retrieval.top_k(q, t, config).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in many] and all(a[3] == pytest.approx(b[3], abs=2e-9) for a, b in zip(one, many, strict=True))


def test_common_grams_are_summed_by_matrices(monkeypatch):
    """Which grams count as common, and how many fit a matrix, changes no cosine; a gram of all targets is not added
    target by target."""
    rng = random.Random(7)
    text = lambda: [1, 2, *{int(rng.expovariate(0.05)) + 3 for _ in range(25)}]
    lists = [text() for _ in range(240)]
    t = pa.table({"kind": pa.array([1] * 200 + [2] * 40, pa.int32()), "field": pa.array([-1] * 240, pa.int32()), "id": [f"S-{i:03}" for i in range(240)], "n": pa.array([200] * 240, pa.int64()), "same": pa.array(range(240), pa.int64()), "c0": pa.array(lists, pa.list_(pa.int64()))})
    added, near = [], retrieval._nearest
    monkeypatch.setattr(retrieval, "_nearest", lambda acc, own, w, first, *a: added.append(int((first[own + 1] - first[own]).max(initial=0))) or near(acc, own, w, first, *a))

    def found(cells, common, floor, top):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "COMMON", common)
        added.clear()
        out = retrieval._score([1.0], retrieval.RetrievalConfig(top_k=top, min_similarity=floor))((pa.scalar("source2"),), t).to_pylist()
        return {(r["source1_entity_id"], r["candidate_entity_id"]): r["cosine"] for r in out}, max(added)

    for floor, top in ((0.0, 200), (0.3, 200), (0.1, 5)):
        (plain, most), *others = [found(*x, floor, top) for x in ((0, 16), (1 << 23, 16), (900, 4), (1 << 23, 1 << 30))]
        assert most == 200 and others[0][1] <= 200 // 16 and others[1][1] < 200 and plain
        for got, _ in others:
            assert set(got) == set(plain) and all(got[k] == pytest.approx(plain[k], abs=1e-12) for k in plain)


def test_grams_of_one_target_needn_t_be_listed():
    """A block with the frequencies of the group's grams, but for those of one target that no query has, finds what a block
    finds that counts them itself."""
    rng = random.Random(11)
    lists = [[*{int(rng.expovariate(0.03)) for _ in range(20)}, 1000 + i] for i in range(60)]
    schema = pa.schema([("kind", pa.int32()), ("field", pa.int32()), ("id", pa.string()), ("n", pa.int64()), ("same", pa.int64()), ("c0", pa.list_(pa.int64())), ("df", pa.list_(pa.int64()))])
    rows = [{"kind": 1 + (i >= 50), "field": -1, "id": f"S-{i}", "n": 50, "same": i, "c0": c, "df": None} for i, c in enumerate(lists)]
    df = collections.Counter(c for one in lists[:50] for c in one)
    asked = {c for one in lists[50:] for c in one}
    listed = {c: k for c, k in df.items() if k > 1 or c in asked}
    assert len(listed) < len(df)
    terms = {"kind": 0, "field": 0, "id": "", "n": 50, "same": 0, "c0": list(listed), "df": list(listed.values())}
    run = retrieval._score([1.0], retrieval.RetrievalConfig(top_k=7))
    found = lambda rows: {(r["source1_entity_id"], r["candidate_entity_id"]): r["cosine"] for r in run((pa.scalar("source2"),), pa.Table.from_pylist(rows, schema)).to_pylist()}
    want, got = found(rows), found([*rows, terms])
    assert want and set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_keys_and_equal_texts_need_little_shuffle(spark):
    """Keys of records with ids of their own are exploded where the records are, and joins carry no texts; repeated ids
    still have each key once."""
    rows = [(f"S2-{i}", "source2", "x", "alpha alpha betamax alphabet", f"beta 12 beta {i}") for i in range(4)]
    t = spark.createDataFrame(rows, "candidate_entity_id string, candidate_source string, country string, name string, address string")
    ids = ["candidate_entity_id", "candidate_source"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keys = blocking.blocking_keys(t, ids)
    assert "Exchange" not in plan(keys)
    once = sorted(map(tuple, keys.collect()))
    assert len(once) == len(set(once)) and ("S2-0", "source2", "x", "name_prefix", "alph", 0.65) in once
    assert sorted(map(tuple, blocking.blocking_keys(t.union(t), ids).collect())) == once
    q = t.select(F.col("candidate_entity_id").alias("source1_entity_id"), "country", "name", "address")
    found = blocking.exact_candidates(q, t)
    assert "hashpartitioning(country" not in plan(found) or "address#" not in plan(found).split("hashpartitioning(country")[1].split("\n")[0]
    assert found.where("exact_name = 1").count() == 16 and found.where("exact_address = 1").count() == 4


def test_only_selected_keys_of_targets_travel(spark, monkeypatch):
    """Target keys that no query selected don't reach the join; shared places of the table change no result."""
    q = spark.createDataFrame([("S1-1", "x", "alpha", "lake 77")], "source1_entity_id string, country string, name string, address string")
    rows = [(f"S2-{i}", "source2", "x", "alpha" if i < 2 else "other", f"lake {i} unmet words of many kinds{i}") for i in range(300)]
    t = spark.createDataFrame(rows, "candidate_entity_id string, candidate_source string, country string, name string, address string")
    seen, join = [], blocking.fuzzy_candidates
    monkeypatch.setattr(blocking, "fuzzy_candidates", lambda s, k, c: seen.append(k) or join(s, k, c))
    found = sorted(map(tuple, blocking.rule_candidates(q, t).collect()))
    assert {r[1] for r in found} == {"S2-0", "S2-1"}
    assert 6 <= seen[0].count() < 20
    monkeypatch.setattr(blocking, "SLOTS", 2)
    assert sorted(map(tuple, blocking.rule_candidates(q, t).collect())) == found


@pytest.mark.parametrize("name", ["pair_features_numbers", "pair_features_tokens"])
def test_features_of_parts_of_an_address_carry_those_alone(spark, sf_dir, monkeypatch, name):
    """Addresses that are attached to pairs are runs of digits, or words without repeats."""
    from weftlink.plans import registry

    seen, attach = [], features.attach
    monkeypatch.setattr(features, "attach", lambda c, q, t: seen.append((q, t)) or attach(c, q, t))
    registry.QUERIES[name](spark, sf_dir)
    for df in seen[0]:
        for r in df.select("address").limit(40).collect():
            words = r.address.split()
            assert all(w.isdecimal() for w in words) if name.endswith("numbers") else len(words) == len(set(words))


def test_similarity_values():
    assert sim.jaro_winkler_bytes(b"martha", b"marhta") == pytest.approx(0.9611, abs=1e-4)
    assert sim.jaro_winkler_bytes(b"", b"") == 0
    assert sim.indel_ratio("abcd", "abed") == pytest.approx(0.75)
    assert sim.token_set_similarity("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert sim.token_set_similarity("", "x") == 0


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("", "abc"), ("abcabc", "cab"), ("ééa", "aé")])
def test_indel_ratio_is_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sim.indel_ratio(a, b) == pytest.approx(2 * table[-1][-1] / (len(a) + len(b)))


def test_metric():
    assert fbeta({"S2-00047", "S2-00193", "S3-00812"}, {"S2-00047", "S3-00812"}) == pytest.approx(5 / 7)
    assert macro_entity_fbeta({"a": ["x"]}, {"a": ["x"], "b": []}) == 1
    with pytest.raises(ValueError):
        macro_entity_fbeta({}, {})


def test_threshold_tie_takes_the_higher(spark):
    scores = spark.createDataFrame([("S1-1", "S2-1", "source2", 0.9), ("S1-1", "S2-2", "source2", 0.4)], "source1_entity_id string, candidate_entity_id string, candidate_source string, score double")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    curve = evaluate.threshold_curve(scores, truth, entities, 11)
    assert evaluate.best_threshold(curve).first().threshold == pytest.approx(0.9)
    assert {r.threshold_index: r.macro_f0_5 for r in curve.collect()}[10] == 0.5
    tuned = evaluate.tune_source_thresholds(scores, truth, entities, 0.5, minimum_gain=0.1)
    assert not tuned["accepted"] and tuned["thresholds"] == {"source2": 0.5, "source3": 0.5}


def test_no_positives_has_no_division_error(spark):
    scores = spark.createDataFrame([], "source1_entity_id string, candidate_entity_id string, candidate_source string, score double")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    row = evaluate.evaluate(scores, truth, spark.createDataFrame([("S1-1",)], "source1_entity_id string"), 0.5).first()
    assert row.macro_f0_5 == 0 and row.singleton_accuracy is None


def test_candidates_reach_every_match(records, truth):
    q, t = _sides(records)
    found = blocking.rule_candidates(q, t)
    got = {(r.source1_entity_id, r.candidate_entity_id) for r in found.collect()}
    assert {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")} <= got
    top = retrieval.top_k(q, t, retrieval.RetrievalConfig(top_k=5, address_weight=0.35))
    best = {r.source1_entity_id: r for r in top.orderBy("char_name_score").collect()}
    assert best["S1-2"].candidate_entity_id == "S2-2" and best["S1-1"].char_name_score <= 1
    assert "S1-3" not in best
    report = blocking.report(q, t, found, splits.truth_pairs(truth)).first()
    assert report.pair_recall == 1 and report.zero_candidate_queries == 1
    both = features.pair_features(blocking.merge_evidence(found, top), q, t)
    assert tuple(both.columns[3:]) == features.FEATURES and len(features.FEATURES) == 42
    assert both.where(" or ".join(f"{f} is null or isnan({f})" for f in features.FEATURES)).count() == 0


def test_null_country_matches_nothing(spark):
    one = spark.createDataFrame([("S1-1", "x y", "", None), ("S2-1", "x y", "", None)], RECORD)
    q, t = _sides(one)
    assert blocking.rule_candidates(q, t).count() == 0
    assert blocking.exact_candidates(q, t, by_country=False).count() == 1


def test_contracts(spark, records, truth):
    tagged = records.withColumn("source", F.concat(F.lit("source"), F.substring("entity_id", 2, 1)))
    audit.require_contract(tagged, truth)
    bad = truth.union(spark.createDataFrame([("S1-9", "S2-1,S2-1,")], TRUTH))
    wrong = {r.check: r.violations for r in audit.contract_violations(tagged, bad).collect() if r.violations}
    assert set(wrong) == {"truth_of_unknown_entities", "unknown_targets", "targets_with_two_owners", "lists_with_repeats", "lists_with_blanks"}
    assert audit.parse_id_list("S2-1,S3-1") == ("S2-1", "S3-1") and audit.parse_id_list("") == ()
    for text in ("S2-1,", "S2-1,S2-1"):
        with pytest.raises(ContractError):
            audit.parse_id_list(text)


def test_greedy_folds_balance_each_stratum():
    items = [(f"e{k}", "ab"[k % 2], 1 + k % 3) for k in range(40)]
    folds = splits.greedy_folds(items, 4, lambda x: x[::-1])
    for s in "ab":
        counts = [sum(folds[k] == f for k, t, _ in items if t == s) for f in range(4)]
        assert max(counts) - min(counts) <= 1


def test_split_config_must_sum_to_one():
    with pytest.raises(ValueError):
        splits.SplitConfig(0.9, 0.2, 0.05)
    assert splits.EXPERIMENT_NAMES["local_test"] == "holdout"


def test_matcher_learns_and_is_read_again(spark, sf_dir, tmp_path):
    x = fixture(spark, sf_dir)
    q, t = x.queries(), x.targets()
    sample = sampling.training_sample(x.candidates(), x.pairs())
    made = features.pair_features(sample, q, t, keep=("label", "sample_weight", "cv_fold", "calibration_bucket")).persist()
    matcher = learning.fit_matcher(made, learning.MatcherConfig("logistic"))
    learning.save(matcher, f"file://{tmp_path}/m")
    scored = learning.score_pairs(made, matcher)
    again = learning.score_pairs(made, learning.load(f"file://{tmp_path}/m"))
    one, two = (sorted((r.source1_entity_id, r.candidate_entity_id, round(r.score, 9)) for r in df.collect()) for df in (scored, again))
    assert one == two and all(0 <= s <= 1 for *_, s in one)
    ranks = {(r.source1_entity_id, r.candidate_entity_id): r.label for r in made.select("source1_entity_id", "candidate_entity_id", "label").collect()}
    mean = lambda k: sum(s for a, b, s in one if ranks[a, b] == k) / max(1, sum(v == k for v in ranks.values()))
    assert mean(1) > mean(0) + 0.3
    assert learning.fit_baseline(learning.label_pairs(made.drop("label"), x.pairs()), features.FEATURES).score(made).count() == made.count()
    made.unpersist()


def test_tsv_round_trip_keeps_cells_as_text(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"multi\tNA\t\nS1-2\t007\t\tUS\n')
    got = tables.read_tsv(spark, f"file://{path}")
    assert [tuple(r) for r in got.orderBy("entity_id").collect()] == [("S1-1", '"multi', "NA", ""), ("S1-2", "007", "", "US")]
    with pytest.raises(ContractError):
        tables.read_tsv(spark, f"file://{path}", TRUTH)


def test_singletons_are_empty_cells(spark, tmp_path):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    scores = spark.createDataFrame([("S1-1", "S3-2", "source3", 0.9), ("S1-1", "S2-1", "source2", 0.8)], "source1_entity_id string, candidate_entity_id string, candidate_source string, score double")
    out = submission.matches(entities, scores, 0.5).orderBy("source1_entity_id")
    tables.write_tsv(out, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n"
    targets = spark.createDataFrame([("S2-1",), ("S3-2",)], "candidate_entity_id string")
    offered = submission.candidate_lists(entities, scores)
    submission.require_valid(submission.checks(out, offered, entities, targets))
    with pytest.raises(ContractError):
        submission.require_valid(submission.checks(out, offered.withColumn("candidate_entity_ids", F.lit("")), entities, targets))


def test_tables_with_missing_columns(spark, tmp_path):
    spark.range(2).selectExpr("'S1-1' source1_entity_id", "concat('S2-', id) candidate_entity_id", "1 exact_name").write.parquet(f"{tmp_path}/a")
    spark.range(1).selectExpr("'S1-1' source1_entity_id", "'S2-0' candidate_entity_id", "2.5D fuzzy_score").write.parquet(f"{tmp_path}/b")
    both = tables.with_evidence(tables.read_tables(spark, f"{tmp_path}/a", f"{tmp_path}/b"))
    assert both.count() == 3 and both.agg(F.max("fuzzy_score"), F.sum("exact_name")).first() == (2.5, 2)
    assert len(tables.fingerprint(tmp_path / "a")) == 64


def test_stream_gives_the_batch_result(spark, records, tmp_path):
    records.where("entity_id like 'S1-%'").write.parquet(f"{tmp_path}/in")
    q, t = _sides(records)
    stream = spark.readStream.schema(RECORD).parquet(f"{tmp_path}/in")
    stream_candidates(stream, t, lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}"), f"{tmp_path}/checkpoint").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, blocking.rule_candidates(q, t).collect()))


def test_registered_retrieval_has_the_operators_defaults(spark, sf_dir, monkeypatch):
    from weftlink.plans import registry

    partners = registry.QUERIES["text_topk"](spark, sf_dir).groupBy("source1_entity_id", "candidate_source").count().agg(F.max("count")).first()[0]
    assert 10 < partners <= 50
    seen = []
    monkeypatch.setattr(retrieval, "top_k", lambda q, t, config, **more: seen.append(config) or q)
    for name in ("text_topk", "fused_topk"):
        registry.QUERIES[name](spark, sf_dir)
    assert [(c.top_k, c.low, c.high) for c in seen] == [(50, 2, 5), (100, 2, 5)]


def _pair_tables(spark):
    queries = spark.createDataFrame([("S1-1", "x", "a b", "c")], "source1_entity_id string, country string, name string, address string")
    targets = spark.createDataFrame([("S2-1", "source2", "x", "a b", "c"), ("S2-2", "source2", None, "d", "")], "candidate_entity_id string, candidate_source string, country string, name string, address string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", "source2"), ("S1-1", "S2-2", "source2")], "source1_entity_id string, candidate_entity_id string, candidate_source string")
    return pairs, queries, targets


def test_attach_keeps_every_candidate_or_raises(spark):
    from weftlink.operators import features

    pairs, queries, targets = _pair_tables(spark)
    got = {r.candidate_entity_id: r for r in features.attach(pairs, queries, targets).collect()}
    assert len(got) == 2 and got["S2-2"].t_country is None and got["S2-2"].t_name_frequency == 1 and got["S2-1"].q_name == "a b"
    bad = [
        (pairs.selectExpr("'S1-9' source1_entity_id", "candidate_entity_id", "candidate_source"), queries, targets, "no record"), (pairs.selectExpr("source1_entity_id", "'S2-9' candidate_entity_id", "candidate_source"), queries, targets, "no record"),
        (pairs, queries.union(queries), targets, "repeated"), (pairs, queries, targets.union(targets), "repeated"), (pairs.withColumn("candidate_source", F.lit("source3")), queries, targets, "another source"),
    ]
    for p, q, t, what in bad:
        with pytest.raises(Exception, match=what):
            features.pair_features(p, q, t).select("name_exact").collect()


def test_ranks_in_groups_equal_a_window(spark):
    from pyspark.sql import Window

    from weftlink.functions.text import sha_rank

    df = spark.range(20000).selectExpr("cast(id as string) id", "nullif(id % 3, 2) s", "id % 2 t")
    got = splits.ranked_in(df, ["s", "t"], sha_rank(1, F.col("id")), "id")
    own = Window.partitionBy("s", "t")
    both = got.withColumns({"r": F.row_number().over(own.orderBy(sha_rank(1, F.col("id")), "id")), "n": F.count("*").over(own)})
    assert both.where("r <> rank or n <> size").count() == 0 and both.count() == 20000 and both.columns[:5] == ["id", "s", "t", "size", "rank"]


def test_unseen_grams_count_in_the_norm(spark):
    from weftlink.operators import retrieval

    _, queries, targets = _pair_tables(spark)
    queries = queries.withColumn("name", F.lit("a b zzzz"))
    with_, without = (retrieval.top_k(queries, targets, retrieval.RetrievalConfig(unseen=u)).first().char_name_score for u in (True, False))
    assert 0 < with_ < without <= 1


@pytest.mark.parametrize("made", [functools.partial(tx.grams, low=2, high=4), functools.partial(tx.word_grams, low=2, high=5), functools.partial(tx.word_grams, low=4, high=5), tx.word_pairs])
def test_pieces_in_python_are_those_of_the_columns(spark, made, monkeypatch):
    """Each text has as many distinct pieces, as often, and shares as many with each other text; in slices too."""
    from weftlink.functions import pieces

    texts = ["ab abc  ab a", "", "a", "abab ab", "été \U0001f600 ab abc", " lead ab", "aaaa aaaa", "ab abc  ab a"]
    want = [collections.Counter(r.g) for r in spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string").coalesce(1).select(made(F.col("t")).alias("g")).collect()]
    column, bag, _ = pieces.of_column(made)
    assert bag is not pieces.listed
    for batch in (pieces.BATCH, 3):
        monkeypatch.setattr(pieces, "BATCH", batch)
        codes, row, at, count = bag(pa.array(texts), np.arange(len(texts), dtype=np.int32))
        got = [dict(zip(codes[at[row == i]].tolist(), count[row == i].tolist(), strict=True)) for i in range(len(texts))]
        assert (np.diff(codes) > 0).all() and (np.diff(row) >= 0).all()
        for a, x in zip(want, got, strict=True):
            assert sorted(a.values()) == sorted(x.values())
            assert [len(a.keys() & b.keys()) for b in want] == [len(x.keys() & y.keys()) for y in got]


def test_texts_travel_packed():
    """One packed table for each block, much smaller than its texts, and nothing of them lost."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(200)) for _ in range(40)]
    t = pa.table({"candidate_source": ["source2"] * 40, "block": pa.array([i % 2 for i in range(40)], pa.int64()), "across": pa.array([3] * 40, pa.int64()), "n": pa.array([40] * 40, pa.int64()), "kind": pa.array([1] * 40, pa.int32()), "field": pa.array([-1] * 40, pa.int32()), "id": [f"S2-{i}" for i in range(40)], "same": pa.array(range(40), pa.int64()), "c0": texts})
    rows = pa.Table.from_batches(list(retrieval._pack(["candidate_source"])(iter(t.to_batches(max_chunksize=7)))))
    assert rows.column("block").to_pylist() == [0, 1] and sum(map(len, rows.column("packed").to_pylist())) < sum(map(len, texts)) / 3
    back = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in rows.column("packed").to_pylist()])
    assert sorted(zip(*back.to_pydict().values(), strict=True)) == sorted(zip(*t.select(["id", "same", "c0"]).to_pydict().values(), strict=True))


def test_ratio_of_texts_with_shared_ends():
    """As by the table of all cells, and texts that differ in the middle alone take no steps for their ends."""
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: row[j - 1] + 1 if b[j - 1] == x else max(row[j], left), initial=0)][1:]
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab é\U0001f600") for _ in range(rng.randint(0, n)))
    for _ in range(300):
        ends, a, b = (text(6), text(6)), text(20), text(20)
        assert sim.indel_ratio(ends[0] + a + ends[1], ends[0] + b + ends[1]) == plain(ends[0] + a + ends[1], ends[0] + b + ends[1])
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    began = time.process_time()
    assert sim.indel_ratio(long + "xy" + long, long + "yz" + long) == 2 * (400_000 + 1) / 800_004
    assert time.process_time() - began < 2
