"""Candidates by rules whose pairs of equal records are counted or made in blocks, against the plain form of the same."""

import pytest
from pyspark.sql import functions as F

from weftlink.operators import blocking, evaluate, features, rulepairs
from weftlink.plans.fixtures import score_of

CONFIG = blocking.BlockingConfig(top_k=3, max_df=8)


@pytest.fixture(scope="module")
def tables(spark):
    """Large groups of equal names, of equal addresses and of both; rare words; a null country and empty texts."""
    def rows(prefix, n):
        for i in range(n):
            name = "common name" if i % 3 else f"name{i % 5} rare{i % 7}"
            address = ["", "same street 12", f"street {i % 4} word{i % 11}", f"place {i}"][i % 4]
            yield f"{prefix}{i}", None if i % 17 == 5 else "xy"[i % 13 == 1], name, address

    q = spark.createDataFrame(list(rows("S1-", 40)), "source1_entity_id string, country string, name string, address string")
    made = [(i, f"source{k}", c, n, a) for k in (2, 3) for i, c, n, a in rows(f"S{k}-", 30)]
    t = spark.createDataFrame(made, "candidate_entity_id string, candidate_source string, country string, name string, address string")
    true = [(f"S1-{i}", f"S{2 + i % 2}-{(i * j) % 30}") for i in range(40) for j in (1, 3)] + [("S1-1", "S3-unknown"), ("S1-unknown", "S2-1")]
    return q, t, spark.createDataFrame(true, "source1_entity_id string, candidate_entity_id string").distinct()


def _plain(q, t):
    found = blocking.merge_evidence(blocking.exact_candidates(q, t), blocking.rule_keys(q, t, CONFIG))
    scored = found.withColumn("score", score_of(features.block_strength()))
    return found, scored.select(*blocking.PAIR, "score")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.85, {"source2": 0.82, "source3": 0.05}])
def test_errors_are_counted_without_listing_equal_records(tables, monkeypatch, threshold):
    q, t, truth = tables
    found, scores = _plain(q, t)
    want = _rows(evaluate.error_counts(evaluate.pair_errors(scores, found, truth, threshold), q))
    pairs = rulepairs.rule_pairs(q, t, CONFIG)
    monkeypatch.setattr(rulepairs.RulePairs, "equal", None)
    got = rulepairs.error_counts(pairs, truth, score_of(features.block_strength()), threshold)
    assert _rows(got.select("error_type", "candidate_source", "country", "error_count")) == want and len(want) > 6


def test_registered_counts_list_no_pairs(spark, sf_dir, monkeypatch):
    from weftlink.plans import registry

    monkeypatch.setattr(blocking, "exact_candidates", None)
    monkeypatch.setattr(rulepairs.RulePairs, "equal", None)
    assert registry.QUERIES["error_counts"](spark, sf_dir).count() > 2


def test_repeated_ids_take_the_plain_form(tables):
    q, t, _ = tables
    assert rulepairs.rule_pairs(q.union(q.limit(1)), t, CONFIG) is None and rulepairs.rule_pairs(q, t.union(t.limit(1)), CONFIG) is None


@pytest.mark.parametrize("threshold", [0.5, 0.85, {"source2": 0.82, "source3": 0.05}])
@pytest.mark.parametrize("side", [3, 1024])
def test_errors_meet_in_blocks(tables, monkeypatch, threshold, side):
    q, t, truth = tables
    found, scores = _plain(q, t)
    monkeypatch.setattr(rulepairs, "SIDE", side)
    want = _rows(evaluate.pair_errors(scores, found, truth, threshold).select(*blocking.PAIR, "error_type", "score"))
    got = _rows(rulepairs.pair_errors(rulepairs.rule_pairs(q, t, CONFIG), truth, score_of(features.block_strength()), threshold))
    assert got == want and len(want) > 90


def test_pairs_of_equal_records_do_not_travel(spark, sf_dir, monkeypatch):
    """No list of candidates is made or grouped; above the joins in which equal records meet nothing is dealt out again."""
    from weftlink.plans import fixtures, registry

    monkeypatch.setattr(blocking, "merge_evidence", None)
    monkeypatch.setattr(fixtures, "rule_candidates", None)
    plan = registry.QUERIES["pair_errors"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("SortMergeJoin")[0]
    assert plan.count("SortMergeJoin") >= 2 and not any(word in before for word in ("Exchange", "Aggregate", "Window"))


def test_number_features_of_equal_records_are_made_where_they_meet(spark, monkeypatch):
    """Only fuzzy candidates are attached; digit runs of equal names give what they give when attached."""
    from weftlink.plans import fixtures, registry

    rows = [("abcdefgh " * 6)[:48] + f" {['', 'at 7 or 12', f'at {i} 12 12', 'no. 12 of 7'][i % 4]} w{i % 9}" for i in range(60)]
    docs = spark.createDataFrame([(i, text, "en" if i % 5 else None) for i, text in enumerate(rows)], "doc_id long, text string, lang string")
    src = (1 + F.col("doc_id") % 3).cast("int")
    x = fixtures.Fixture(docs.select(F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), src.alias("src"), F.left("text", F.lit(48)).alias("business_name"), F.expr("substr(text, 49)").alias("business_address"), F.col("lang").alias("country")))
    want = _rows(registry._features(x, features.number_features(), brief=registry.tx.digit_runs))
    monkeypatch.setattr(blocking, "merge_evidence", None)
    monkeypatch.setattr(fixtures, "rule_candidates", None)
    monkeypatch.setattr(rulepairs, "SIDE", 4)
    assert _rows(registry.pair_features_numbers(x)) == want and len(want) > 300
