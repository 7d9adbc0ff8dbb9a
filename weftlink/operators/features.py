"""Pair features: block evidence, ranks, and similarities of names, addresses and numbers."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import similarity as sim
from weftlink.functions import text as tx
from weftlink.sources.tables import with_evidence

# The features in the order that models expect.
FEATURES = (
    "block_exact_name",
    "block_exact_address",
    "retrieval_score",
    "log_fuzzy_score",
    "shared_blocking_keys",
    "candidate_rank_source_log",
    "candidate_rank_reciprocal",
    "candidate_count_log",
    "source_candidate_count_log",
    "retrieval_gap_from_best",
    "retrieval_ratio_to_best",
    "blocker_agreement",
    "block_exact_both",
    "name_jaro_winkler",
    "name_token_jaccard",
    "name_token_containment",
    "name_shared_token_count_log",
    "name_edit_similarity",
    "name_exact",
    "name_sorted_exact",
    "name_first_token_exact",
    "name_last_token_exact",
    "address_jaro_winkler",
    "address_token_jaccard",
    "address_token_containment",
    "address_shared_token_count_log",
    "address_edit_similarity",
    "address_exact",
    "address_digit_jaccard",
    "address_number_overlap_count_log",
    "address_number_subset",
    "same_first_address_number",
    "conflicting_first_address_number",
    "country_exact",
    "name_missing_either",
    "address_missing_either",
    "candidate_is_source3",
    "query_name_frequency_log",
    "candidate_name_frequency_log",
    "candidate_address_frequency_log",
    "name_length_ratio",
    "address_length_ratio",
)


def block_strength() -> Column:
    """A label-free score of the evidence, rounded so that engines agree on its order."""
    fuzzy = F.log(1.0 + F.greatest(F.col("fuzzy_score"), F.lit(0.0)))
    return F.round(4.0 * F.col("exact_name") + 4.0 * F.col("exact_address") + 2.0 * F.col("char_name_score") + 0.10 * fuzzy + 0.01 * F.col("shared_blocking_keys"), 9)


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with evidence, block_strength, rank in their source, counts, and the query's best retrieval score."""
    query, source = Window.partitionBy("source1_entity_id"), Window.partitionBy("source1_entity_id", "candidate_source")
    strong = with_evidence(candidates).withColumn("block_strength", block_strength())
    return strong.withColumns({
        "candidate_rank_source": F.row_number().over(source.orderBy(F.desc("block_strength"), "candidate_entity_id")),
        "candidate_count": F.count("*").over(query),
        "source_candidate_count": F.count("*").over(source),
        "best_retrieval": F.max("char_name_score").over(query),
    })


def evidence_features(r: DataFrame) -> dict[str, Column]:
    ln = lambda c: F.log(1.0 + F.col(c))
    flag = lambda c: c.cast("int").cast("double")
    best, score = F.col("best_retrieval"), F.col("char_name_score")
    return {
        "block_exact_name": F.col("exact_name").cast("double"),
        "block_exact_address": F.col("exact_address").cast("double"),
        "retrieval_score": score,
        "log_fuzzy_score": F.log(1.0 + F.greatest(F.col("fuzzy_score"), F.lit(0.0))),
        "shared_blocking_keys": F.col("shared_blocking_keys").cast("double"),
        "candidate_rank_source_log": ln("candidate_rank_source"),
        "candidate_rank_reciprocal": 1.0 / F.col("candidate_rank_source"),
        "candidate_count_log": ln("candidate_count"),
        "source_candidate_count_log": ln("source_candidate_count"),
        "retrieval_gap_from_best": best - score,
        "retrieval_ratio_to_best": F.when(best <= 0, F.lit(0.0)).otherwise(score / F.greatest(best, F.lit(1e-12))),
        "blocker_agreement": flag(((F.col("exact_name") + F.col("exact_address") > 0) | (F.col("shared_blocking_keys") > 0)) & (score > 0)),
        "block_exact_both": flag((F.col("exact_name") > 0) & (F.col("exact_address") > 0)),
    }


def text_features(field: str) -> dict[str, Column]:
    """Similarities of q_<field> and t_<field>, each with its own guard for empty texts."""
    q, t = F.col(f"q_{field}"), F.col(f"t_{field}")
    qs, ts = tx.token_set(q), tx.token_set(t)
    flag = lambda c: c.cast("int").cast("double")
    return {
        f"{field}_jaro_winkler": F.when((q == "") | (t == ""), F.lit(0.0)).otherwise(sim.jaro_winkler(q, t)),
        f"{field}_token_jaccard": sim.jaccard(qs, ts),
        f"{field}_token_containment": sim.containment(qs, ts),
        f"{field}_shared_token_count_log": F.log(1.0 + sim.overlap(qs, ts)),
        f"{field}_edit_similarity": sim.edit_similarity(q, t),
        f"{field}_exact": flag((q != "") & (tx.compact(q) == tx.compact(t))),
        f"{field}_missing_either": flag((q == "") | (t == "")),
        f"{field}_length_ratio": sim.length_ratio(q, t),
    }


def name_token_features() -> dict[str, Column]:
    q, t = tx.tokens(F.col("q_name")), tx.tokens(F.col("t_name"))
    both = (F.size(q) > 0) & (F.size(t) > 0)
    end = lambda k: F.coalesce(both & (F.get(q, F.lit(0) if k > 0 else F.size(q) - 1) == F.get(t, F.lit(0) if k > 0 else F.size(t) - 1)), F.lit(False)).cast("int").cast("double")
    same = both & (F.array_sort(F.array_distinct(q)) == F.array_sort(F.array_distinct(t)))
    return {"name_sorted_exact": same.cast("int").cast("double"), "name_first_token_exact": end(1), "name_last_token_exact": end(-1)}


def number_features() -> dict[str, Column]:
    qa, ta = tx.digit_runs(F.col("q_address")), tx.digit_runs(F.col("t_address"))
    q, t = F.array_distinct(qa), F.array_distinct(ta)
    both = (F.size(q) > 0) & (F.size(t) > 0)
    first = F.get(qa, F.lit(0)) == F.get(ta, F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    return {
        "address_digit_jaccard": sim.jaccard(q, t),
        "address_number_overlap_count_log": F.log(1.0 + sim.overlap(q, t)),
        "address_number_subset": flag(both & (sim.overlap(q, t) == F.least(F.size(q), F.size(t)))),
        "same_first_address_number": flag(both & first),
        "conflicting_first_address_number": flag(both & ~first),
    }


def number_pieces(side: str) -> dict[str, Column]:
    """What is kept of a record for number_features: the address's distinct digit runs in order."""
    return {f"{side}_pieces": F.array_distinct(tx.digit_runs(F.col("address")))}


def number_sides(side: str) -> dict[str, Column]:
    """What met_numbers sees of it."""
    return {f"{side}_runs": F.col(f"{side}_pieces"), f"{side}_first": F.get(f"{side}_pieces", F.lit(0))}


def met_numbers(pairs: DataFrame) -> DataFrame:
    """number_features of pairs, from both records' pieces: one intersection a pair."""
    q, t, n = F.size("q_runs"), F.size("t_runs"), F.col("shared_runs")
    both, first = (q > 0) & (t > 0), F.coalesce(F.col("q_first") == F.col("t_first"), F.lit(False))
    flag = lambda c: c.cast("int").cast("double")
    return pairs.withColumn("shared_runs", F.when(both, sim.overlap(F.col("q_runs"), F.col("t_runs"))).otherwise(F.lit(0))).withColumns({
        "address_digit_jaccard": F.when(q + t == 0, F.lit(0.0)).otherwise(n / F.greatest(q + t - n, F.lit(1))), "address_number_overlap_count_log": F.log(1.0 + n),
        "address_number_subset": flag(both & (n == F.least(q, t))), "same_first_address_number": flag(both & first), "conflicting_first_address_number": flag(both & ~first),
    })


def _once(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each key, with how many rows had it."""
    return records.groupBy(key).agg(F.count("*").alias(f"{key}_rows"), *[F.first(c).alias(c) for c in columns])


def attach(candidates: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with both records' texts and how often equal ones occur in their pools: one row for each candidate. An
    id that no record or several records have is an error when the rows are computed, as is a candidate of another
    source than its record's."""
    count = lambda df, keys, name: df.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in keys]).agg(F.count("*").alias(name))
    same = lambda keys, name: functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in keys])

    def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.join(count(df, keys, name), same(keys, name)).drop(*[f"{name}_{k}" for k in keys])

    q = counted(_once(queries, "source1_entity_id", "country", "name", "address"), ["country", "name"], "q_name_frequency")
    t = _once(targets, "candidate_entity_id", "candidate_source", "country", "name", "address")
    t = counted(counted(t, ["candidate_source", "country", "name"], "t_name_frequency"), ["candidate_source", "country", "address"], "t_address_frequency")
    left = q.select("source1_entity_id", "source1_entity_id_rows", F.col("name").alias("q_name"), F.col("address").alias("q_address"), F.col("country").alias("q_country"), "q_name_frequency")
    right = t.select("candidate_entity_id", "candidate_entity_id_rows", F.col("candidate_source").alias("t_source"), F.col("name").alias("t_name"), F.col("address").alias("t_address"), F.col("country").alias("t_country"), "t_name_frequency", "t_address_frequency")
    out = candidates.join(left, "source1_entity_id", "left").join(right, "candidate_entity_id", "left")
    wrong = lambda c, what: F.when(c, F.raise_error(F.concat(F.lit(f"{what}: "), "source1_entity_id", F.lit(" "), "candidate_entity_id")).cast("boolean"))
    for side in ("source1_entity_id", "candidate_entity_id"):
        out = out.where(wrong(F.col(f"{side}_rows").isNull(), f"no record for {side}").when(F.col(f"{side}_rows") > 1, F.raise_error(F.concat(F.lit(f"repeated {side}: "), side, F.lit(" of "), "source1_entity_id")).cast("boolean")).otherwise(F.lit(True)))
    return out.where(wrong(F.col("candidate_source") != F.col("t_source"), "another source").otherwise(F.lit(True))).drop("source1_entity_id_rows", "candidate_entity_id_rows", "t_source")


def frequency_features() -> dict[str, Column]:
    ln = lambda c: F.log(1.0 + F.col(c))
    q, t = F.lower(F.trim(F.coalesce("q_country", F.lit("")))), F.lower(F.trim(F.coalesce("t_country", F.lit(""))))
    return {
        "country_exact": ((q != "") & (q == t)).cast("int").cast("double"),
        "candidate_is_source3": F.col("candidate_entity_id").startswith("S3-").cast("int").cast("double"),
        "query_name_frequency_log": ln("q_name_frequency"),
        "candidate_name_frequency_log": ln("t_name_frequency"),
        "candidate_address_frequency_log": ln("t_address_frequency"),
    }


def pair_features(candidates: DataFrame, queries: DataFrame, targets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pair and its 42 features, with further columns of candidates that `keep` names."""
    r = candidates if "candidate_rank_source" in candidates.columns else ranked(candidates)
    made = evidence_features(r) | text_features("name") | name_token_features() | text_features("address") | number_features() | frequency_features()
    return attach(r, queries, targets).select("source1_entity_id", "candidate_entity_id", "candidate_source", *keep, *[made[f].alias(f) for f in FEATURES])


# The smaller set of features, in order, on texts of the other normalizer; two empty sets or texts count as alike.
SMALL = (
    "retrieval_score",
    "name_exact",
    "name_compact_exact",
    "name_ratio",
    "name_token_set_ratio",
    "name_token_jaccard",
    "name_length_ratio",
    "address_exact",
    "address_ratio",
    "address_token_set_ratio",
    "address_token_jaccard",
    "address_digit_jaccard",
    "country_exact",
    "country_missing_either",
    "candidate_is_source3",
)


def small_features(pairs: DataFrame) -> DataFrame:
    """pairs: ids, char_name_score, q_/t_ name, address and country as given. Texts are normalized here."""
    texts = {f"{s}_{f}": tx.normalize_unicode(F.coalesce(F.col(f"{s}_{f}"), F.lit(""))) for s in "qt" for f in ("name", "address", "country")}
    p = pairs.withColumns(texts)
    flag = lambda c: c.cast("int").cast("double")
    n, m, a, b, c, d = (F.col(x) for x in ("q_name", "t_name", "q_address", "t_address", "q_country", "t_country"))
    made = {
        "retrieval_score": F.col("char_name_score"),
        "name_exact": flag((n != "") & (n == m)), "name_compact_exact": flag((n != "") & (tx.compact(n) == tx.compact(m))),
        "name_ratio": sim.ratio(n, m), "name_token_set_ratio": sim.token_set_ratio(n, m),
        "name_token_jaccard": sim.jaccard(tx.token_set(n), tx.token_set(m), 1.0), "name_length_ratio": sim.length_ratio(n, m, 1.0),
        "address_exact": flag((a != "") & (a == b)), "address_ratio": sim.ratio(a, b), "address_token_set_ratio": sim.token_set_ratio(a, b),
        "address_token_jaccard": sim.jaccard(tx.token_set(a), tx.token_set(b), 1.0), "address_digit_jaccard": sim.jaccard(tx.unicode_digit_set(a), tx.unicode_digit_set(b), 1.0),
        "country_exact": flag((c != "") & (c == d)), "country_missing_either": flag((c == "") | (d == "")), "candidate_is_source3": flag(F.col("candidate_entity_id").startswith("S3-")),
    }
    return p.select("source1_entity_id", "candidate_entity_id", *[made[f].alias(f) for f in SMALL])
