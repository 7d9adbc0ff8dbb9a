"""The registered record-linkage queries and their SQL. Whole numbers are BIGINT and rounded fractions DOUBLE in both."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions import text as tx
from weftlink.functions.text import normalize_sql
from weftlink.operators import audit, blocking, evaluate, features, learning, retrieval, rulepairs, sampling, splits, submission
from weftlink.plans.fixtures import CONFIG, SOURCE_THRESHOLDS, THRESHOLD, Fixture, fixture, score_of
from weftlink.plans.sql import PAIR, STEPS, fbeta, md5_low, norm, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _typed(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions as double rounded to eight places."""
    def one(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 8)
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def _sql_typed(select: str, longs: str = "", doubles: str = "") -> str:
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"round(CAST({c} AS DOUBLE) + 1e-12, 8) AS {c}" for c in doubles.split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({select})" if casts else select


def query(oracle: str | None = None):
    def register(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: _typed(f(fixture(spark, sf_dir)))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


@query(sql("exact", _sql_typed("SELECT * FROM exact", "exact_name exact_address")))
def exact_candidates(x: Fixture) -> DataFrame:
    return blocking.exact_candidates(x.queries(), x.targets())


@query(sql("tkeys", _sql_typed("SELECT * FROM tkeys", "", "key_weight")))
def blocking_keys(x: Fixture) -> DataFrame:
    return blocking.blocking_keys(x.targets(), ["candidate_entity_id", "candidate_source"])


@query(sql("freq", _sql_typed("SELECT * FROM freq", "document_frequency")))
def key_document_frequency(x: Fixture) -> DataFrame:
    return blocking.key_frequency(blocking_keys(x))


@query(sql("sel", _sql_typed("SELECT * FROM sel", "document_frequency", "key_weight idf")))
def selected_query_keys(x: Fixture) -> DataFrame:
    return blocking.selected_keys(blocking.blocking_keys(x.queries(), ["source1_entity_id"]), key_document_frequency(x), blocking.pool_sizes(x.targets()), CONFIG)


@query(sql("fuzzy", _sql_typed("SELECT * FROM fuzzy", "shared_blocking_keys", "fuzzy_score")))
def fuzzy_candidates(x: Fixture) -> DataFrame:
    return blocking.fuzzy_candidates(selected_query_keys(x), blocking_keys(x), CONFIG)


@query(sql("final", _sql_typed("SELECT * FROM final", "exact_name exact_address shared_blocking_keys", "fuzzy_score")))
def final_candidates(x: Fixture) -> DataFrame:
    return x.rules()


_REPORT = """SELECT * FROM (SELECT count(*) AS query_count, CAST(sum(n) AS BIGINT) AS candidate_pairs, count_if(n = 0)::BIGINT AS zero_candidate_queries, max(n) AS most_candidates,
    quantile_disc(n, 0.5) AS candidates_p50, quantile_disc(n, 0.9) AS candidates_p90, quantile_disc(n, 0.99) AS candidates_p99
    FROM (SELECT coalesce(c, 0) AS n FROM q LEFT JOIN (SELECT source1_entity_id, count(*) AS c FROM final GROUP BY ALL) USING (source1_entity_id)))
  CROSS JOIN (SELECT CAST(sum(a) AS BIGINT) AS positive_pairs, CAST(sum(h) AS BIGINT) AS retrieved_pairs, round(sum(h)::DOUBLE / sum(a), 8) AS pair_recall, round(count_if(h = a)::DOUBLE / count(*), 8) AS complete_entity_recall
    FROM (SELECT p.source1_entity_id, count(*) AS a, count(f.candidate_entity_id) AS h FROM pairs p LEFT JOIN final f USING (source1_entity_id, candidate_entity_id) GROUP BY ALL))
  CROSS JOIN (SELECT count(*) AS target_count FROM t)"""


@query(sql("q t final pairs", f"SELECT *, round(1.0::DOUBLE - candidate_pairs::DOUBLE / (query_count * target_count), 8) AS reduction_ratio FROM ({_REPORT})"))
def candidate_report(x: Fixture) -> DataFrame:
    return blocking.report(x.queries(), x.targets(), x.candidates(), x.pairs())


@query(sql("q t final", "SELECT (SELECT count(*) FROM q) AS query_count, (SELECT count(*) FROM t) AS target_count, (SELECT count(*) FROM final) AS candidate_pairs, round(1.0::DOUBLE - (SELECT count(*) FROM final)::DOUBLE / ((SELECT count(*) FROM q) * (SELECT count(*) FROM t)), 8) AS reduction_ratio"))
def reduction_ratio(x: Fixture) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    all_ = count(x.queries(), "query_count").crossJoin(count(x.targets(), "target_count")).crossJoin(count(x.candidates(), "candidate_pairs"))
    return all_.withColumn("reduction_ratio", 1.0 - F.expr("try_divide(double(candidate_pairs), query_count * target_count)"))


@query(sql("pairs final", "SELECT CASE WHEN starts_with(candidate_entity_id, 'S3-') THEN 'source3' ELSE 'source2' END AS candidate_source, count(*) AS positive_pairs, count(f.source1_entity_id) AS retrieved_pairs, round(count(f.source1_entity_id)::DOUBLE / count(*), 8) AS pair_recall FROM pairs LEFT JOIN (SELECT source1_entity_id, candidate_entity_id FROM final) f USING (source1_entity_id, candidate_entity_id) GROUP BY ALL".replace("count(f.source1_entity_id)", "count(hit)").replace("(SELECT source1_entity_id, candidate_entity_id FROM final) f", "(SELECT source1_entity_id, candidate_entity_id, 1 AS hit FROM final) f")))
def source_recall(x: Fixture) -> DataFrame:
    return blocking.recall_by_source(x.pairs(), x.candidates())


def _gram_sql(grams_q: str, grams_t: str, floor: float) -> str:
    """TF-IDF cosine with frequencies of each (source, country) of the targets. s has nine places; what is added before it
    is rounded to eight makes halves go up, as they do in Spark."""
    return sql("q t", f"""SELECT source1_entity_id, candidate_entity_id, candidate_source, round(s + 1e-12, 8) AS char_name_score FROM (
      SELECT wq.source1_entity_id, wt.candidate_entity_id, wt.candidate_source, round(greatest(0.0, least(1.0, sum(wq.w * wt.w))), 9) AS s FROM
        (SELECT source1_entity_id, candidate_source, country, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY source1_entity_id, candidate_source)) AS w FROM (
            SELECT g.source1_entity_id, s.candidate_source, g.country, g.gram, (1 + ln(count(*))) * (ln((1.0::DOUBLE + any_value(s.n)) / (1.0::DOUBLE + coalesce(any_value(df), 0))) + 1) AS raw
            FROM (SELECT source1_entity_id, country, {grams_q} AS gram FROM q) g JOIN sizes s ON s.country = g.country LEFT JOIN dfs d ON d.candidate_source = s.candidate_source AND d.country = g.country AND d.gram = g.gram GROUP BY ALL)) wq
        JOIN (SELECT candidate_entity_id, candidate_source, country, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY candidate_entity_id, candidate_source)) AS w FROM (
            SELECT g.candidate_entity_id, candidate_source, country, gram, (1 + ln(count(*))) * (ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + any_value(df))) + 1) AS raw
            FROM (SELECT candidate_entity_id, candidate_source, country, {grams_t} AS gram FROM t) g JOIN dfs d USING (candidate_source, country, gram) GROUP BY ALL)) wt
        USING (candidate_source, country, gram) GROUP BY ALL)
      WHERE s >= {floor} QUALIFY row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY s DESC, candidate_entity_id) <= 20""").replace(
        "\nSELECT source1_entity_id, candidate_entity_id, candidate_source, round(s + 1e-12, 8)",
        f""", sizes AS (SELECT candidate_source, country, count(*) AS n FROM t GROUP BY ALL), dfs AS (SELECT candidate_source, country, gram, count(DISTINCT candidate_entity_id) AS df, any_value(n) AS n FROM (SELECT candidate_entity_id, candidate_source, country, {grams_t} AS gram FROM t)
        JOIN sizes USING (candidate_source, country) GROUP BY ALL)
        SELECT source1_entity_id, candidate_entity_id, candidate_source, round(s + 1e-12, 8)""", 1,
    )


_CHAR = "unnest(flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(length(name) - n + 2, 1)), lambda i: substr(name, i, n)))))"
_PAIRS = "unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])))"
_WORDS = "list_filter(string_split(address, ' '), lambda w: w <> '')"


@query(_gram_sql(_CHAR, _CHAR, 0.10))
def ngram_topk(x: Fixture) -> DataFrame:
    """Names by all character 2- to 5-grams."""
    return retrieval.top_k(x.queries(), x.targets(), retrieval.RetrievalConfig(top_k=20))


@query(_gram_sql(_PAIRS.replace("ws", _WORDS), _PAIRS.replace("ws", _WORDS), 0.30))
def word_bigram_topk(x: Fixture) -> DataFrame:
    """Addresses by words and word pairs."""
    by_address = lambda df: df.withColumn("name", F.col("address"))
    return retrieval.top_k(by_address(x.queries()), by_address(x.targets()), retrieval.RetrievalConfig(top_k=20, min_similarity=0.30), grams=tx.word_pairs)


@query()
def fused_topk(x: Fixture) -> DataFrame:
    """Names and addresses fused, the address at 0.35, with and without accents."""
    return retrieval.top_k(x.queries(tx.with_bare_accents), x.targets(tx.with_bare_accents), retrieval.RetrievalConfig(address_weight=0.35))


@query()
def text_topk(x: Fixture) -> DataFrame:
    """Whole records by grams inside words, countries mixed."""
    text = lambda df: df.withColumn("name", tx.field_text(F.col("name"), F.col("address")))
    config = retrieval.RetrievalConfig(top_k=50, unseen=False)
    return retrieval.top_k(text(x.queries(tx.normalize_unicode)), text(x.targets(tx.normalize_unicode)), config, by_country=False, grams=functools.partial(tx.word_grams, low=config.low, high=config.high))


_UNION = f"SELECT {PAIR}, max(a) AS exact_name, max(b) AS exact_address, max(c) AS fuzzy_score, max(d) AS shared_blocking_keys, 0.0::DOUBLE AS char_name_score FROM (SELECT {PAIR}, exact_name AS a, exact_address AS b, 0.0::DOUBLE AS c, 0 AS d FROM exact UNION ALL SELECT {PAIR}, 0, 0, fuzzy_score, shared_blocking_keys FROM fuzzy) GROUP BY ALL"


@query(sql("exact fuzzy", _sql_typed(_UNION, "exact_name exact_address shared_blocking_keys", "fuzzy_score")))
def candidate_union(x: Fixture) -> DataFrame:
    """Artifacts with different columns merged, the strongest evidence kept."""
    return blocking.merge_evidence(exact_candidates(x), fuzzy_candidates(x))


@query(sql("final", _sql_typed(f"SELECT {PAIR}, exact_name, exact_address, fuzzy_score, shared_blocking_keys, 0.0::DOUBLE AS char_name_score FROM final QUALIFY row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY exact_name DESC, exact_address DESC, fuzzy_score DESC, shared_blocking_keys DESC, candidate_entity_id) <= 5", "exact_name exact_address shared_blocking_keys", "fuzzy_score")))
def mining_pool(x: Fixture) -> DataFrame:
    return sampling.mining_pool(x.candidates(), 5)


@query(sql("sample_ranked", _sql_typed("""SELECT source1_entity_id, candidate_entity_id, candidate_source, label, CASE WHEN label = 1 THEN 1.0 ELSE negatives::DOUBLE / greatest(count_if(label = 0) OVER (PARTITION BY source1_entity_id, candidate_source), 1) END AS sample_weight,
    md5_number_lower(source1_entity_id || ':20260925:fold') % 3 AS cv_fold, md5_number_lower(source1_entity_id || ':20260925:calibration') % 10 AS calibration_bucket
    FROM sample_ranked WHERE label = 1 OR by_strength <= 5 OR by_chance <= 1""", "label cv_fold calibration_bucket", "sample_weight")))
def training_sample(x: Fixture) -> DataFrame:
    return sampling.training_sample(x.candidates(), x.pairs()).select("source1_entity_id", "candidate_entity_id", "candidate_source", "label", "sample_weight", "cv_fold", "calibration_bucket")


_IDS = ["source1_entity_id", "candidate_entity_id", "candidate_source"]


def _features(x: Fixture, made: dict, *names: str, brief: Callable | None = None) -> DataFrame:
    """brief: all of an address that these features see; the rest needn't travel with each pair."""
    short = lambda df: df.withColumn("address", F.array_join(brief(F.col("address")), " ")) if brief else df
    return features.attach(features.ranked(x.candidates()), short(x.queries()), short(x.targets())).select(*_IDS, *[made[n].alias(n) for n in names or made])


def _features_where_met(x: Fixture, made: dict, pieces: Callable, sides: Callable, met: Callable[[DataFrame], DataFrame], brief: Callable) -> DataFrame:
    """As _features, of the address alone: pairs of equal records get theirs where blocks of a group meet, from what `sides`
    takes of both records' stored pieces; the others, a bounded number for each query, by `attach`."""
    found, wanted = x.unlisted(pieces=pieces), tuple(made)
    if found is None:
        return _features(x, made, brief=brief)
    short = lambda df, side, *ids: df.select(*ids, "country", F.lit("").alias("name"), F.array_join(f"{side}_pieces", " ").alias("address"))
    few = features.attach(found.fuzzy.select(*_IDS), short(found.queries, "q", "source1_entity_id"), short(found.targets, "t", "candidate_entity_id", "candidate_source"))
    seen = lambda df, side, key: df.select(key, "country", f"{side}_name_digest", f"{side}_address_digest", *[c.alias(n) for n, c in sides(side).items()])
    equal = found.equal(found.equal_fuzzy(), met, wanted, (seen(found.queries, "q", "source1_entity_id"), seen(found.targets, "t", "candidate_entity_id")))
    return few.select(*_IDS, *[made[n].alias(n) for n in wanted]).unionByName(equal.select(*_IDS, *wanted))


def _feature_sql(exprs: dict[str, str], other: dict[str, tuple[str, str]] | None = None) -> str:
    return sql("attached", f"SELECT {PAIR}, " + ", ".join(f"round(CAST({e} AS DOUBLE), 8) AS {n}" for n, e in exprs.items()) + " FROM attached", other)


_BLOCK = {
    "block_exact_name": "exact_name", "block_exact_address": "exact_address", "retrieval_score": "char_name_score", "log_fuzzy_score": "ln(1.0::DOUBLE + greatest(fuzzy_score, 0))", "shared_blocking_keys": "shared_blocking_keys",
    "candidate_rank_source_log": "ln(1.0::DOUBLE + candidate_rank_source)", "candidate_rank_reciprocal": "1.0::DOUBLE / candidate_rank_source", "candidate_count_log": "ln(1.0::DOUBLE + candidate_count)",
    "source_candidate_count_log": "ln(1.0::DOUBLE + source_candidate_count)", "retrieval_gap_from_best": "best_retrieval - char_name_score", "retrieval_ratio_to_best": "CASE WHEN best_retrieval <= 0 THEN 0.0 ELSE char_name_score / greatest(best_retrieval, 1e-12) END",
    "blocker_agreement": "((exact_name + exact_address > 0 OR shared_blocking_keys > 0) AND char_name_score > 0)::INT", "block_exact_both": "(exact_name > 0 AND exact_address > 0)::INT",
}


@query(_feature_sql(_BLOCK))
def pair_features_block(x: Fixture) -> DataFrame:
    return _features(x, features.evidence_features(None))


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE {_inter(a, b)}::DOUBLE / greatest(len(list_distinct(list_concat({a}, {b}))), 1) END"


def _contain(a: str, b: str) -> str:
    least = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"CASE WHEN {least} = 0 THEN 0.0 ELSE {_inter(a, b)}::DOUBLE / greatest({least}, 1) END"


_BOTH = "len(qw) > 0 AND len(tw) > 0"


_TOKENS = {
    "name_token_jaccard": _jaccard("qw", "tw"), "name_token_containment": _contain("qw", "tw"), "name_shared_token_count_log": f"ln(1.0::DOUBLE + {_inter('qw', 'tw')})",
    "name_sorted_exact": f"({_BOTH} AND list_sort(list_distinct(qw)) = list_sort(list_distinct(tw)))::INT", "name_first_token_exact": f"coalesce({_BOTH} AND qw[1] = tw[1], false)::INT", "name_last_token_exact": f"coalesce({_BOTH} AND qw[-1] = tw[-1], false)::INT",
    "address_token_jaccard": _jaccard("qx", "tx"), "address_token_containment": _contain("qx", "tx"), "address_shared_token_count_log": f"ln(1.0::DOUBLE + {_inter('qx', 'tx')})",
}


@query(_feature_sql(_TOKENS))
def pair_features_tokens(x: Fixture) -> DataFrame:
    made = features.text_features("name") | features.name_token_features() | features.text_features("address")
    return _features(x, made, "name_token_jaccard", "name_token_containment", "name_shared_token_count_log", "name_sorted_exact", "name_first_token_exact", "name_last_token_exact", "address_token_jaccard", "address_token_containment", "address_shared_token_count_log", brief=tx.token_set)


def _edit(f: str) -> dict[str, str]:
    a, b = f"q_{f}", f"t_{f}"
    high, low = f"greatest(length({a}), length({b}))", f"least(length({a}), length({b}))"
    return {
        f"{f}_jaro_winkler": f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END",
        f"{f}_edit_similarity": f"CASE WHEN {high} = 0 THEN 0.0 ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest({high}, 1) END",
        f"{f}_exact": f"({a} <> '' AND replace({a}, ' ', '') = replace({b}, ' ', ''))::INT",
        f"{f}_missing_either": f"({a} = '' OR {b} = '')::INT",
        f"{f}_length_ratio": f"CASE WHEN {high} = 0 THEN 0.0 ELSE {low}::DOUBLE / greatest({high}, 1) END",
    }


@query(_feature_sql(_edit("name") | _edit("address")))
def pair_features_edit(x: Fixture) -> DataFrame:
    made = features.text_features("name") | features.text_features("address")
    return _features(x, made, *_edit("name"), *_edit("address"))


_ND = "len(qd) > 0 AND len(td) > 0"


_NUMBERS = {
    "address_digit_jaccard": _jaccard("qd", "td"), "address_number_overlap_count_log": f"ln(1.0::DOUBLE + {_inter('qd', 'td')})", "address_number_subset": f"({_ND} AND {_inter('qd', 'td')} = least(len(list_distinct(qd)), len(list_distinct(td))))::INT",
    "same_first_address_number": f"coalesce({_ND} AND qd[1] = td[1], false)::INT", "conflicting_first_address_number": f"coalesce({_ND} AND qd[1] <> td[1], false)::INT",
}


@query(_feature_sql(_NUMBERS))
def pair_features_numbers(x: Fixture) -> DataFrame:
    return _features_where_met(x, features.number_features(), features.number_pieces, features.number_sides, features.met_numbers, brief=tx.digit_runs)


_FREQUENCY = {
    "country_exact": "(lower(trim(q_country)) <> '' AND lower(trim(q_country)) = lower(trim(t_country)))::INT", "candidate_is_source3": "starts_with(candidate_entity_id, 'S3-')::INT",
    "query_name_frequency_log": "ln(1.0::DOUBLE + q_n)", "candidate_name_frequency_log": "ln(1.0::DOUBLE + t_n)", "candidate_address_frequency_log": "ln(1.0::DOUBLE + t_a)",
}


@query(_feature_sql(_FREQUENCY))
def pair_features_frequency(x: Fixture) -> DataFrame:
    return _features(x, features.frequency_features())


_ALL = _BLOCK | _TOKENS | _edit("name") | _edit("address") | _NUMBERS | _FREQUENCY
_ALL = {n: _ALL[n] for n in features.FEATURES}


@query(_feature_sql(_ALL))
def pair_features(x: Fixture) -> DataFrame:
    """All 42 features in the order that models expect."""
    return features.pair_features(x.candidates(), x.queries(), x.targets())


#: Retrieval's evidence beside the rules', and steps that read both in place of the rules' alone.
_GRAMS = _gram_sql(_CHAR, _CHAR, 0.10).replace("round(s + 1e-12, 8) AS char_name_score", "CAST(floor(s * 1e6 + 0.2505) / 1e6 AS DOUBLE) AS char_name_score")
_MERGED = f"SELECT {PAIR}, max(a) AS exact_name, max(b) AS exact_address, max(c) AS fuzzy_score, max(d) AS shared_blocking_keys, max(e) AS char_name_score FROM (SELECT {PAIR}, exact_name AS a, exact_address AS b, fuzzy_score AS c, shared_blocking_keys AS d, 0.0::DOUBLE AS e FROM final UNION ALL SELECT {PAIR}, 0, 0, 0.0, 0, char_name_score FROM found) GROUP BY ALL"
_BOTH_KINDS = {"found": ("", _GRAMS), "offered_by_rules": ("final found", _MERGED)}


@query(sql("offered_by_rules", _sql_typed("SELECT * FROM offered_by_rules", "exact_name exact_address shared_blocking_keys", "fuzzy_score char_name_score"), _BOTH_KINDS))
def merged_candidates(x: Fixture) -> DataFrame:
    """The production candidates: by rules and by retrieval."""
    return x.merged()


@query(_feature_sql(_ALL, _BOTH_KINDS))
def merged_pair_features(x: Fixture) -> DataFrame:
    """All 42 features of the production candidates; the four on retrieval have values."""
    return features.pair_features(x.merged(), x.queries(), x.targets())


_MINED = {"sample_ranked": ("ranked scores_of pairs", f"""SELECT *, row_number() OVER (g ORDER BY block_strength DESC, candidate_entity_id) AS by_strength,
        row_number() OVER (g ORDER BY {md5_low("candidate_entity_id || ':20260925:negative'")}, candidate_entity_id) AS by_chance,
        row_number() OVER (g ORDER BY model_score DESC, block_strength DESC, candidate_entity_id) AS by_model, count_if(label = 0) OVER (PARTITION BY source1_entity_id, candidate_source) AS negatives
        FROM (SELECT ranked.*, coalesce(model_score, 0.0) AS model_score, CASE WHEN pairs.candidate_entity_id IS NULL THEN 0 ELSE 1 END AS label FROM ranked LEFT JOIN scores_of USING (source1_entity_id, candidate_entity_id) LEFT JOIN pairs USING (source1_entity_id, candidate_entity_id))
        WINDOW g AS (PARTITION BY source1_entity_id, candidate_source, label)"""),
    "scores_of": ("ranked", "SELECT source1_entity_id, candidate_entity_id, md5_number_lower(candidate_entity_id || source1_entity_id) % 1000 / 1000.0::DOUBLE AS model_score FROM ranked WHERE candidate_rank_source <= 20")}


@query(sql("sample_ranked", _sql_typed("""SELECT source1_entity_id, candidate_entity_id, candidate_source, label, CASE WHEN label = 1 THEN 1.0 ELSE negatives::DOUBLE / greatest(count_if(label = 0) OVER (PARTITION BY source1_entity_id, candidate_source), 1) END AS sample_weight
    FROM sample_ranked WHERE label = 1 OR by_strength <= 3 OR by_model <= 4 OR by_chance <= 1""", "label", "sample_weight"), _MINED | _BOTH_KINDS))
def mined_sample(x: Fixture) -> DataFrame:
    """A second round's sample over the production candidates: negatives that an earlier model scores high. The scores
    here are a hash, for the strongest 20 of a query and source."""
    found = x.merged()
    score = tx.md5_bucket(F.concat("candidate_entity_id", "source1_entity_id"), 1000) / 1000.0
    mining = features.ranked(found).where("candidate_rank_source <= 20").select("source1_entity_id", "candidate_entity_id", score.alias("score"))
    out = sampling.training_sample(found, x.pairs(), sampling.SamplingConfig(hard=3, model_hard=4), mining)
    return out.select("source1_entity_id", "candidate_entity_id", "candidate_source", "label", "sample_weight")


@query()
def pair_features_small(x: Fixture) -> DataFrame:
    r = x.records
    side = lambda p, k: r.select(F.col("entity_id").alias(k), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_address"), F.col("country").alias(f"{p}_country"))
    pairs = x.candidates().select(*_IDS, F.lit(0.0).alias("char_name_score"))
    return features.small_features(pairs.join(side("q", "source1_entity_id"), "source1_entity_id").join(side("t", "candidate_entity_id"), "candidate_entity_id"))


_CURVE = f"""SELECT threshold_index, threshold, round(avg({fbeta('h', 'p', 'true_count')}), 8) AS macro_f0_5, CAST(sum(h) AS BIGINT) AS true_positive, CAST(sum(p - h) AS BIGINT) AS false_positive, CAST(sum(true_count - h) AS BIGINT) AS false_negative,
    round(count_if(true_count = 0 AND p = 0)::DOUBLE / nullif(count_if(true_count = 0), 0), 8) AS singleton_accuracy FROM (
    SELECT *, sum(pd) OVER w AS p, sum(hd) OVER w AS h FROM (
      SELECT source1_entity_id, match_count AS true_count, g.k AS threshold_index, round(g.k::DOUBLE / 200, 8) AS threshold, coalesce(b.pd, 0) AS pd, coalesce(b.hd, 0) AS hd
      FROM truth CROSS JOIN (SELECT range AS k FROM range(201)) g LEFT JOIN (SELECT source1_entity_id, CAST(least(200, greatest(0, floor(score * 200))) AS BIGINT) AS k, count(*) AS pd, count(hit) AS hd FROM hits GROUP BY ALL) b USING (source1_entity_id, k))
    WINDOW w AS (PARTITION BY source1_entity_id ORDER BY threshold_index DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY threshold_index, threshold"""


@query(sql("truth hits", _CURVE))
def threshold_curve(x: Fixture) -> DataFrame:
    return evaluate.threshold_curve(x.scores(), x.pairs(), x.entities())


@query(sql("truth hits", f"SELECT * FROM ({_CURVE}) ORDER BY macro_f0_5 DESC, threshold DESC LIMIT 1"))
def best_threshold(x: Fixture) -> DataFrame:
    return evaluate.best_threshold(threshold_curve(x))


@query(sql("per_entity", "SELECT * FROM per_entity"))
def per_entity_metrics(x: Fixture) -> DataFrame:
    return evaluate.per_entity(x.scores(), x.pairs(), x.entities(), THRESHOLD)


_SUMMARY = "count(*) AS entities, round(avg(entity_f0_5), 8) AS macro_f0_5, CAST(sum(true_positive) AS BIGINT) AS true_positive, CAST(sum(predicted_count - true_positive) AS BIGINT) AS false_positive, CAST(sum(true_count - true_positive) AS BIGINT) AS false_negative, round(count_if(true_count = 0 AND predicted_count = 0)::DOUBLE / nullif(count_if(true_count = 0), 0), 8) AS singleton_accuracy, CAST(count_if(true_count = 0) AS BIGINT) AS singletons"
ORACLE_SQL["per_entity_metrics"] = sql("per_entity", "SELECT source1_entity_id, true_count, predicted_count, true_positive, round(entity_f0_5, 8) AS entity_f0_5 FROM per_entity")


@query(sql("per_entity", f"SELECT {_SUMMARY} FROM per_entity"))
def evaluate_threshold(x: Fixture) -> DataFrame:
    return evaluate.evaluate(x.scores(), x.pairs(), x.entities(), THRESHOLD)


@query(sql("per_entity_by_source", f"SELECT {_SUMMARY} FROM per_entity_by_source"))
def source_thresholds(x: Fixture) -> DataFrame:
    return evaluate.evaluate(x.scores(), x.pairs(), x.entities(), SOURCE_THRESHOLDS)


@query()
def tuned_source_thresholds(x: Fixture) -> DataFrame:
    scores = x.scores()
    found = evaluate.tune_source_thresholds(scores, x.pairs(), x.entities(), THRESHOLD)
    row = (found["thresholds"]["source2"], found["thresholds"]["source3"], found["accepted"], found["baseline"], found["selected"])
    return scores.sparkSession.createDataFrame([row], "source2 double, source3 double, accepted boolean, baseline double, selected double")


@query(sql("errors", _sql_typed("SELECT * FROM errors", "", "score")))
def pair_errors(x: Fixture) -> DataFrame:
    found = x.unlisted()
    if found is None:
        return evaluate.pair_errors(x.scores(), x.candidates(), x.pairs(), THRESHOLD)
    return rulepairs.pair_errors(found, x.pairs(), score_of(features.block_strength()), THRESHOLD)


@query(sql("errors q", "SELECT error_type, candidate_source, country, count(*) AS error_count FROM errors LEFT JOIN q USING (source1_entity_id) GROUP BY ALL"))
def error_counts(x: Fixture) -> DataFrame:
    found = x.unlisted()
    if found is None:
        return evaluate.error_counts(pair_errors(x), x.queries())
    return rulepairs.error_counts(found, x.pairs(), score_of(features.block_strength()), THRESHOLD)


@query(sql("per_entity q", f"SELECT country AS slice, {_SUMMARY} FROM per_entity JOIN q USING (source1_entity_id) GROUP BY ALL"))
def slice_country(x: Fixture) -> DataFrame:
    return evaluate.slices(per_entity_metrics(x).join(x.queries().select("source1_entity_id", "country"), "source1_entity_id"), F.col("country"))


@query(sql("per_entity", f"SELECT CASE WHEN true_count >= 5 THEN '5+' ELSE true_count::VARCHAR END AS slice, {_SUMMARY} FROM per_entity GROUP BY ALL"))
def slice_cardinality(x: Fixture) -> DataFrame:
    return evaluate.slices(per_entity_metrics(x), evaluate.cardinality(F.col("true_count")))


@query(sql("per_entity final", f"SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 100 THEN '51-100' ELSE '101+' END AS slice, {_SUMMARY} FROM (SELECT e.*, coalesce(c, 0) AS n FROM per_entity e LEFT JOIN (SELECT source1_entity_id, count(*) AS c FROM final GROUP BY ALL) USING (source1_entity_id)) GROUP BY 1"))
def slice_candidate_count(x: Fixture) -> DataFrame:
    n = x.candidates().groupBy("source1_entity_id").agg(F.count("*").alias("n"))
    return evaluate.slices(per_entity_metrics(x).join(n, "source1_entity_id", "left"), evaluate.candidate_bin(F.coalesce("n", F.lit(0))))


@query(sql("assigned", "SELECT entity_id, country, match_count, split FROM assigned"))
def split_assignment(x: Fixture) -> DataFrame:
    return splits.assign_entities(x.source(1), x.truth())


@query(sql("owned", "SELECT * FROM owned"))
def target_assignment(x: Fixture) -> DataFrame:
    return splits.assign_targets(x.raw_targets(), x.truth(), split_assignment(x))


@query(sql("assigned", "SELECT split, country, match_count, count(*) AS entities, CAST(sum(match_count) AS BIGINT) AS matches FROM assigned GROUP BY ROLLUP (split, country, match_count)"))
def split_summary(x: Fixture) -> DataFrame:
    return splits.summary(split_assignment(x))




_SPLIT_CHECKS = """SELECT * FROM (VALUES ('duplicate_entities', (SELECT count(*) FROM (SELECT entity_id FROM assigned GROUP BY ALL HAVING count(*) > 1))), ('duplicate_targets', (SELECT count(*) FROM (SELECT entity_id FROM owned GROUP BY ALL HAVING count(*) > 1))),
    ('missing_entities', (SELECT count(*) FROM rec WHERE src = 1 AND entity_id NOT IN (SELECT entity_id FROM assigned))), ('missing_targets', (SELECT count(*) FROM rec WHERE src > 1 AND entity_id NOT IN (SELECT entity_id FROM owned))),
    ('pairs_across_splits', (SELECT count(*) FROM pairs p JOIN assigned a ON a.entity_id = p.source1_entity_id JOIN owned o ON o.entity_id = p.candidate_entity_id WHERE a.split <> o.split)),
    ('truth_without_assignment', (SELECT count(*) FROM truth WHERE source1_entity_id NOT IN (SELECT entity_id FROM assigned))),
    ('unknown_entity_splits', (SELECT count(*) FROM assigned WHERE split NOT IN ('train', 'validation', 'local_test'))), ('unknown_target_splits', (SELECT count(*) FROM owned WHERE split NOT IN ('train', 'validation', 'local_test')))) v("check", violations)"""


@query(sql("rec owned assigned pairs truth", _SPLIT_CHECKS))
def split_verification(x: Fixture) -> DataFrame:
    return splits.verification(x.source(1), x.raw_targets(), x.truth(), split_assignment(x), target_assignment(x))


@query(sql("t pairs assigned", "SELECT t.candidate_entity_id AS entity_id, candidate_source AS source, t.country, CASE WHEN a.entity_id IS NULL THEN 0 ELSE 1 END::BIGINT AS owned FROM t LEFT JOIN pairs USING (candidate_entity_id) LEFT JOIN (SELECT * FROM assigned WHERE split = 'validation') a ON a.entity_id = source1_entity_id"))
def scale_matched_pool(x: Fixture) -> DataFrame:
    return splits.scale_matched(split_assignment(x), x.raw_targets(), x.truth(), "validation")


def _points(c: str) -> str:
    return ", ".join(f"CAST(quantile_disc(length(coalesce(business_{c}, '')), {q}) AS BIGINT) AS {c}_length_p{int(100 * q)}" for q in audit.QUANTILES)


_MISSING = ", ".join(f"CAST(count_if(trim(coalesce({c}, '')) = '') AS BIGINT) AS missing_{c}" for c in ("business_name", "business_address", "country"))


@query(sql("allrec", f"SELECT source, count(*) AS row_count, count(DISTINCT entity_id) AS distinct_ids, count(*) - count(DISTINCT entity_id) AS surplus_ids, CAST(count_if(NOT starts_with(entity_id, 'S' || right(source, 1) || '-')) AS BIGINT) AS wrong_prefix, {_MISSING}, {_points('name')}, {_points('address')} FROM allrec GROUP BY ALL"))
def record_audit(x: Fixture) -> DataFrame:
    return audit.record_audit(x.records.withColumn("source", F.concat(F.lit("source"), F.col("src"))))


@query(sql("allrec", "SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM allrec GROUP BY business_name, business_address, country HAVING count(*) > 1)"))
def duplicate_records(x: Fixture) -> DataFrame:
    return audit.duplicate_groups(x.records, ["business_name", "business_address", "country"])


@query(sql("allrec", f"SELECT CAST(count_if(n > 1) AS BIGINT) AS repeated_rows FROM (SELECT count(*) OVER (PARTITION BY {norm('business_name')}) AS n FROM allrec)"))
def repeated_names(x: Fixture) -> DataFrame:
    return audit.repeated_texts(x.records, normalize_sql("business_name"))


@query(sql("allrec", "SELECT country, count(*) AS row_count FROM allrec GROUP BY ALL"))
def country_frequencies(x: Fixture) -> DataFrame:
    return audit.frequencies(x.records, "country")


@query(sql("truth pairs", "SELECT count(*) AS entities, CAST(count_if(match_count = 0) AS BIGINT) AS singletons, CAST(sum(match_count) AS BIGINT) AS positive_pairs, max(match_count) AS most_matches, quantile_disc(match_count, 0.5) AS matches_p50, quantile_disc(match_count, 0.9) AS matches_p90, quantile_disc(match_count, 0.99) AS matches_p99, (SELECT count(DISTINCT candidate_entity_id) FROM pairs) AS distinct_targets FROM truth"))
def ground_truth_audit(x: Fixture) -> DataFrame:
    return audit.truth_audit(x.truth())


@query(sql("truth", "SELECT match_count, count(*) AS entities FROM truth GROUP BY ALL"))
def match_histogram(x: Fixture) -> DataFrame:
    return audit.match_histogram(x.truth())


_CHECKS = "blank_ids wrong_prefixes repeated_ids repeated_truth_rows truth_of_unknown_entities entities_without_truth unknown_targets targets_with_two_owners lists_with_repeats lists_with_blanks".split()


_CONTRACT = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', ({s})::BIGINT)" for n, s in zip(_CHECKS, [
    "SELECT count(*) FROM allrec WHERE trim(coalesce(entity_id, '')) = ''", "SELECT count(*) FROM allrec WHERE NOT starts_with(entity_id, 'S' || right(source, 1) || '-')",
    "SELECT count(*) FROM (SELECT 1 FROM allrec GROUP BY source, entity_id HAVING count(*) > 1)", "SELECT count(*) FROM (SELECT 1 FROM truth GROUP BY source1_entity_id HAVING count(*) > 1)",
    "SELECT count(*) FROM truth WHERE source1_entity_id NOT IN (SELECT entity_id FROM allrec WHERE source = 'source1')", "SELECT count(*) FROM allrec WHERE source = 'source1' AND entity_id NOT IN (SELECT source1_entity_id FROM truth)",
    "SELECT count(*) FROM pairs WHERE candidate_entity_id NOT IN (SELECT entity_id FROM allrec WHERE source <> 'source1')", "SELECT count(*) FROM (SELECT 1 FROM pairs GROUP BY candidate_entity_id HAVING count(DISTINCT source1_entity_id) > 1)",
    "SELECT count(*) FROM truth WHERE matched_entity_ids <> '' AND len(string_split(matched_entity_ids, ',')) <> len(list_distinct(string_split(matched_entity_ids, ',')))", "SELECT count(*) FROM truth WHERE matched_entity_ids <> '' AND list_contains(string_split(matched_entity_ids, ','), '')",
], strict=True)) + ') v("check", violations)'


@query(sql("allrec truth pairs", _CONTRACT))
def contract_violations(x: Fixture) -> DataFrame:
    return audit.contract_violations(x.records.select("entity_id", F.concat(F.lit("source"), F.col("src")).alias("source")), x.truth())


@query(sql("manifest", "SELECT * FROM manifest"))
def fold_manifest(x: Fixture) -> DataFrame:
    return splits.fold_manifest(x.source(1), x.raw_targets(), x.truth(), 5, 20260925)


_FOLD_CHECKS = """SELECT * FROM (VALUES ('repeated', (SELECT count(*) FROM (SELECT 1 FROM manifest GROUP BY entity_id HAVING count(*) > 1))), ('out_of_range', (SELECT count(*) FROM manifest WHERE fold < 0 OR fold >= 5)),
    ('missing', (SELECT count(*) FROM rec WHERE entity_id NOT IN (SELECT entity_id FROM manifest))), ('unknown', (SELECT count(*) FROM manifest WHERE entity_id NOT IN (SELECT entity_id FROM rec))),
    ('leaking', (SELECT count(*) FROM pairs p JOIN manifest a ON a.entity_id = p.source1_entity_id JOIN manifest b ON b.entity_id = p.candidate_entity_id WHERE a.fold <> b.fold))) v("check", violations)"""


@query(sql("rec manifest pairs", _FOLD_CHECKS))
def fold_problems(x: Fixture) -> DataFrame:
    return splits.fold_problems(fold_manifest(x), x.records.select("entity_id"), x.truth(), 5)


@query(sql("matched", "SELECT * FROM matched"))
def submission_matches(x: Fixture) -> DataFrame:
    return submission.matches(x.entities(), x.scores(), THRESHOLD)


@query(sql("offered", "SELECT * FROM offered"))
def submission_candidates(x: Fixture) -> DataFrame:
    return submission.candidate_lists(x.entities(), x.candidates())


_IN_LISTS = "SELECT source1_entity_id, unnest(string_split({c}, ',')) AS candidate_entity_id FROM {t} WHERE {c} <> ''"
_MATCH_ITEMS, _OFFER_ITEMS = _IN_LISTS.format(c="matched_entity_ids", t="matched"), _IN_LISTS.format(c="candidate_entity_ids", t="offered")
_SUBMISSION = f"""SELECT * FROM (VALUES ('missing_match_rows', (SELECT count(*) FROM q WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM matched))), ('missing_candidate_rows', (SELECT count(*) FROM q WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM offered))),
    ('unknown_match_rows', (SELECT count(*) FROM matched WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM q))), ('unknown_candidate_rows', (SELECT count(*) FROM offered WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM q))),
    ('repeated_match_rows', (SELECT count(*) FROM (SELECT 1 FROM matched GROUP BY source1_entity_id HAVING count(*) > 1))), ('repeated_candidate_rows', (SELECT count(*) FROM (SELECT 1 FROM offered GROUP BY source1_entity_id HAVING count(*) > 1))),
    ('unknown_candidates', (SELECT count(*) FROM ({_OFFER_ITEMS}) WHERE candidate_entity_id NOT IN (SELECT candidate_entity_id FROM t))), ('matches_outside_candidates', (SELECT count(*) FROM ({_MATCH_ITEMS}) m ANTI JOIN ({_OFFER_ITEMS}) c USING (source1_entity_id, candidate_entity_id))),
    ('repeated_matches', (SELECT count(*) FROM (SELECT 1 FROM ({_MATCH_ITEMS}) GROUP BY source1_entity_id, candidate_entity_id HAVING count(*) > 1))), ('targets_matched_twice', (SELECT count(*) FROM (SELECT 1 FROM ({_MATCH_ITEMS}) GROUP BY candidate_entity_id HAVING count(DISTINCT source1_entity_id) > 1)))) v("check", violations)"""


@query(sql("q t matched offered", _SUBMISSION))
def submission_checks(x: Fixture) -> DataFrame:
    return submission.checks(submission_matches(x), submission_candidates(x), x.entities(), x.targets())


@query()
def matcher_scores(x: Fixture) -> DataFrame:
    """Out-of-fold scores of all candidates by boosted trees fitted to the training sample."""
    q, t = x.queries(), x.targets()
    sample = sampling.training_sample(x.candidates(), x.pairs())
    made = features.pair_features(sample, q, t, keep=("label", "sample_weight", "cv_fold", "calibration_bucket")).persist()
    models = learning.out_of_fold(made, 3, learning.MatcherConfig(rounds=10, depth=3))
    made.unpersist()
    every = features.pair_features(features.ranked(x.candidates()), q, t).transform(sampling.folded)
    return learning.score_pairs(every, models)


def _damaged(df: DataFrame, key: str, **changes: str) -> DataFrame:
    """Rows whose key ends with 7 are gone, those with 13 come twice, and those with 1 are changed as told."""
    kept = df.where(~F.col(key).endswith("7"))
    twice = kept.unionByName(kept.where(F.col(key).endswith("13")))
    return twice.withColumns({c: F.when(F.col(key).endswith("1"), F.expr(e)).otherwise(F.col(c)) for c, e in changes.items()})


def _damaged_sql(step: str, key: str, **changes: str) -> tuple[str, str]:
    """The same of a step of that name, which is kept under another."""
    replaced = ", ".join(f"CASE WHEN ends_with({key}, '1') THEN {e} ELSE {c} END AS {c}" for c, e in changes.items())
    return f"whole_{step}", f"SELECT * {f'REPLACE ({replaced})' if replaced else ''} FROM (SELECT * FROM whole_{step} WHERE NOT ends_with({key}, '7') UNION ALL SELECT * FROM whole_{step} WHERE ends_with({key}, '13'))"


def _whole(*steps: str) -> dict[str, tuple[str, str]]:
    return {f"whole_{s}": STEPS[s] for s in steps}


@query(sql("rec manifest pairs", _FOLD_CHECKS, _whole("manifest") | {"manifest": _damaged_sql("manifest", "entity_id", fold="fold + 3")}))
def fold_problems_found(x: Fixture) -> DataFrame:
    """The checks of folds on a manifest with planted faults."""
    bad = _damaged(fold_manifest(x).withColumn("fold", F.col("fold").cast("long")), "entity_id", fold="fold + 3")
    return splits.fold_problems(bad, x.records.select("entity_id"), x.truth(), 5)


_BAD_LISTS = {"matched": _damaged_sql("matched", "source1_entity_id", matched_entity_ids="'S2-0,S2-0,X-1'"), "offered": _damaged_sql("offered", "source1_entity_id", source1_entity_id="'X' || source1_entity_id", candidate_entity_ids="'S2-1,X-2'")}


@query(sql("q t matched offered", _SUBMISSION, _whole("matched", "offered") | _BAD_LISTS))
def submission_checks_found(x: Fixture) -> DataFrame:
    """The checks of result tables on tables with planted faults."""
    matched = _damaged(submission_matches(x), "source1_entity_id", matched_entity_ids="'S2-0,S2-0,X-1'")
    offered = submission_candidates(x).withColumn("key", F.col("source1_entity_id"))
    offered = _damaged(offered, "key", source1_entity_id="concat('X', source1_entity_id)", candidate_entity_ids="'S2-1,X-2'").drop("key")
    return submission.checks(matched, offered, x.entities(), x.targets())


_BAD_TRUTH = {
    "allrec": _damaged_sql("allrec", "entity_id", source="'source2'"), "truth": _damaged_sql("truth", "source1_entity_id", matched_entity_ids="'S2-1,,S2-1,S3-2'"),
    "pairs": ("truth", "SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS candidate_entity_id FROM truth WHERE matched_entity_ids <> ''"),
    "whole_pairs": STEPS["pairs"], "whole_truth": (STEPS["truth"][0].replace("pairs", "whole_pairs"), STEPS["truth"][1].replace("FROM pairs", "FROM whole_pairs")),
}


@query(sql("allrec truth pairs", _CONTRACT, _whole("allrec") | _BAD_TRUTH))
def contract_violations_found(x: Fixture) -> DataFrame:
    """The checks of the contract on records and truth with planted faults."""
    records = _damaged(x.records.select("entity_id", F.concat(F.lit("source"), F.col("src")).alias("source")), "entity_id", source="'source2'")
    return audit.contract_violations(records, _damaged(x.truth(), "source1_entity_id", matched_entity_ids="'S2-1,,S2-1,S3-2'"))


_BAD_SPLITS = {"assigned": _damaged_sql("assigned", "entity_id", split="'elsewhere'"), "owned": _damaged_sql("owned", "entity_id", split="'validation'")}
_BAD_SPLITS["whole_owned"] = (STEPS["owned"][0].replace("assigned", "whole_assigned"), STEPS["owned"][1].replace("JOIN assigned", "JOIN whole_assigned"))


@query(sql("rec owned assigned pairs truth", _SPLIT_CHECKS, _whole("assigned") | _BAD_SPLITS))
def split_faults_found(x: Fixture) -> DataFrame:
    """The checks of splits on assignments with planted faults."""
    entities, owned = split_assignment(x), target_assignment(x)
    return splits.verification(x.source(1), x.raw_targets(), x.truth(), _damaged(entities, "entity_id", split="'elsewhere'"), _damaged(owned, "entity_id", split="'validation'"))
