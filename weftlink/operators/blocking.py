"""Candidate generation by rules: equal names or addresses, and rare shared keys weighted by inverse frequency.

Queries: source1_entity_id, country, name, address. Targets: candidate_entity_id, candidate_source, country, name,
address. Names and addresses are normalized; '' is missing. A null country matches nothing. Country equality is part
of every join key, so it partitions the work; by_country=False drops it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.text import normalize_sql, tokens
from weftlink.sources.tables import stored

#: Places of the table that tells which keys were selected, a byte each.
SLOTS = 1 << 21

PAIR = ["source1_entity_id", "candidate_entity_id", "candidate_source"]


@dataclass(frozen=True)
class BlockingConfig:
    """top_k: fuzzy candidates of a query and source; max_df: records that may share a key; max_keys: keys of a query
    and source; min_token: characters of the shortest token."""

    top_k: int = 50
    max_df: int = 200
    max_keys: int = 6
    min_token: int = 3

    def __post_init__(self):
        if min(self.top_k, self.max_df, self.max_keys, self.min_token) < 1:
            raise ValueError("all limits must be positive")


def queries_of(records: DataFrame, normalize: Callable = normalize_sql) -> DataFrame:
    return records.select(F.col("entity_id").alias("source1_entity_id"), "country", normalize(F.col("business_name")).alias("name"), normalize(F.col("business_address")).alias("address"))


def targets_of(*sources: tuple[str, DataFrame], normalize: Callable = normalize_sql) -> DataFrame:
    """Records of several sources, each tagged with its name."""
    out = None
    for name, records in sources:
        one = records.select(F.col("entity_id").alias("candidate_entity_id"), F.lit(name).alias("candidate_source"), "country", normalize(F.col("business_name")).alias("name"), normalize(F.col("business_address")).alias("address"))
        out = one if out is None else out.unionByName(one)
    return out


def exact_candidates(queries: DataFrame, targets: DataFrame, by_country: bool = True) -> DataFrame:
    """Pairs with an equal name or an equal address, as two equi-joins: a disjunction would compare whole countries. Texts
    meet by their SHA-256, so that whole addresses don't travel."""
    found = None
    for field, flags in (("name", (1, 0)), ("address", (0, 1))):
        keys = [*["country"] * by_country, F.unhex(F.sha2(F.col(field), 256)).alias("digest")]
        left = queries.where(F.col(field) != "").select("source1_entity_id", *keys)
        right = targets.where(F.col(field) != "").select("candidate_entity_id", "candidate_source", *keys)
        one = left.join(right, [*["country"] * by_country, "digest"]).select(*PAIR, F.lit(flags[0]).alias("exact_name"), F.lit(flags[1]).alias("exact_address"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(*PAIR).agg(F.max("exact_name").alias("exact_name"), F.max("exact_address").alias("exact_address"))


def _key(kind: str | Column, key: Column, weight: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("key_type"), key.alias("key"), lit(weight).cast("double").alias("key_weight"))


def blocking_keys(records: DataFrame, ids: list[str], min_token: int = 3) -> DataFrame:
    """Distinct keys of each record with their greatest weight: name tokens whole, their first and last four characters
    from five on, and address tokens, numbers apart."""
    words = lambda field: F.array_distinct(F.filter(tokens(F.col(field)), lambda t: F.length(t) >= min_token))
    name, address = words("name"), words("address")
    long = F.filter(name, lambda t: F.length(t) >= 5)
    number = lambda t: t.rlike(r"^\d+$")
    keys = F.concat(
        F.transform(name, lambda t: _key("name_exact", t, 1.0)),
        F.transform(F.array_distinct(F.transform(long, lambda t: F.left(t, F.lit(4)))), lambda t: _key("name_prefix", t, 0.65)),
        F.transform(F.array_distinct(F.transform(long, lambda t: F.right(t, F.lit(4)))), lambda t: _key("name_suffix", t, 0.65)),
        F.transform(address, lambda t: _key(F.when(number(t), "address_number").otherwise("address_exact"), t, F.when(number(t), 0.90).otherwise(0.45))),
    )
    one = records.select(*ids, "country", F.explode(keys).alias("k")).select(*ids, "country", "k.*")
    if not records.groupBy(*ids, "country").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        return one  # a kind of key has one weight, so a record's keys are distinct already
    return one.groupBy(*ids, "country", "key_type", "key").agg(F.max("key_weight").alias("key_weight"))


KEY = ["candidate_source", "country", "key_type", "key"]


def key_frequency(target_keys: DataFrame) -> DataFrame:
    return target_keys.groupBy(*KEY).agg(F.count("*").alias("document_frequency"))


def pool_sizes(targets: DataFrame) -> DataFrame:
    return targets.groupBy("candidate_source", "country").agg(F.count("*").alias("target_count"))


def selected_keys(query_keys: DataFrame, frequency: DataFrame, pools: DataFrame, config: BlockingConfig) -> DataFrame:
    """The rarest keys of each query and source, none in more than max_df records, with their inverse frequency."""
    rare = frequency.where(F.col("document_frequency") <= config.max_df)
    joined = query_keys.join(rare, ["country", "key_type", "key"]).join(pools, ["candidate_source", "country"])
    idf = F.log((F.col("target_count") + 1.0) / (F.col("document_frequency") + 1.0)).alias("idf")
    order = Window.partitionBy("source1_entity_id", "candidate_source").orderBy("document_frequency", F.desc("key_weight"), "key_type", "key")
    out = joined.select("source1_entity_id", "candidate_source", "country", "key_type", "key", "key_weight", "document_frequency", idf)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.max_keys).drop("rank")


def slotted(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """df without most of the rows whose keys `wanted` hasn't. Keys are told by their place in a table of SLOTS; a row
    whose place another key has too stays."""
    place = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    taken = bytearray(SLOTS)
    for (at,) in wanted.select(place.alias("at")).distinct().toLocalIterator():
        taken[at] = 1
    return df.where(F.substring(F.lit(bytes(taken)), place + 1, F.lit(1)) == F.lit(b"\x01"))


def meeting(target_keys: DataFrame, selected: DataFrame) -> DataFrame:
    """Target keys without most of those that no query selected, so that these needn't travel to the join, which drops
    the rest."""
    return slotted(target_keys, selected, KEY)


def fuzzy_candidates(selected: DataFrame, target_keys: DataFrame, config: BlockingConfig) -> DataFrame:
    """The top_k targets of each query and source by the weighted inverse frequency of shared keys. Scores are rounded
    to nine places before they rank, so that the order of a sum doesn't decide a tie."""
    shared = selected.join(target_keys.select("candidate_entity_id", *KEY), KEY)
    score = F.round(F.sum(F.col("key_weight") * F.col("idf")), 9)
    scored = shared.groupBy(*PAIR).agg(score.alias("fuzzy_score"), F.count("*").alias("shared_blocking_keys"))
    order = Window.partitionBy("source1_entity_id", "candidate_source").orderBy(F.desc("fuzzy_score"), F.desc("shared_blocking_keys"), "candidate_entity_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k).drop("rank")


def merge_evidence(*parts: DataFrame) -> DataFrame:
    """The union of candidate tables with the strongest evidence of each pair; absent columns count as none."""
    from weftlink.schema import EVIDENCE
    from weftlink.sources.tables import with_evidence

    out = None
    for part in parts:
        one = with_evidence(part).select(*PAIR, *[F.col(c).cast("double" if isinstance(v, float) else "long").alias(c) for c, v in EVIDENCE.items()])
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in EVIDENCE])


def rule_keys(queries: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Fuzzy candidates by the rarest keys of each query and source."""
    target_keys = blocking_keys(targets, ["candidate_entity_id", "candidate_source"], config.min_token)
    chosen = stored(selected_keys(blocking_keys(queries, ["source1_entity_id"], config.min_token), key_frequency(target_keys), pool_sizes(targets), config), "keys")
    return fuzzy_candidates(chosen, meeting(target_keys, chosen), config)


def rule_candidates(queries: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Exact and fuzzy candidates in one. Exact ones aren't limited by top_k."""
    return merge_evidence(exact_candidates(queries, targets), rule_keys(queries, targets, config)).drop("char_name_score")


def recall_by_source(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truth pairs and retrieved ones of each target source. truth: source1_entity_id, candidate_entity_id."""
    hit = candidates.select("source1_entity_id", "candidate_entity_id", F.lit(1).alias("hit")).distinct()
    joined = truth.join(hit, ["source1_entity_id", "candidate_entity_id"], "left")
    source = F.when(F.col("candidate_entity_id").startswith("S3-"), "source3").otherwise("source2").alias("candidate_source")
    return joined.groupBy(source).agg(F.count("*").alias("positive_pairs"), F.count("hit").alias("retrieved_pairs"), F.expr("try_divide(double(count(hit)), count(1))").alias("pair_recall"))


def report(queries: DataFrame, targets: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: candidates, recall of pairs and of whole entities, queries without a candidate, the reduction of the
    pair space, and exact quantiles of candidates a query."""
    per = queries.select("source1_entity_id").join(candidates.groupBy("source1_entity_id").agg(F.count("*").alias("n")), "source1_entity_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    counts = per.agg(
        F.count("*").alias("query_count"), F.sum("n").alias("candidate_pairs"), F.count_if(F.col("n") == 0).alias("zero_candidate_queries"), F.max("n").alias("most_candidates"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("long").alias(f"candidates_p{int(100 * p)}") for p in (0.5, 0.9, 0.99)],
    )
    hit = candidates.select("source1_entity_id", "candidate_entity_id", F.lit(1).alias("hit")).distinct()
    each = truth.join(hit, ["source1_entity_id", "candidate_entity_id"], "left").groupBy("source1_entity_id").agg(F.count("*").alias("t"), F.count("hit").alias("h"))
    recall = each.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("positive_pairs"), F.coalesce(F.sum("h"), F.lit(0)).alias("retrieved_pairs"),
        F.expr("try_divide(double(sum(h)), sum(t))").alias("pair_recall"), F.expr("try_divide(double(count_if(h = t)), count(1))").alias("complete_entity_recall"),
    )
    pool = targets.agg(F.count("*").alias("target_count"))
    return counts.crossJoin(recall).crossJoin(pool).withColumn("reduction_ratio", 1.0 - F.expr("try_divide(double(candidate_pairs), query_count * target_count)"))
