"""Entity-disjoint splits, stratified by country and number of matches, and folds."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.text import md5_bucket, md5_number, normalize_unicode, sha_rank
from weftlink.schema import ContractError


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.90
    validation: float = 0.05
    local_test: float = 0.05
    seed: int = 20260925

    def __post_init__(self):
        if abs(self.train + self.validation + self.local_test - 1) > 1e-9 or min(self.train, self.validation, self.local_test) <= 0:
            raise ValueError("fractions must be positive and sum to 1")


#: A second split of the train part; its parts are named fit, tuning and holdout.
EXPERIMENT = SplitConfig(8 / 9, 1 / 18, 1 / 18, 20260927)
EXPERIMENT_NAMES = {"train": "fit", "validation": "tuning", "local_test": "holdout"}


def truth_pairs(truth: DataFrame) -> DataFrame:
    """One row for each id of the packed lists: source1_entity_id, candidate_entity_id."""
    some = truth.where(F.trim(F.coalesce("matched_entity_ids", F.lit(""))) != "")
    return some.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("candidate_entity_id"))


def match_counts(truth: DataFrame) -> DataFrame:
    ids = F.coalesce("matched_entity_ids", F.lit(""))
    return truth.select("source1_entity_id", F.when(F.trim(ids) == "", 0).otherwise(1 + F.length(ids) - F.length(F.replace(ids, F.lit(",")))).cast("long").alias("match_count"))


def ranked_in(df: DataFrame, strata: list[str], order: Column, *ties: str) -> DataFrame:
    """df with rank and size of its row's stratum. order: a hexadecimal text, evenly spread. Its first three digits deal a
    stratum to up to 4096 groups, whose sizes give the ranks before them, so that no stratum is ordered in one task."""
    keyed = df.withColumn("rank_key", order).withColumn("rank_digits", F.left("rank_key", F.lit(3)))
    counts = keyed.groupBy(*strata, "rank_digits").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*strata)
    upto = within.orderBy("rank_digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(*[F.col(c).alias(f"rank_{c}") for c in strata], F.col("rank_digits").alias("rank_group"), (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(within).alias("size"))
    same = F.col("rank_digits") == F.col("rank_group")
    for c in strata:
        same &= F.col(c).eqNullSafe(F.col(f"rank_{c}"))
    own = F.row_number().over(Window.partitionBy(*strata, "rank_digits").orderBy("rank_key", *ties))
    return keyed.withColumn("own_rank", own).join(before, same).withColumn("rank", F.col("own_rank") + F.col("before")).drop("own_rank", "before", "rank_key", "rank_digits", "rank_group", *[f"rank_{c}" for c in strata])


def assign_entities(source1: DataFrame, truth: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """entity_id, country, match_count, split of each Source 1 record. A stratum under three stays in train."""
    base = source1.select("entity_id", "country").join(match_counts(truth), F.col("entity_id") == F.col("source1_entity_id"))
    base = ranked_in(base, ["country", "match_count"], md5_number(F.concat(F.lit(f"{config.seed}:"), F.col("entity_id"))))
    part = lambda f: F.when(F.col("size") >= 3, F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(f)))).otherwise(0)
    v, t = part(config.validation), part(config.local_test)
    split = F.when(F.col("rank") <= v, "validation").when(F.col("rank") <= v + t, "local_test").otherwise("train")
    return base.select("entity_id", "country", "match_count", split.alias("split"))


def assign_targets(targets: DataFrame, truth: DataFrame, entities: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """entity_id, source, country, owner_source1_entity_id, split of each target: its owner's split, or a hash's."""
    owner = truth_pairs(truth).select(F.col("candidate_entity_id").alias("entity_id"), F.col("source1_entity_id").alias("owner_source1_entity_id"))
    owned = targets.join(owner, "entity_id", "left").join(entities.select(F.col("entity_id").alias("owner_source1_entity_id"), F.col("split").alias("owner_split")), "owner_source1_entity_id", "left")
    bucket = md5_bucket(F.concat(F.lit(f"{config.seed}:unmatched:"), F.col("entity_id")), 10000)
    free = F.when(bucket < round(config.validation * 10000), "validation").when(bucket < round((config.validation + config.local_test) * 10000), "local_test").otherwise("train")
    return owned.select("entity_id", "source", "country", "owner_source1_entity_id", F.coalesce("owner_split", free).alias("split"))


def rename_splits(assigned: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return assigned.withColumn("split", F.create_map(*pairs)[F.col("split")])


def split_part(records: DataFrame, assigned: DataFrame, split: str) -> DataFrame:
    """The records of one split."""
    return records.join(assigned.where(F.col("split") == split).select("entity_id"), "entity_id", "left_semi")


def scale_matched(entities: DataFrame, targets: DataFrame, truth: DataFrame, split: str) -> DataFrame:
    """For queries of one split, every target as a distractor: targets with whether a query of the split owns them."""
    own = truth_pairs(truth).join(entities.where(F.col("split") == split).select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    return targets.join(own.select(F.col("candidate_entity_id").alias("entity_id"), F.lit(1).alias("owned")), "entity_id", "left").select("entity_id", "source", "country", F.coalesce("owned", F.lit(0)).alias("owned"))


def verification(source1: DataFrame, targets: DataFrame, truth: DataFrame, entities: DataFrame, owned: DataFrame) -> DataFrame:
    """Counts of what must not be: check, violations."""
    pairs = truth_pairs(truth)
    split_of = lambda df, k, name: df.select(F.col("entity_id").alias(k), F.col("split").alias(name))
    both = pairs.join(split_of(entities, "source1_entity_id", "a"), "source1_entity_id").join(split_of(owned, "candidate_entity_id", "b"), "candidate_entity_id")
    repeated = lambda df: df.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")
    names = ["train", "validation", "local_test"]
    checks = {
        "duplicate_entities": repeated(entities), "duplicate_targets": repeated(owned),
        "missing_entities": source1.join(entities, "entity_id", "left_anti"), "missing_targets": targets.join(owned, "entity_id", "left_anti"),
        "pairs_across_splits": both.where("a <> b"), "truth_without_assignment": truth.join(entities.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_anti"),
        "unknown_entity_splits": entities.where(~F.col("split").isin(names)), "unknown_target_splits": owned.where(~F.col("split").isin(names)),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def require_clean(checked: DataFrame) -> None:
    bad = {r["check"]: r["violations"] for r in checked.where("violations > 0").collect()}
    if bad:
        raise ContractError(f"split invariants broken: {bad}")


def summary(entities: DataFrame) -> DataFrame:
    """Entities and matches by split, country and number of matches, with subtotals."""
    return entities.rollup("split", "country", "match_count").agg(F.count("*").alias("entities"), F.sum("match_count").alias("matches"))


def fold_manifest(source1: DataFrame, targets: DataFrame, truth: DataFrame, n_splits: int, seed: int, normalize=normalize_unicode) -> DataFrame:
    """entity_id, source, fold, entity_group: matched targets follow their entity; every n_splits items in a row of a
    stratum's stable order go to different folds, as greedy balancing does, without its sequential pass."""
    country = F.when(normalize(F.coalesce("country", F.lit(""))) == "", "<missing-country>").otherwise(normalize(F.coalesce("country", F.lit(""))))

    def dealt(df: DataFrame, seed: int) -> DataFrame:
        ranked = ranked_in(df, ["stratum"], sha_rank(seed, F.col("entity_id")), "entity_id")
        return ranked.withColumn("fold", ((F.col("rank") - 1) % n_splits).cast("int")).drop("rank", "size")

    counts = match_counts(truth)
    groups = source1.join(counts, F.col("entity_id") == F.col("source1_entity_id")).select("entity_id", F.concat_ws("|", country, F.when(F.col("match_count") == 0, "singleton").otherwise("matched")).alias("stratum"))
    groups = dealt(groups, seed)
    first = groups.select("entity_id", F.lit("source1").alias("source"), "fold", F.col("entity_id").alias("entity_group"))
    source = F.when(F.col("candidate_entity_id").startswith("S2-"), "source2").otherwise("source3")
    pairs = truth_pairs(truth)
    second = pairs.join(groups.select(F.col("entity_id").alias("source1_entity_id"), "fold"), "source1_entity_id").select(F.col("candidate_entity_id").alias("entity_id"), source.alias("source"), "fold", F.col("source1_entity_id").alias("entity_group"))
    free = targets.join(pairs.select(F.col("candidate_entity_id").alias("entity_id")), "entity_id", "left_anti").select("entity_id", "source", F.concat_ws("|", "source", country, F.lit("unmatched")).alias("stratum"))
    third = dealt(free, seed + 1).select("entity_id", "source", "fold", F.concat(F.lit("unmatched:"), F.col("entity_id")).alias("entity_group"))
    return first.unionByName(second).unionByName(third)


def greedy_folds(items: list[tuple[str, str, int]], n_splits: int, rank) -> dict[str, int]:
    """The sequential form for a list that fits the driver: (id, stratum, weight) to folds, the least filled of the
    stratum first, then the lightest."""
    if n_splits < 2:
        raise ValueError("there must be two folds at least")
    weight, filled, out = [0] * n_splits, defaultdict(lambda: [0] * n_splits), {}
    for key, stratum, w in sorted(items, key=lambda x: (x[1], rank(x[0]))):
        fold = min((filled[stratum][f], weight[f], f) for f in range(n_splits))[2]
        out[key] = fold
        filled[stratum][fold] += 1
        weight[fold] += w
    return out


def fold_problems(manifest: DataFrame, records: DataFrame, truth: DataFrame, n_splits: int) -> DataFrame:
    """check, violations: repeats, folds out of range, records missing or unknown, pairs across folds."""
    fold = lambda k, name: manifest.select(F.col("entity_id").alias(k), F.col("fold").alias(name))
    checks = {
        "repeated": manifest.groupBy("entity_id").count().where("count > 1"), "out_of_range": manifest.where((F.col("fold") < 0) | (F.col("fold") >= n_splits)),
        "missing": records.join(manifest, "entity_id", "left_anti"), "unknown": manifest.join(records, "entity_id", "left_anti"),
        "leaking": truth_pairs(truth).join(fold("source1_entity_id", "a"), "source1_entity_id").join(fold("candidate_entity_id", "b"), "candidate_entity_id").where("a <> b"),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def fold_part(records: DataFrame, manifest: DataFrame, source: str, held_out: int, validation: bool) -> DataFrame:
    """The records of a source inside the held-out fold, or outside it."""
    inside = F.col("fold") == held_out
    chosen = manifest.where((F.col("source") == source) & (inside if validation else ~inside)).select("entity_id")
    return records.join(chosen, "entity_id", "left_semi")
