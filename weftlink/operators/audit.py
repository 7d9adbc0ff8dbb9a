"""Profiles of record tables and truth lists, and violations of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.operators.splits import match_counts, truth_pairs
from weftlink.schema import PREFIX, ContractError

QUANTILES = (0.5, 0.9, 0.99)


def _empty(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def record_audit(records: DataFrame, by: str = "source") -> DataFrame:
    """One row for each source: rows, distinct and repeated ids, wrong prefixes, missing fields, and exact quantiles of
    text lengths."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[F.col(by)]
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    sized = records.withColumns({"name_length": length("business_name"), "address_length": length("business_address")})
    points = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c}_length)").cast("long").alias(f"{c}_length_p{int(100 * q)}") for c in ("name", "address") for q in QUANTILES]
    return sized.groupBy(by).agg(
        F.count("*").alias("row_count"), F.count_distinct("entity_id").alias("distinct_ids"), (F.count("*") - F.count_distinct("entity_id")).alias("surplus_ids"),
        F.count_if(~F.col("entity_id").startswith(prefix)).alias("wrong_prefix"), *[F.count_if(_empty(c)).alias(f"missing_{c}") for c in ("business_name", "business_address", "country")], *points,
    )


def duplicate_groups(records: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups share all keys, and the rows in them beyond the first of each."""
    many = records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return many.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def repeated_texts(records: DataFrame, text: Column) -> DataFrame:
    """Rows whose text another row has too."""
    return records.groupBy(text.alias("text")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))


def frequencies(records: DataFrame, column: str) -> DataFrame:
    """Values, null included, by falling count."""
    return records.groupBy(column).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), column)


def truth_audit(truth: DataFrame) -> DataFrame:
    n = match_counts(truth)
    total = n.agg(
        F.count("*").alias("entities"), F.count_if(F.col("match_count") == 0).alias("singletons"), F.sum("match_count").alias("positive_pairs"), F.max("match_count").alias("most_matches"),
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY match_count)").cast("long").alias(f"matches_p{int(100 * q)}") for q in QUANTILES],
    )
    return total.crossJoin(truth_pairs(truth).agg(F.count_distinct("candidate_entity_id").alias("distinct_targets")))


def match_histogram(truth: DataFrame) -> DataFrame:
    return match_counts(truth).groupBy("match_count").agg(F.count("*").alias("entities"))


def contract_violations(records: DataFrame, truth: DataFrame) -> DataFrame:
    """check, violations. records: entity_id, source of all sources."""
    pairs = truth_pairs(truth)
    first = records.where(F.col("source") == "source1").select(F.col("entity_id").alias("source1_entity_id"))
    others = records.where(F.col("source") != "source1").select(F.col("entity_id").alias("candidate_entity_id"))
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[F.col("source")]
    items = truth.where(~_empty("matched_entity_ids")).select("source1_entity_id", F.split("matched_entity_ids", ",").alias("ids"))
    checks = {
        "blank_ids": records.where(_empty("entity_id")), "wrong_prefixes": records.where(~F.col("entity_id").startswith(prefix)),
        "repeated_ids": records.groupBy("source", "entity_id").count().where("count > 1"), "repeated_truth_rows": truth.groupBy("source1_entity_id").count().where("count > 1"),
        "truth_of_unknown_entities": truth.join(first, "source1_entity_id", "left_anti"), "entities_without_truth": first.join(truth, "source1_entity_id", "left_anti"),
        "unknown_targets": pairs.join(others, "candidate_entity_id", "left_anti"), "targets_with_two_owners": pairs.groupBy("candidate_entity_id").agg(F.count_distinct("source1_entity_id").alias("n")).where("n > 1"),
        "lists_with_repeats": items.where(F.size("ids") != F.size(F.array_distinct("ids"))), "lists_with_blanks": items.where(F.exists("ids", lambda x: F.trim(x) == "")),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def require_contract(records: DataFrame, truth: DataFrame) -> None:
    bad = {r["check"]: r["violations"] for r in contract_violations(records, truth).where("violations > 0").collect()}
    if bad:
        raise ContractError(f"contract broken: {bad}")


def parse_id_list(value: str | None) -> tuple[str, ...]:
    """The ids of one packed list; a blank or repeated item is an error."""
    if not (value or "").strip():
        return ()
    ids = tuple(x.strip() for x in value.split(","))
    if "" in ids or len(set(ids)) != len(ids):
        raise ContractError(f"blank or repeated id in {value!r}")
    return ids
