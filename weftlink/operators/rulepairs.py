"""Candidates by rules without a list of all pairs of equal records: those are counted by group, or made where a block of a
group's queries meets one of its targets, and don't travel. Ids must be their records' own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.operators.blocking import PAIR, BlockingConfig, rule_keys, slotted
from weftlink.operators.evaluate import accepted
from weftlink.sources.tables import stored

#: Records of one side of a group that meet in a block, and pairs of equal records for each task.
SIDE, TASK = 1024, 1 << 21
BOTH = ["source1_entity_id", "candidate_entity_id"]


def _repeated(records: DataFrame, key: str) -> bool:
    return bool(records.groupBy(key).agg(F.count("*").alias("rows")).where(f"rows > 1 or {key} is null").limit(1).count())


def _described(records: DataFrame, side: str, *ids: str, pieces: dict[str, Column] | None = None) -> DataFrame:
    """A record's ids, its country, what stands for its texts (their SHA-256, null for empty ones), and further pieces."""
    digest = lambda f: F.when(F.col(f) != "", F.unhex(F.sha2(F.col(f), 256))).alias(f"{side}_{f}_digest")
    return records.select(*ids, "country", digest("name"), digest("address"), *[c.alias(n) for n, c in (pieces or {}).items()])


def _equal(field: str) -> Column:
    return F.coalesce(F.col(f"q_{field}_digest") == F.col(f"t_{field}_digest"), F.lit(False))


@dataclass
class RulePairs:
    """queries: source1_entity_id, country, q_name_digest, q_address_digest. targets: candidate_entity_id,
    candidate_source, country, t_name_digest, t_address_digest. fuzzy: PAIR, fuzzy_score, shared_blocking_keys. All stored."""

    queries: DataFrame
    targets: DataFrame
    fuzzy: DataFrame

    def listed(self, pairs: DataFrame) -> DataFrame:
        """pairs (BOTH and more) with the query's country, the target's source, and whether names and addresses are equal."""
        left = self.queries.withColumnRenamed("country", "q_country")
        right = self.targets.withColumnRenamed("country", "t_country")
        both = pairs.join(left, "source1_entity_id", "left").join(right, "candidate_entity_id", "left")
        same = lambda f: (F.coalesce(F.col("q_country") == F.col("t_country"), F.lit(False)) & _equal(f)).cast("long").alias(f"exact_{f}")
        return both.select(*pairs.columns, F.col("q_country").alias("country"), "candidate_source", same("name"), same("address"))

    def counts(self) -> DataFrame:
        """Pairs of equal records by candidate_source, country, exact_name and exact_address, as rows to be summed."""
        def met(*fields: str) -> DataFrame:
            q = self.queries.groupBy("country", *[F.col(f"q_{f}_digest").alias(f) for f in fields]).agg(F.count("*").alias("q"))
            t = self.targets.groupBy("candidate_source", "country", *[F.col(f"t_{f}_digest").alias(f) for f in fields]).agg(F.count("*").alias("t"))
            return q.join(t, ["country", *fields]).groupBy("candidate_source", "country").agg(F.sum(F.col("q") * F.col("t")).alias("pairs"))

        row = lambda df, name, address, sign: df.select("candidate_source", "country", F.lit(name).cast("long").alias("exact_name"), F.lit(address).cast("long").alias("exact_address"), (sign * F.col("pairs")).alias("pairs"))
        name, address, both = met("name"), met("address"), met("name", "address")
        parts = [row(name, 1, 0, 1), row(both, 1, 0, -1), row(address, 0, 1, 1), row(both, 0, 1, -1), row(both, 1, 1, 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def equal_fuzzy(self) -> DataFrame:
        """Fuzzy candidates of equal records, as `equal` leaves them out."""
        pairs = self.listed(self.fuzzy.select(*BOTH)).where("exact_name + exact_address > 0")
        return pairs.select(*BOTH, F.lit(False).alias("by_target"))

    def _met(self, q: DataFrame, t: DataFrame, field: str, more: tuple[DataFrame, DataFrame] | None) -> DataFrame:
        """Rows of q and t with an equal country and field, and the pieces that `more` has of them. A group larger than
        SIDE meets in blocks, each in one task."""
        keys = ["country", "digest"]
        digest = lambda df, s: df.where(F.col(f"{s}_{field}_digest").isNotNull() & F.col("country").isNotNull()).withColumn("digest", F.col(f"{s}_{field}_digest"))
        q, t = digest(q, "q"), digest(t, "t")
        size = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
        sizes = stored(size(q, "q_n").join(size(t, "t_n"), keys), "sizes")
        total = sizes.agg(F.sum(F.col("q_n") * F.col("t_n"))).first()[0] or 0
        tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, -(-total // TASK)))
        blocks = lambda n: F.ceil(F.col(n) / F.lit(SIDE)).cast("int")
        large = sizes.where(f"q_n > {SIDE} or t_n > {SIDE}").select(*keys, blocks("q_n").alias("q_blocks"), blocks("t_n").alias("t_blocks"))
        parts = []
        for k, (df, own, other, key) in enumerate(((q, "q", "t", "source1_entity_id"), (t, "t", "q", "candidate_entity_id"))):
            many = lambda s: F.coalesce(f"{s}_blocks", F.lit(1))
            at = F.pmod(F.xxhash64(key), many(own)).cast("int")
            if more:  # pieces travel to their records, and only those of records that meet any
                pieces = slotted(digest(more[k], own), sizes, keys).drop(*keys, f"{own}_name_digest", f"{own}_address_digest")
                df = df.join(sizes.select(*keys), keys).join(pieces, key)
            one = df.join(F.broadcast(large), keys, "left").withColumn(f"{own}_at", at).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), many(other) - 1)))
            parts.append(one.drop("q_blocks", "t_blocks").repartition(tasks, *keys, "q_at", "t_at"))
        left, right = parts
        return left.hint("merge").join(right, [*keys, "q_at", "t_at"]).drop("q_at", "t_at", "digest")

    def equal(self, but: DataFrame, make: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = (), more: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Pairs of equal records: PAIR, exact_name, exact_address, and columns `keep` that `make` adds to them, each pair
        once. but: BOTH and `by_target` of pairs that are left out, kept with the target where that is true, else with the
        query. more: both sides' records with the pieces that `make` sees."""
        gather = lambda key, other, name, which: but.where(which).groupBy(key).agg(F.collect_list(other).alias(name))
        told = lambda df, side, *ids: df.select(*ids, "country", f"{side}_name_digest", f"{side}_address_digest")
        q = told(self.queries, "q", "source1_entity_id").join(gather("source1_entity_id", "candidate_entity_id", "q_but", ~F.col("by_target")), "source1_entity_id", "left")
        t = told(self.targets, "t", "candidate_entity_id", "candidate_source").join(gather("candidate_entity_id", "source1_entity_id", "t_but", F.col("by_target")), "candidate_entity_id", "left")
        without = F.coalesce(~F.array_contains("q_but", F.col("candidate_entity_id")), F.lit(True)) & F.coalesce(~F.array_contains("t_but", F.col("source1_entity_id")), F.lit(True))
        flagged = lambda df, name, address: df.withColumns({"exact_name": name.cast("long"), "exact_address": address.cast("long")})
        by_name = flagged(self._met(q, t, "name", more).where(without), F.lit(1), _equal("address"))
        by_address = flagged(self._met(q, t, "address", more).where(without & ~_equal("name")), F.lit(0), F.lit(1))
        both = [(make(df) if make else df).select(*PAIR, "exact_name", "exact_address", *keep) for df in (by_name, by_address)]
        return both[0].unionByName(both[1])


def rule_pairs(queries: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig(), pieces: Callable[[str], dict[str, Column]] = lambda side: {}) -> RulePairs | None:
    """None where records share an id, or have none. pieces: further columns of the records of a side (q or t)."""
    if _repeated(queries, "source1_entity_id") or _repeated(targets, "candidate_entity_id"):
        return None
    q = stored(_described(queries, "q", "source1_entity_id", pieces=pieces("q")), "queries")
    t = stored(_described(targets, "t", "candidate_entity_id", "candidate_source", pieces=pieces("t")), "targets")
    return RulePairs(q, t, stored(rule_keys(queries, targets, config), "fuzzy"))


def _with_class_score(df: DataFrame, score: Column) -> DataFrame:
    """df (exact_name, exact_address) with the score of its rows, taken once of each kind of row."""
    rows = [(n, a, 0.0, 0, 0.0) for n, a in ((1, 1), (1, 0), (0, 1))]
    kinds = df.sparkSession.createDataFrame(rows, "exact_name long, exact_address long, fuzzy_score double, shared_blocking_keys long, char_name_score double")
    of = {(r.exact_name, r.exact_address): r.score for r in kinds.withColumn("score", score).collect()}
    name, address = F.col("exact_name") > 0, F.col("exact_address") > 0
    return df.withColumn("score", F.when(name & address, F.lit(of[1, 1])).when(name, F.lit(of[1, 0])).otherwise(F.lit(of[0, 1])))


def _few(x: RulePairs, truth: DataFrame, score: Column) -> DataFrame:
    """Pairs that are fuzzy candidates or true, with `hit`, their evidence, and the score of those that are candidates."""
    true = truth.select(*BOTH).distinct().withColumn("hit", F.lit(True))
    pairs = x.listed(x.fuzzy.drop("candidate_source").join(true, BOTH, "full"))
    known = F.col("fuzzy_score").isNotNull() | (F.col("exact_name") + F.col("exact_address") > 0)
    pairs = pairs.withColumns({"known": known, "hit": F.coalesce("hit", F.lit(False)), "fuzzy_score": F.coalesce("fuzzy_score", F.lit(0.0)), "shared_blocking_keys": F.coalesce("shared_blocking_keys", F.lit(0)), "char_name_score": F.lit(0.0)})
    return stored(pairs.withColumn("score", F.when(F.col("known"), score)), "few")


def _few_errors(few: DataFrame, threshold: float | dict[str, float]) -> DataFrame:
    prefix = F.when(F.col("candidate_entity_id").startswith("S3-"), "source3").otherwise("source2")
    missed = few.where("hit").withColumn("candidate_source", prefix).where(~accepted(threshold)).withColumn("error_type", F.when(F.col("known"), "matcher_false_negative").otherwise("blocking_false_negative"))
    wrong = few.where(F.col("known") & ~F.col("hit")).where(accepted(threshold)).withColumn("error_type", F.lit("false_positive"))
    return missed.unionByName(wrong)


def pair_errors(x: RulePairs, truth: DataFrame, score: Column, threshold: float | dict[str, float]) -> DataFrame:
    """As evaluate.pair_errors, of candidates by rules and a score of their evidence."""
    few = _few(x, truth, score)
    but = few.where("exact_name + exact_address > 0").select(*BOTH, F.col("hit").alias("by_target"))
    wrong = _with_class_score(x.equal(but), score).where(accepted(threshold)).withColumn("error_type", F.lit("false_positive"))
    columns = [*PAIR, "error_type", "score"]
    return _few_errors(few, threshold).select(*columns).unionByName(wrong.select(*columns))


def error_counts(x: RulePairs, truth: DataFrame, score: Column, threshold: float | dict[str, float]) -> DataFrame:
    """As evaluate.error_counts of them: pairs of equal records are counted, not made."""
    few = _few(x, truth, score)
    listed = few.where("exact_name + exact_address > 0").groupBy("candidate_source", "country", "exact_name", "exact_address").agg((-F.count("*")).alias("pairs"))
    wrong = _with_class_score(x.counts().unionByName(listed), score).where(accepted(threshold)).withColumn("error_type", F.lit("false_positive"))
    kind = ["error_type", "candidate_source", "country"]
    rows = _few_errors(few, threshold).groupBy(*kind).agg(F.count("*").alias("pairs")).unionByName(wrong.select(*kind, "pairs"))
    return rows.groupBy(*kind).agg(F.sum("pairs").alias("error_count")).where("error_count > 0")
