"""The provided tables as record-linkage inputs: documents split into three sources of records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import normalize_sql
from weftlink.operators.blocking import BlockingConfig, merge_evidence, queries_of, rule_candidates
from weftlink.operators.features import ranked
from weftlink.operators.retrieval import RetrievalConfig, top_k
from weftlink.operators.rulepairs import RulePairs, rule_pairs
from weftlink.sources.tables import stored

CONFIG = BlockingConfig()
THRESHOLD = 0.5
SOURCE_THRESHOLDS = {"source2": 0.45, "source3": 0.6}


def score_of(strength: Column) -> Column:
    return F.round(strength / (1.0 + strength), 9)


@dataclass
class Fixture:
    """records: entity_id, src, business_name, business_address, country. Each target belongs to the least Source 1 id
    with its country and key; a table of packed lists has every Source 1 record."""

    records: DataFrame
    made: DataFrame | None = None

    def source(self, k: int) -> DataFrame:
        return self.records.where(F.col("src") == k).drop("src")

    def queries(self, normalize=normalize_sql) -> DataFrame:
        return queries_of(self.source(1), normalize)

    def targets(self, normalize=normalize_sql) -> DataFrame:
        one = self.records.where("src > 1").withColumn("candidate_source", F.concat(F.lit("source"), F.col("src")))
        return one.select(F.col("entity_id").alias("candidate_entity_id"), "candidate_source", "country", normalize(F.col("business_name")).alias("name"), normalize(F.col("business_address")).alias("address"))

    def raw_targets(self) -> DataFrame:
        return self.records.where("src > 1").select("entity_id", F.concat(F.lit("source"), F.col("src")).alias("source"), "country")

    def entities(self) -> DataFrame:
        return self.source(1).select(F.col("entity_id").alias("source1_entity_id"))

    def pairs(self) -> DataFrame:
        """Truth: equal country and equal normalized first 24 characters."""
        key = normalize_sql(F.left("business_name", F.lit(24)))
        keyed = self.records.select("entity_id", "src", "country", key.alias("key")).where("key <> ''")
        owner = keyed.where("src = 1").groupBy("country", "key").agg(F.min("entity_id").alias("source1_entity_id"))
        return keyed.where("src > 1").join(owner, ["country", "key"]).select("source1_entity_id", F.col("entity_id").alias("candidate_entity_id"))

    def truth(self) -> DataFrame:
        lists = self.pairs().groupBy("source1_entity_id").agg(F.array_join(F.sort_array(F.collect_list("candidate_entity_id")), ",").alias("matched_entity_ids"))
        return self.entities().join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))

    def rules(self) -> DataFrame:
        return rule_candidates(self.queries(), self.targets(), CONFIG)

    def candidates(self) -> DataFrame:
        """Candidates by rules, computed once however often a query reads them."""
        if self.made is None:
            self.made = stored(self.rules(), "candidates")
        return self.made

    def unlisted(self, **more) -> RulePairs | None:
        """The same candidates without a list of all pairs of equal records; None where records share an id."""
        return rule_pairs(self.queries(), self.targets(), CONFIG, **more)

    def merged(self) -> DataFrame:
        """Candidates by rules and by retrieval, each pair with the evidence of both. Of the scores' nine places six stay,
        cut where no nine-place number lies, so that every engine cuts alike."""
        found = top_k(self.queries(), self.targets(), RetrievalConfig(top_k=20)).withColumn("char_name_score", F.floor(F.col("char_name_score") * 1e6 + 0.2505) / 1e6)
        return stored(merge_evidence(self.rules(), found), "merged")

    def scores(self) -> DataFrame:
        """A deterministic score in 0 to 1 from block_strength."""
        return ranked(self.candidates()).select("source1_entity_id", "candidate_entity_id", "candidate_source", score_of(F.col("block_strength")).alias("score"))


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    doc = spark.read.parquet(f"{sf_dir}/documents.parquet")
    src = (1 + F.col("doc_id") % 3).cast("int")
    return Fixture(doc.select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), src.alias("src"),
        F.left("text", F.lit(48)).alias("business_name"), F.expr("substr(text, 49)").alias("business_address"), F.col("lang").alias("country"),
    ))


