"""The registered corpus queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import language, maintext, mixing, neardup, packing, progressive, repetition, suffixdedup, surrogates, toxicity
from weftlink.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers, in the folder of their package."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is stored and read back; the files and tensors themselves stay in the operator's own outputs."""
    return progressive.media(table(spark, sf_dir, "documents"), outputs=())


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data: doc_id, text, n_entities, entities."""
    return surrogates.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_entities", F.size("entities").cast("long"))


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "source", "draws")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7: each document's words, its source's, and the source's target."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_language_mixture": op2_language_mixture,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_surrogates": op4_surrogates,
    "op5_suffix_repetition": op5_suffix_repetition,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_hypergeometric_mix": op7_hypergeometric_mix,
    "mixing_targets": mixing_targets,
    "op8_packing": op8_packing,
    "op9_toxic_spans": op9_toxic_spans,
    "op10_line_blocks": op10_line_blocks,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Other operators fit models, draw by hashes, or work on bytes in ways that SQL can't express; tests hold them against
#: brute force, exact round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op6_hyperminhash": f"""WITH RECURSIVE
      split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM split),
      each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
      linked AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
      arcs AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
      reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, a.y FROM reach r JOIN arcs a ON r.y = a.x)
      SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id""",
    # the sources whose cap lies under their share are those with the least cap for each unit of weight
    "mixing_targets": """WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
      total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
      weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(source_size) OVER () AS every FROM total),
      filled AS (SELECT *, 3.0 * source_size / w AS most, count(*) OVER before AS k, coalesce(sum(3 * source_size) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free FROM weighed
        WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      level AS (SELECT arg_min((every - capped)::DOUBLE / free, k) FILTER (WHERE most >= (every - capped)::DOUBLE / free) AS share FROM filled),
      aim AS (SELECT source, source_size, round(least(w * share, 3 * source_size)::DOUBLE, 4) AS target FROM filled, level)
      SELECT doc_id, size, source_size, target FROM sized JOIN aim ON sized.source IS NOT DISTINCT FROM aim.source""",
}
