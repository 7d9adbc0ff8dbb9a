"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import mixing, neardup, packing, surrogates, toxicity
from weftlink.llm.common import Scratch, table
from weftlink.llm.registry import tokenizer_path


def _same(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs, of whatever names."""
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the tagger, fitted to labels, calls toxic.

    Null and empty texts stay, as do rows with a null doc_id that aren't toxic; repeated rows share their fate. Ties:
    a score of exactly one half is toxic. No rows give none; other columns pass through.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id.

    Null and empty texts, and rows with a null doc_id, are in no group and stay. Rows that repeat a doc_id are one
    document: they stay or go together. No rows give none; other columns pass through.
    """
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id")
    return _same(docs.join(gone, "doc_id", "left_anti"), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars, where docs has it, counts the new text (null for a
    null text). Rows without an entity, empty texts, repeated rows, null ids and other columns stay as they are."""
    return _same(surrogates.surrogates(docs, column=None).withColumn("n_chars", F.length("text").cast("long")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights draws them.

    A null source is a source of its own. Documents of a block are drawn together, so repeated rows and ties are; null
    and empty texts weigh nothing and come with their block. No rows give none; other columns pass through.
    """
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids.

    A null or empty text is one id; rows are packed as often as they come; a null doc_id stays null. No rows give none;
    other columns are ignored.
    """
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the field of stage 1 nor the tokenizer of stage 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    store, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = store.keep(docs, name)
    return docs
