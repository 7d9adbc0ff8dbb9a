"""Strict TSV, Parquet and report files.

TSV cells are text and nothing else: no quoting, no inferred types, 'NA' stays, an empty cell is ''.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.schema import EVIDENCE, RECORD, TRUTH, ContractError

#: The seven files of a dataset folder and their schemas.
FILES = {
    "training/source1.tsv": RECORD, "training/source2.tsv": RECORD, "training/source3.tsv": RECORD, "training/ground_truth.tsv": TRUTH,
    "test/source1.tsv": RECORD, "test/source2.tsv": RECORD, "test/source3.tsv": RECORD,
}


def check_header(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Raise unless the file's first line names exactly the schema's columns, in order. Reads no rows."""
    first = spark.read.text(path).limit(1).collect()
    found = first[0][0].lstrip("﻿").rstrip("\r").split("\t") if first else []
    if found != schema.names:
        raise ContractError(f"{path}: expected columns {schema.names}, found {found}")


def check_dataset(spark: SparkSession, root: str, files: dict[str, T.StructType] = FILES) -> None:
    for name, schema in files.items():
        check_header(spark, f"{root}/{name}", schema)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    check_header(spark, path, schema)
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", nullValue="\0", emptyValue="", enforceSchema=True).fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    """Unquoted, with a header; null and '' are truly empty cells. One file in a folder; order is df's."""
    text = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    rows = text.select(F.concat_ws("\t", *text.columns).alias("value"))
    head = df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string")
    head.coalesce(1).union(rows.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def read_tables(spark: SparkSession, *paths: str, by_name: bool = True) -> DataFrame:
    """Several Parquet tables as one, columns by name (missing ones null) or by position."""
    if not by_name:
        return spark.read.parquet(*paths)
    first, *rest = (spark.read.parquet(p) for p in paths)
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def write_table(df: DataFrame, path: str, order: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Parquet with zstd; `order` sorts the whole table. An existing table is an error unless overwrite."""
    (df.orderBy(*order) if order else df).write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once, in the folder that all executors share (spark.checkpoint.dir; in one process, where that is
    unset, a folder of our own), and read from there: its lineage is cut and no reader computes it again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{root or 'file://' + tempfile.mkdtemp(prefix='weftlink-')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_evidence(candidates: DataFrame) -> DataFrame:
    """Candidates with all evidence columns, absent and null ones at their defaults."""
    return candidates.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in candidates.columns else F.lit(v) for c, v in EVIDENCE.items()})


def fingerprint(path: str | Path) -> str:
    """SHA-256 of a local file, or of a folder's part files in the order of their names."""
    path, digest = Path(path), hashlib.sha256()
    for p in sorted(path.glob("part-*")) if path.is_dir() else [path]:
        with p.open("rb") as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
    return digest.hexdigest()


def write_report(report: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")
