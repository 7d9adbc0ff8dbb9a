"""Sessions with the settings that the operators are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(master: str | None = None, app: str = "weftlink", **more: str) -> SparkSession:
    """A session with SETTINGS; `more` are further settings, with underscores for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): str(v) for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
