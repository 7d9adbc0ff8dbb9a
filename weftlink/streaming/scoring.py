"""Candidates for queries that arrive as a stream, against a fixed set of targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftlink.operators.blocking import BlockingConfig, queries_of, rule_candidates


def stream_candidates(records: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: BlockingConfig = BlockingConfig()) -> StreamingQuery:
    """For each micro-batch of Source 1 records, hand its rule candidates and the batch number to sink.

    A batch that is replayed after a failure has the same number and the same rows, so a sink that overwrites by number
    gets each batch exactly once."""

    def batch(df: DataFrame, number: int) -> None:
        sink(rule_candidates(queries_of(df), targets, config), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
