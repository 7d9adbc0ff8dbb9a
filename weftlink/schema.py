"""Record schemas and contract errors. '' is the one missing value after loading."""

from __future__ import annotations

from pyspark.sql import types as T


class ContractError(ValueError):
    """Input that breaks the data contract."""


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RECORD = _strings("entity_id", "business_name", "business_address", "country")
TRUTH = _strings("source1_entity_id", "matched_entity_ids")
MATCHES = _strings("source1_entity_id", "matched_entity_ids")
CANDIDATES = _strings("source1_entity_id", "candidate_entity_ids")
PREFIX = {"source1": "S1-", "source2": "S2-", "source3": "S3-"}
#: Optional evidence columns of candidate tables and what stands for a missing one.
EVIDENCE = {"exact_name": 0, "exact_address": 0, "fuzzy_score": 0.0, "shared_blocking_keys": 0, "char_name_score": 0.0}
