"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = "the river ran over old stones and past quiet farms until morning light came down from high green hills".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(1000)) if r.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    base = prose(1, 300)
    copy = base.split()
    copy[150] = "changed"
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(copy), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t ", "de", None, 3),
        (7, "short text", "de", "a", 10), (8, "Short TEXT", "de", "c", 10), (9, "9 8 7 !!", "de", "c", 8), (10, prose(2, 20000), "en", "c", 9), (11, "é" * 5000, "fr", "a", 5000),
        (12, prose(3, 200) + "\n" + base[:900], "en", "b", 1), (12, prose(3, 200) + "\n" + base[:900], "en", "b", 1), (None, base, "en", "a", 1), (13, "same line here\n" * 40, "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns with the names of results and of what operators add inside."""
    from pyspark.sql import functions as F

    names = "score kept g size component_id n_words rank shard sketch block entities feature key target draws".split()
    return awkward.withColumns({n: F.lit("x") for n in names})
