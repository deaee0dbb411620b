import pytest
from pyspark.sql import types as T

from dealspan.llm.workload import reachable

LONG = " ".join(f"w{i % 997}" for i in range(30_000))


@pytest.fixture(scope="session", autouse=True)
def _reachable(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with names the operators use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en"), (1, "the quick brown fox jumps over the lazy dog", "en"),
        (2, None, "en"), (3, "", None), (4, " \n\n\n \t", "de"), (None, "no id here at all", "en"), (None, None, None),
        (5, LONG, "en"), (6, LONG + " tail", None), (7, "der schnelle braune Fuchs", "de"), (8, "1234 !!", "en"),
        (9, "a", "en"), (10, "über\u00a0straße <|endoftext|> \u0130x", "de"), (11, "the quick brown fox jumps over the lazy dog", None),
    ]
    names = "fp component_id own_id own_text text_key piece start length unit_id row_id n_words rejected label0".split()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(*r, None, None, *("x" for _ in names)) for r in rows], schema)
