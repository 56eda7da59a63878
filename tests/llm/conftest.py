import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = "thing and the other " * 20_000

# Nulls in any column, empty and long texts, repeated rows, and a column whose name results use.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", "x"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", "x"),
    (2, None, None, None, None),
    (3, "", "en", "a", None),
    (4, LONG, "en", "b", "y"),
    (None, "der schnelle braune Fuchs springt auf den faulen Hund", "de", None, "z"),
    (5, " \t\n ", None, "a", "x"),
    (6, "123 456 !!", "de", "b", "x"),
    (7, "the quick", "en", "b", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


@pytest.fixture(scope="module", autouse=True)
def own_batch_size(spark):
    """Stages of the pipeline leave the session's batch size changed, which must not reach the next tests."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)
