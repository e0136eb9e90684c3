import pytest
from pyspark.sql.types import LongType, StringType, StructType


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with the other columns and one of a clashing name."""
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add("lang", StringType()).add("source", StringType()).add("n_chars", LongType()).add("words", StringType())

    def make(rows):
        return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), "x") for k, t in rows], schema)

    return make
