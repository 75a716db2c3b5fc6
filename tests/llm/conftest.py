import pytest
from llm_tables import ODD, PROSE, SCHEMA, documents


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    extra = spark.createDataFrame([(None, PROSE, None, None, None), (3, PROSE, "en", "a", 1), (3, PROSE, "en", "a", 1)], SCHEMA)
    return documents(spark, ODD).unionByName(extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
