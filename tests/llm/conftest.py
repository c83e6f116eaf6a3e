import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Makes a table from tuples under a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
