import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with a further column whose name the operators also use."""

    def make(rows, extra=()):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        for name in extra:
            schema.add(name, T.StringType())
        return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)

    return make
