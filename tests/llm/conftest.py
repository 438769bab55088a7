from __future__ import annotations

import pytest
from pyspark.sql import types as T

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                      T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs or longer rows."""
    def make(rows, parts: int = 3):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, TEXTS).repartition(parts) if full else spark.createDataFrame([], TEXTS)
    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
