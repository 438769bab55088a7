"""CSV input with COPY-like rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Read headed UTF-8 CSV; columns bind by position, ``""`` is an empty string, a bare empty field is NULL.

    A row with the wrong number of fields fails the read, as a bulk load would. Files are split over tasks; a field
    with a quoted newline then breaks its row in two and fails the read. ``multi_line`` allows such fields, but makes
    each *file* one task.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("mode", "FAILFAST")
        .csv(path)
    )
