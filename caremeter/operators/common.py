"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match, keeping one copy of each key. For results of GROUP BY."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    def keyed(df):   # structs with equal fields are equal, NULL fields included
        return df.withColumn("__key", F.struct(*keys))

    return keyed(left).join(keyed(right).drop(*keys), "__key", how).drop("__key")


def union_all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def tagged(df: DataFrame, table: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), "*")
