"""Duplicate keys and duplicate rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from caremeter.operators.common import null_safe_join
from caremeter.operators.running import earlier_totals

SLICE_ROWS = 10_000    # rows of a key that share a slice, about; every key is cut by the same rule
CHUNK = 10_000         # rows that one folded row unfolds to at a time


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def check_duplicates(df: DataFrame, table: str, keys) -> DataFrame:
    return duplicate_keys(df, keys).agg(F.count("*").alias("duplicate_keys")).select(
        F.lit(table).alias("table_name"), "duplicate_keys")


def list_duplicates(df: DataFrame, keys, order: str, rank: str = "ranking", slice_rows: int = SLICE_ROWS,
                    chunk: int = CHUNK) -> DataFrame:
    """All rows but the first of each key, numbered in ``order`` (NULL last) from 2 up.

    Same rows as ``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order, <row digest>) > 1``. Keys of up to
    ``slice_rows`` rows are numbered by that window, with one shuffle of the rows; larger ones, found by a
    broadcast of at most rows / ``slice_rows`` keys, are cut so that no task sees all rows of a key.
    """
    keys = list(keys)
    digits = F.ceil(F.log(F.col("n") / slice_rows) / math.log(16)).cast("int")
    large = F.broadcast(duplicate_keys(df, keys).where(F.col("n") > slice_rows).select(*keys, digits.alias("__digits")))

    # the digest is made behind the shuffle, so that it does not travel
    calm = null_safe_join(df, large, keys, "left_anti").repartition(*keys)
    place = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), "__digest")
    numbered = calm.withColumn("__digest", _row_digest(df.columns)).withColumn(rank, F.row_number().over(place).cast("bigint"))
    few = numbered.where(F.col(rank) > 1).select(*df.columns, rank)
    return few.unionByName(_list_sliced(null_safe_join(df, large, keys), df.columns, keys, order, rank, slice_rows, chunk))


def _row_digest(columns) -> Column:
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]))


def _list_sliced(rows: DataFrame, columns, keys, order: str, rank: str, slice_rows: int, chunk: int) -> DataFrame:
    """The rows of large keys, as ``list_duplicates`` gives them; ``__digits`` says how finely their key is cut.

    Identical rows travel as one row with a count. A key is cut by ``order`` value and by a prefix of the row digest that
    is the longer the more rows the key has; slices are numbered by running totals, themselves cut into ranges of
    ``order``, so no task sees all rows or all order values of a key. Copies are unfolded in chunks that are spread over
    the cluster.
    """
    key = F.struct(*keys, "__digits").alias("k")
    folded = (
        rows.groupBy(*columns, "__digits").agg(F.count("*").alias("__copies"))
        .withColumn("__digest", _row_digest(columns))
        # one struct key for window and join: NULL keys match, and both share one shuffle
        .withColumn("__slice", F.struct(
            key, F.col(order).alias("o"), F.expr("substring(__digest, 1, __digits)").alias("s"))))

    sizes = folded.groupBy("__slice").agg(F.sum("__copies").alias("__size"))
    per_order = sizes.groupBy("__slice.k", "__slice.o").agg(F.sum("__size").alias("__size"))
    order_offsets = earlier_totals(per_order, ["k"], "o", "__size", "__before_order", slice_rows).select(
        F.struct("k", "o").alias("__level"), "__before_order")
    lower = Window.partitionBy("__level").orderBy("__slice.s").rowsBetween(Window.unboundedPreceding, -1)
    slice_offsets = sizes.withColumn("__level", F.struct("__slice.k", "__slice.o")).select(
        "__level", "__slice", F.coalesce(F.sum("__size").over(lower), F.lit(0)).alias("__before_slice"))
    offsets = slice_offsets.join(order_offsets, "__level").select(
        "__slice", (F.col("__before_order") + F.col("__before_slice")).alias("__offset"))

    inside = Window.partitionBy("__slice").orderBy(F.col(order).asc_nulls_last(), "__digest").rowsBetween(
        Window.unboundedPreceding, -1)
    first = F.col("__offset") + F.col("__inside") + 1
    numbered = (
        folded.withColumn("__inside", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
        .join(offsets, "__slice").withColumn("__first", first))

    last = F.col("__first") + F.col("__copies") - 1
    start = F.greatest("__first", F.lit(2))
    spread = (
        numbered.where(last > 1)
        .select(*columns, start.alias("__start"), last.alias("__last"))
        .withColumn("__from", F.explode(F.sequence("__start", "__last", F.lit(chunk)))))
    chunks = spread.repartition(*[F.col(k) for k in keys], "__from")
    to = F.least(F.col("__from") + chunk - 1, "__last")
    return chunks.select(*columns, F.explode(F.sequence("__from", to)).alias(rank))
