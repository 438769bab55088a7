"""Running totals whose work splits inside a group.

A window over all order values of a group passes them through one task. Here the order values of a large group are
first cut into ranges; the totals of the ranges are summed, then the rows of each range, so every window
sees about the square root of the group. The cut depends on the values alone: a recomputed task cuts the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MOST = 10_000      # order values of a group that one window may hold; larger groups are cut
_HEX = 12          # hexadecimal digits behind the common prefix that place a text: 48 bits, exact in a double
_FINITE = 1e308


def _common_prefix(a: str, b: str) -> Column:
    """Characters that two text columns share from the start."""
    return F.expr(
        f"CASE WHEN least(length({a}), length({b})) = 0 THEN 0 ELSE aggregate(sequence(1, least(length({a}), length({b}))), 0, "
        f"(same, i) -> IF(same = i - 1 AND substring({a}, i, 1) = substring({b}, i, 1), i, same)) END")


def _place(value: Column, kind: T.DataType, prefix: Column) -> Column | None:
    """A finite double that never falls while ``value`` grows, or None for types without one."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substr(value, prefix + 1)), _HEX, "0"), 16, 10).cast("double")
    if isinstance(kind, T.NumericType):
        return F.greatest(F.least(value.cast("double"), F.lit(_FINITE)), F.lit(-_FINITE))
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_date(value.cast("date")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    return None


def cut_ranges(rows: DataFrame, part: str, order: str, most: int, candidates: Column) -> DataFrame:
    """``rows`` with ``__range``: numbers that rise with ``order`` (NULL last) inside each ``part``.

    Parts of more than ``most`` rows are cut evenly between their smallest and largest value, numbers and dates into as many
    ranges as the square root of the rows, texts into as many as rows (their characters leave most of those empty). All
    others have range 0. Only rows that meet ``candidates`` (whole parts) are looked at.
    """
    kind = rows.schema[order].dataType
    text = isinstance(kind, T.StringType)
    if _place(F.col(order), kind, F.lit(0)) is None:
        return rows.withColumn("__range", F.lit(0).cast("bigint"))
    grid = (
        rows.where(candidates).groupBy(part)
        .agg(F.count("*").alias("__n"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
        .where(F.col("__n") > most)
        .withColumn("__prefix", _common_prefix("__lo", "__hi") if text else F.lit(0))
        .select(part, "__prefix", (F.col("__n") if text else F.ceil(F.sqrt("__n"))).alias("__ranges"),
                *[(_place(F.col(c), kind, F.col("__prefix")) / 2).alias(c) for c in ("__lo", "__hi")]))
    # halves, so that the distance of two doubles is finite
    share = F.try_divide(_place(F.col(order), kind, F.col("__prefix")) / 2 - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    number = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("__ranges")), F.col("__ranges") - 1)
    number = F.when(F.col("__ranges").isNull(), 0).when(F.col(order).isNull(), F.col("__ranges")).otherwise(number)
    return rows.join(grid, part, "left").withColumn("__range", number.cast("bigint")).select(*rows.columns, "__range")


def earlier_totals(df: DataFrame, by, order: str, amount: str, name: str, most: int = MOST,
                   candidates: Column | None = None, levels: int = 1) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of the same group with a smaller ``order``.

    ``df`` holds one row per (``by``, ``order``), as GROUP BY gives it; NULL is a group and, as ``order``, the last value. Groups of
    more than ``most`` rows are cut into ranges. With more ``levels``, ranges that are still larger are cut again, which very
    unevenly spread values need; each level names its input four times in the plan. ``candidates`` may name the groups that can be that large, to spare the search.
    Types without a place on a line (structs, arrays, binary) are not cut. An empty table gives an empty one.
    """
    candidates = F.lit(True) if candidates is None else candidates
    rows = df.withColumn("__part", F.struct(*by) if by else F.struct(F.lit(0))).withColumn("__before", F.lit(0).cast("bigint"))
    for _ in range(levels):
        rows = cut_ranges(rows, "__part", order, most, candidates).withColumn("__cut", F.struct("__part", "__range"))
        lower = Window.partitionBy("__cut.__part").orderBy("__cut.__range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = rows.groupBy("__cut").agg(F.sum(amount).alias("__total")).select(
            "__cut", F.coalesce(F.sum("__total").over(lower), F.lit(0)).alias("__offset"))
        rows = rows.join(offsets, "__cut").select(
            *df.columns, F.col("__cut").alias("__part"), (F.col("__before") + F.col("__offset")).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*df.columns, (F.col("__before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).alias(name))
