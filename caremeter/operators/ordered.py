"""Exact ranks and percentiles whose work splits inside a group.

A window or ``percentile`` over a hot group sorts or holds that group in one task. Here rows are
first collapsed to (group, value, count), values in their own type. The values of a group are then cut
by sign, exponent and six leading digits, slices get their offset from a running total over their sizes,
and only the values of one slice are ordered together. The cut depends on the value alone, so a
recomputed task always cuts the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import wraps

from pyspark.sql import Column, DataFrame, Window, functions as F

from caremeter.functions import exact as X
from caremeter.operators.common import null_safe_join

VALUE_TYPE = "decimal(38,12)"      # for interpolation and averages only; ranks compare the values themselves


def value_slice(value: Column) -> Column:
    """Order-preserving slice number of any numeric value: its sign, exponent and six leading digits.

    Rounding to a double and to six digits keeps the order, so a larger value never gets a smaller slice.
    """
    number = value.cast("double")
    text = F.format_string("%.5e", F.abs(number))            # d.ddddde+xx
    digits = F.regexp_replace(F.substring_index(text, "e", 1), r"\D", "").cast("bigint")
    exponent = F.substring_index(text, "e", -1).cast("bigint")
    index = F.when(number == 0, F.lit(0)).otherwise((exponent + 400) * 1_000_000 + digits).cast("bigint")
    last = F.lit(10 ** 15)
    index = F.when(F.isnan(number), last + 1).when(F.abs(number) == float("inf"), last).otherwise(index)
    return F.when(number < 0, -index).otherwise(index)


def ranked_values(df: DataFrame, by, value: str) -> DataFrame:
    """One row per (group, value): ``n`` rows, ``n_below`` rows with a smaller value, ``n_group`` rows in all.

    ``value`` keeps its type. Rows with a NULL value are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return rank_counts(counts, by, value)


def rank_counts(counts: DataFrame, by, value: str) -> DataFrame:
    """``ranked_values`` from one row per (group, value) with its rows in ``n``; no value is NULL."""
    by = list(by)
    # one struct key for window and join: NULL groups match, and both share one shuffle
    counts = counts.withColumn("__slice", F.struct(*by, value_slice(F.col(value)).alias("__s")))

    group = [F.col(f"__slice.{c}") for c in by]
    sizes = counts.groupBy("__slice").agg(F.sum("n").alias("__size"))
    lower = Window.partitionBy(*group).orderBy("__slice.__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__slice", F.coalesce(F.sum("__size").over(lower), F.lit(0)).alias("__offset"),
        F.sum("__size").over(Window.partitionBy(*group)).alias("n_group"))

    inside = Window.partitionBy("__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return numbered.join(offsets, "__slice").select(
        *by, value, "n", (F.col("__offset") + F.col("__inside")).alias("n_below"), "n_group")


def distribution(df: DataFrame, by, value: str, ps: dict[str, float], digits: int = 2) -> DataFrame:
    """Count, mean, minimum, maximum and interpolated percentiles (PERCENTILE_CONT) per group, all exact.

    ``ps`` maps an output column to its fraction, e.g. ``{"median": 0.5}``. Everything is read off the
    value counts, in decimal arithmetic rounded once, so the rows are scanned and shuffled once. Values of any numeric type
    have a place: NULL is left out, NaN is the largest, after infinity. What no decimal(38,12) holds (NaN, infinity, 1e26 and
    more) counts in ``n`` and in the order; the mean of its group is NULL, and so is every result that would be that value.
    """
    by = list(by)
    ranked = ranked_values(df.select(*by, F.col(value).alias("__v")), by, "__v")

    def position(p: float) -> Column:
        return (F.col("n_group").cast("decimal(18,0)") - 1) * F.lit(Decimal(str(p))).cast("decimal(9,8)")

    def holds(index: Column) -> Column:
        return (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n"))

    aggs = [F.max("n_group").alias("n_group"), F.min("__v").alias("min_val"), F.max("__v").alias("max_val"),
            *[c.alias(f"__{name}") for name, c in X.sum_parts(F.col("__v"), F.col("n")).items()]]
    for i, p in enumerate(ps.values()):
        at = F.floor(position(p))
        aggs += [F.max(F.when(holds(at), F.col("__v"))).alias(f"__lo{i}"),
                 F.max(F.when(holds(at + 1), F.col("__v"))).alias(f"__hi{i}")]
    ends = ranked.groupBy(*by).agg(*aggs)

    def at_fraction(i: int, p: float) -> Column:
        share = (position(p) - F.floor(position(p))).cast("decimal(9,8)")
        return X.between(X.held(F.col(f"__lo{i}")), X.held(F.col(f"__hi{i}")), share, digits)

    return ends.select(
        *by, F.coalesce("n_group", F.lit(0)).alias("n"),
        X.mean_from(F.col("__whole"), F.col("__units"), F.col("__bad"), F.col("n_group"), digits).alias("avg_val"),
        *[X.rounded(X.held(F.col(c)), digits).alias(c) for c in ("min_val", "max_val")],
        *[at_fraction(i, p).alias(name) for i, (name, p) in enumerate(ps.items())])


def percentiles(df: DataFrame, by, value: str, ps: dict[str, float], digits: int = 2) -> DataFrame:
    """Only the percentiles of ``distribution``."""
    return distribution(df, by, value, ps, digits).select(*by, *ps)


def column_distributions(df: DataFrame, cols, ps: dict[str, float], digits: int = 2) -> DataFrame:
    """``distribution`` of several columns at once, one row per ``column_name``: the input is read once."""
    long = df.select(*[F.col(c).cast(VALUE_TYPE).alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")
    return distribution(long, ["column_name"], "value", ps, digits)


def pick(name: str, column: str) -> Column:
    """Aggregate that takes ``name`` from the row of one ``column_name``."""
    return F.max(F.when(F.col("column_name") == column, F.col(name)))


def peer_rank(df: DataFrame, order: str, within=(), rank: str = "rank", total: str = "total_peers") -> DataFrame:
    """Competition rank (ties share, gaps follow) by ``order`` descending, plus the peer count.

    Only value counts are ranked; rows get their rank by a join on the value. Rows with a NULL
    ``order`` are left out.
    """
    within = list(within)
    places = ranked_values(df, within, order).select(
        *within, F.col(order).alias("__value"),
        (F.col("n_group") - F.col("n_below") - F.col("n") + 1).alias(rank), F.col("n_group").alias(total))
    rows = df.where(F.col(order).isNotNull()).withColumn("__value", F.col(order))
    return null_safe_join(rows, places, [*within, "__value"]).drop("__value")


def sort_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Report order: ``"x"`` ascending with NULL last, ``"-x"`` descending with NULL first."""
    return df.orderBy(*[F.desc_nulls_first(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys])


def in_order(*keys: str):
    """Decorator: the report comes in its documented order (keys as in ``sort_rows``, tie-breakers last)."""
    def decorate(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(report)
        def sorted_report(*args, **kwargs) -> DataFrame:
            return sort_rows(report(*args, **kwargs), *keys)
        return sorted_report
    return decorate


def by_counts(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Decorator for profiles: table by table, the largest counts (``n``, ``n_*``) first, then by the other columns."""
    @wraps(report)
    def sorted_report(*args, **kwargs) -> DataFrame:
        df = report(*args, **kwargs)
        counts = [c for c in df.columns if c == "n" or c.startswith("n_")]
        tables = [c for c in df.columns if c == "table_name"]
        return sort_rows(df, *tables, *[f"-{c}" for c in counts], *[c for c in df.columns if c not in (*counts, *tables)])
    return sorted_report


def top_k(df: DataFrame, order, k: int, tiebreak=()) -> DataFrame:
    """First ``k`` rows in a total order: per-task heaps, then one merge of ``k`` rows per task."""
    return df.orderBy(*order, *tiebreak).limit(k)
