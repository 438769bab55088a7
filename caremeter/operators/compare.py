"""Per-entity composites and group statistics over several facts.

Facts are aggregated to one row per entity before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.functions import exact as X
from caremeter.functions.rules import exact_avg, pct, r_squared, safe_corr, sd
from caremeter.operators.ordered import rank_counts


def entity_mean(fact: DataFrame, score: str, where: Column, name: str, used: str, period: str | None = None,
                key: str = "facility_id", cap: float | None = None, digits: int = 2) -> DataFrame:
    """Mean usable score per entity over the rows in ``where`` (optionally capped), with its period."""
    rows = fact.where(where & F.col("is_score_usable") & F.col(score).isNotNull())
    if cap is not None:
        rows = rows.where(F.col(score) <= cap)
    aggs = [exact_avg(score, digits).alias(name), F.count("*").alias(used)]
    if period:
        aggs += [F.min("start_date").alias(f"{period}_period_start"), F.max("end_date").alias(f"{period}_period_end")]
    return rows.groupBy(key).agg(*aggs)


def outcome_mix(fact: DataFrame, prefixes: dict[str, str], min_rated: int, outcome: str = "compared_to_national",
                key: str = "facility_id") -> DataFrame:
    """Rated / better / no different / worse counts per entity, percent worse overall and per prefix."""
    rated, worse = F.col(outcome).isNotNull(), F.col(outcome) == "Worse"

    def counts(label: str, when: Column) -> list[Column]:
        n = F.count_if(when & rated)
        return [n.alias(f"{label}_rated"), pct(F.count_if(when & worse), n, 2).alias(f"{label}_pct_worse")]

    aggs = [
        F.count_if(rated).alias("comp_rated_total"),
        *[F.count_if(F.col(outcome) == label).alias(name) for name, label in
          (("comp_better", "Better"), ("comp_no_different", "No Different"), ("comp_worse", "Worse"))],
        pct(F.count_if(worse), F.count_if(rated), 2).alias("complication_pct_worse"),
    ]
    for label, pattern in prefixes.items():
        aggs += counts(label, F.col("measure_id").like(pattern))
    aggs += [F.min("start_date").alias("comp_period_start"), F.max("end_date").alias("comp_period_end")]
    mixed = fact.where("is_score_usable").groupBy(key).agg(*aggs)
    return mixed.where(F.col("comp_rated_total") >= min_rated)


def compare_means(x: str, y: str, names: dict[str, str], digits=(2, 2)) -> list[Column]:
    """Aggregates for two measures: n, means, standard deviations, r and r squared.

    ``names`` maps ``n, mean_x, sd_x, mean_y, sd_y, r`` (and optionally ``r2``) to output columns.
    """
    out = [F.count("*").alias(names["n"]),
           exact_avg(x, digits[0]).alias(names["mean_x"]), sd(x, digits[0]).alias(names["sd_x"]),
           exact_avg(y, digits[1]).alias(names["mean_y"]), sd(y, digits[1]).alias(names["sd_y"])]
    if "r" in names:
        out.append(F.round(safe_corr(x, y), 4).alias(names["r"]))
    if "r2" in names:
        out.append(F.round(r_squared(x, y), 4).alias(names["r2"]))
    return out


def group_stats(df: DataFrame, by, *aggs: Column) -> DataFrame:
    """Statistics per group, or over all rows when ``by`` is empty."""
    return df.groupBy(*by).agg(*aggs)


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts and means per quadrant of a median split on two measures (at the median counts as low).

    A value lies above the median where at least half of all rows lie below the value, so the halves are read off
    the ranks and no median is computed or rounded. Rows are folded to pairs of values first, which both the ranks and the
    quadrants are made of. Rows with a NULL in either measure are left out.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("__n"))

    values = pairs.unpivot(["__n"], [x, y], "column_name", "__v").groupBy("column_name", "__v").agg(F.sum("__n").alias("n"))
    low = rank_counts(values, ["column_name"], "__v").where(F.col("n_below") * 2 < F.col("n_group"))
    last_low = low.agg(F.struct(*[F.max(F.when(F.col("column_name") == c, F.col("__v"))).alias(c) for c in (x, y)])).scalar()

    def half(c: str) -> Column:
        return F.when(F.col(c) > F.col("__low")[c], "high").otherwise("low").alias(f"{c}_half")

    split = pairs.withColumn("__low", last_low).select(half(x), half(y), F.col(x).alias("__x"), F.col(y).alias("__y"), "__n")

    def mean(value: str, name: str) -> tuple[list[Column], Column]:
        parts = X.sum_parts(F.col(value), F.col("__n"))
        named = {part: f"{value}_{part}" for part in parts}
        return ([parts[p].alias(c) for p, c in named.items()],
                X.mean_from(*[F.col(named[p]) for p in ("whole", "units", "bad")], F.col("n"), 2).alias(name))

    (sums_x, mean_x), (sums_y, mean_y) = mean("__x", f"avg_{x}"), mean("__y", f"avg_{y}")
    sums = split.groupBy(f"{x}_half", f"{y}_half").agg(F.sum("__n").alias("n"), *sums_x, *sums_y)
    return sums.select(f"{x}_half", f"{y}_half", "n", mean_x, mean_y)
