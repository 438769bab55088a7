"""Data-quality checks and bronze-to-silver reconciliation.

Row rules of one table run in a single pass. Joins that only feed a count are done on counts per
key, so repeated keys never produce pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.functions.text import has_code, is_missing, parse_codes
from caremeter.operators.common import tagged, union_all


def row_counts(tables: dict[str, DataFrame], label: str = "table_name", count: str = "row_count") -> DataFrame:
    return union_all([df.agg(F.count("*").alias(count)).select(F.lit(t).alias(label), count)
                      for t, df in tables.items()])


def check_counts(bronze: dict[str, DataFrame], silver: dict[str, DataFrame]) -> DataFrame:
    """Row-count parity per table."""
    def pair(t):
        both = bronze[t].select(F.lit(1).alias("b"), F.lit(0).alias("s")).unionByName(
            silver[t].select(F.lit(0).alias("b"), F.lit(1).alias("s")))
        sums = both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bronze_count"),
                        F.coalesce(F.sum("s"), F.lit(0)).alias("silver_count"))
        return sums.select(F.lit(t).alias("table_name"), "bronze_count", "silver_count",
                           (F.col("bronze_count") == F.col("silver_count")).alias("counts_match"))
    return union_all([pair(t) for t in bronze])


def violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule: one scan for all rules, one output row per rule."""
    names = list(rules)
    one = df.agg(*[F.count_if(rules[r]).alias(r) for r in names])
    return tagged(one.unpivot([], names, "check_name", "bad_rows"), table)


def check_implies(given: Column, then: Column) -> Column:
    """Rule column: true where ``given`` holds and ``then`` does not (NULL counts as not holding)."""
    return given & ~F.coalesce(then, F.lit(False))


def fact_rules(score_cols, table_has_dates: bool = True) -> dict[str, Column]:
    """Invariants of a silver fact table; ``score_cols`` are the typed score columns."""
    usable, reason = F.col("is_score_usable"), F.col("score_exclusion_reason")
    present = F.coalesce(*[F.col(c).cast("string") for c in score_cols]).isNotNull()
    rules = {
        "null_facility_id": F.col("facility_id").isNull(),
        "usable_without_score": check_implies(usable, present),
        "unusable_score_without_reason": check_implies(~usable & present, reason.isNotNull()),
        "usable_with_blocked_code": usable & has_code(parse_codes("footnote"), V.BLOCKED_CODES),
    }
    if table_has_dates:
        rules["inverted_dates"] = F.col("start_date") > F.col("end_date")
    return rules


def check_null_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    return union_all([df.agg(F.count_if(F.col(key).isNull()).alias("null_keys")).select(
        F.lit(t).alias("table_name"), "null_keys") for t, df in tables.items()])


def check_lengths(df: DataFrame, table: str, limits: dict[str, int]) -> DataFrame:
    """Warn-level: values longer than the declared text length, per column."""
    return violations(df, table, {c: F.length(c) > n for c, n in limits.items()})


def check_orphans(fact: DataFrame, dim: DataFrame, table: str, key: str) -> DataFrame:
    """Distinct fact keys without a dimension row. Keys are made distinct before the join."""
    missing = fact.select(key).distinct().join(dim.select(key).distinct(), key, "left_anti")
    return missing.agg(F.count(key).alias("orphan_ids")).select(F.lit(table).alias("table_name"), "orphan_ids")


def check_range(df: DataFrame, table: str, low: str, high: str | None = None,
                names=("min_score", "max_score")) -> DataFrame:
    return tagged(df.agg(F.min(low).alias(names[0]), F.max(high or low).alias(names[1])), table)


def pct_bounds(df: DataFrame, col: str) -> DataFrame:
    """A percentage must lie in 0..100 and not be NULL."""
    c = F.col(col)
    return df.agg(F.min(c).alias("min_pct"), F.max(c).alias("max_pct"),
                  F.count_if(c.isNull()).alias("null_count"),
                  F.count_if((c < 0) | (c > 100)).alias("out_of_range"))


def exclusive_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """How two columns that must not both be set are populated."""
    has_a, has_b = F.col(a).isNotNull(), F.col(b).isNotNull()
    return df.agg(F.count_if(has_a & ~has_b).alias("numeric_only"), F.count_if(~has_a & has_b).alias("text_only"),
                  F.count_if(has_a & has_b).alias("both_populated"), F.count_if(~has_a & ~has_b).alias("both_null"))


def check_lost_values(bronze: DataFrame, silver: DataFrame, table: str, keys, raw: str, kept) -> DataFrame:
    """Joined rows whose raw value was real but whose typed value is missing.

    Equals the row count of the bronze-silver join on ``keys``, computed as the sum over keys of
    (real raw rows x empty typed rows). Keys are trimmed on both sides.
    """
    def keyed(df, condition, name):
        trimmed = [F.trim(k).alias(k) for k in keys]
        return df.where(condition).select(*trimmed).groupBy(*keys).agg(F.count("*").alias(name))

    real = ~is_missing(raw) & ~F.col(raw).rlike(V.BLANK_PATTERN)
    empty = F.coalesce(*[F.col(c).cast("string") for c in kept]).isNull()
    pairs = keyed(bronze, real, "b").join(keyed(silver, empty, "s"), list(keys))
    return pairs.agg(_pair_total("b", "s").alias("lost_scores")).select(F.lit(table).alias("table_name"), "lost_scores")


def check_unread_values(bronze: DataFrame, table: str, typed: dict[str, tuple[Column, Column]]) -> DataFrame:
    """What typing loses, per raw column, in one scan.

    ``typed`` maps a column to (its text has the form of the type, its typed value). ``real_values`` are neither empty
    nor a word for missing; ``wrong_form`` of them do not have the form, ``beyond_type`` have it but do not fit.
    """
    def counts(c, form, value):
        real = ~is_missing(c) & ~F.col(c).rlike(V.BLANK_PATTERN)
        form = F.coalesce(form, F.lit(False))
        return F.struct(F.count_if(real).alias("real_values"), F.count_if(real & ~form).alias("wrong_form"),
                        F.count_if(form & value.isNull()).alias("beyond_type")).alias(c)

    one = bronze.agg(*[counts(c, *pair) for c, pair in typed.items()])
    return one.unpivot([], list(typed), "column_name", "p").select(F.lit(table).alias("table_name"), "column_name", "p.*")


def join_size(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Row count of the inner join, from the counts per key."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    return a.join(b, key).agg(_pair_total("a", "b").alias("matched_rows")).select(
        F.lit(label).alias("join_test"), "matched_rows")


def _pair_total(a: str, b: str) -> Column:
    return F.coalesce(F.sum(F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")), F.lit(0)).cast("bigint")


def spot_check(bronze: DataFrame, silver: DataFrame, keys, key: str, ids,
               bronze_cols: dict[str, str], silver_cols: dict[str, str]) -> DataFrame:
    """Raw and typed values side by side for the given entities.

    The column dicts map source columns to output names. ``ids`` filters both scans before the join. Equal rows of one side are folded first, and
    ``n_rows`` says how many joined rows a line stands for (1 when keys are unique).
    """
    def side(df, cols, name):
        picked = df.select(*[F.trim(k).alias(k) for k in keys], *[F.col(c).alias(a) for c, a in cols.items()])
        picked = picked.where(F.col(key).isin(*ids))
        return picked.groupBy(*picked.columns).agg(F.count("*").alias(name))

    both = side(bronze, bronze_cols, "__b").join(side(silver, silver_cols, "__s"), list(keys))
    return both.select(*keys, *bronze_cols.values(), *silver_cols.values(), (F.col("__b") * F.col("__s")).alias("n_rows"))


def never_true(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys for which ``flag`` is true on no row."""
    return df.groupBy(key).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("__any")).where(~F.col("__any")).select(key)


def stack_facts(tables: dict[str, DataFrame], cols, label: str = "table_name") -> DataFrame:
    """UNION ALL of the same projection over several tables, with a source label."""
    return union_all([df.select(F.lit(t).alias(label), *cols) for t, df in tables.items()])


def in_many(tables: dict[str, DataFrame], col: str) -> DataFrame:
    """Values found in more than one table."""
    seen = union_all([df.select(col, F.lit(t).alias("source_table")).distinct() for t, df in tables.items()])
    return seen.groupBy(col).agg(F.count_distinct("source_table").alias("n_tables")).where(F.col("n_tables") > 1)


def compare_sets(tables: dict[str, DataFrame], col: str) -> DataFrame:
    """Distinct values of a column per source: shows variants before and after cleaning."""
    return union_all([df.select(F.col(col).alias("value")).distinct().withColumn("source", F.lit(t))
                      for t, df in tables.items()])


def unmatched_values(bronze: DataFrame, raw: str, label: Column) -> DataFrame:
    """Raw values that a recode leaves without a label, with their counts."""
    return (bronze.where(~is_missing(raw) & label.isNull()).groupBy(raw).agg(F.count("*").alias("n")))
