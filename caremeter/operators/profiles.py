"""Column profiles for raw and typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caremeter.functions.rules import exact_avg, pct
from caremeter.functions.text import looks_decimal
from caremeter.operators.common import null_safe_join, union_all


def profile_missing(df: DataFrame, cols) -> DataFrame:
    """Total / blank / numeric / 'Not Available' counts; one scan, one row per column."""
    def counts(c):
        return F.struct(
            F.count("*").alias("total"),
            F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias("blank_or_null"),
            F.count_if(looks_decimal(c)).alias("numeric"),
            F.count_if(F.col(c) == "Not Available").alias("not_available")).alias(c)

    one = df.agg(*[counts(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "p").select("column_name", "p.*")


def column_report(tables: dict[str, DataFrame], cols: dict[str, list[str]], listed: dict[str, list[str]],
                  known=("Not Available",)) -> DataFrame:
    """(table_name, column_name, metric, item, n, least, greatest): profile of all text columns, each table read once.

    Cells are counted per (table, column, value), in their tasks first; all metrics are sums over these counts:
    ``rows``, ``blank_or_null``, ``numeric``, ``known`` (one of the ``known`` tokens), ``odd`` (none of these three),
    ``distinct`` and ``distinct_odd`` values, ``length`` per length (``item``, NULL for NULL cells), and ``value`` per value of the
    ``listed`` columns. ``least`` and ``greatest`` non-blank value, in text order, stand at ``rows``. A table without
    rows gives none. A column listed but not among ``cols`` is an error.
    """
    strange = {(t, c) for t, names in listed.items() for c in names} - {(t, c) for t, names in cols.items() for c in names}
    if strange:
        raise ValueError(f"listed, but not profiled: {sorted(strange)}")
    # a column goes by a number in place of its two names, which every cell would copy, hash and compare
    numbered = [(t, c) for t, names in cols.items() for c in names]
    number = {column: str(i) for i, column in enumerate(numbered)}
    cells = union_all([
        tables[t].select(*[F.col(f"`{c}`").alias(number[t, c]) for c in names]).unpivot([], [number[t, c] for c in names], "number", "value")
        for t, names in cols.items()])
    names = F.element_at(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in numbered]),
                         F.col("number").cast("int") + 1)
    counts = cells.groupBy("number", "value").agg(F.count("*").alias("c")).select(names.alias("column"), "value", "c").select("column.*", "value", "c")
    value = F.col("value")
    blank = value.isNull() | (value == "")
    token = ~blank & value.isin(*known)
    numeric = ~blank & ~token & looks_decimal(value)
    odd = ~blank & ~token & ~numeric
    pairs = [(t, c) for t, names in listed.items() for c in names]
    is_listed = F.struct("table_name", "column_name").isin(*[F.struct(F.lit(t), F.lit(c)) for t, c in pairs]) if pairs else F.lit(False)

    def record(metric, n, item=None, end=None):
        item, end = (F.lit(None).cast("string") if x is None else x for x in (item, end))
        return F.struct(F.lit(metric).alias("metric"), item.alias("item"), n.cast("long").alias("n"), end.alias("end"))

    sums = [record("rows", F.col("c"), end=F.when(~blank, value))]
    sums += [record(m, F.when(test, F.col("c")).otherwise(0)) for m, test in (
        ("blank_or_null", blank), ("numeric", numeric), ("known", token), ("odd", odd))]
    sums += [record("distinct", value.isNotNull()), record("distinct_odd", odd), record("length", F.col("c"), F.length(value).cast("string"))]
    records = F.when(is_listed, F.array(*sums, record("value", F.col("c"), value))).otherwise(F.array(*sums))
    return counts.select("table_name", "column_name", F.inline(records)).groupBy("table_name", "column_name", "metric", "item").agg(
        F.sum("n").alias("n"), F.min("end").alias("least"), F.max("end").alias("greatest"))


def profile_values(df: DataFrame, cols, where: Column | None = None, n: str = "n") -> DataFrame:
    """Value counts over one or more columns."""
    df = df if where is None else df.where(where)
    return df.groupBy(*cols).agg(F.count("*").alias(n))


def profile_distinct(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols).distinct()


def profile_odd_values(df: DataFrame, col: str, known=("", "Not Available")) -> DataFrame:
    """Values that are neither blank, known tokens nor numbers."""
    c = F.col(col)
    return profile_values(df, [col], c.isNotNull() & ~c.isin(*known) & ~looks_decimal(c))


def profile_length(tables: dict[str, DataFrame], col: str) -> DataFrame:
    return union_all([
        df.groupBy(F.length(col).alias("id_length")).agg(F.count("*").alias("n"))
        .select(F.lit(t).alias("table_name"), "id_length", "n") for t, df in tables.items()])


def profile_filled(df: DataFrame, cols: dict[str, str], total: str = "total") -> DataFrame:
    """Non-blank count per column of a family, one row."""
    return df.agg(F.count("*").alias(total), *[
        F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias(name) for name, c in cols.items()])


def profile_booleans(df: DataFrame, cols) -> DataFrame:
    """NULL / true / false counts per column; one scan, one row per column."""
    one = df.agg(*[
        F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c)).alias("trues"),
                 F.count_if(~F.col(c)).alias("falses"), F.count("*").alias("total")).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "p").select("column_name", "p.*")


def odd_group_sizes(df: DataFrame, key: str, expected: int, n: str = "n_per_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) != expected)


def share_within(df: DataFrame, keys, within=(), digits: int = 2, n: str = "n", pct_name: str = "pct",
                 extra=()) -> DataFrame:
    """Count per key and its share of the enclosing group (or of all rows).

    Totals come from the counts, never from the rows, so the rows are counted once. Those of enclosing groups
    are summed (tasks first) and joined back, so the counts of one group are many tasks.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias(n), *extra)
    if not within:
        return counts.withColumn(pct_name, pct(F.col(n), share_total(counts, n), digits))
    return with_group_total(counts, n, within, "__total").withColumn(
        pct_name, pct(F.col(n), F.col("__total"), digits)).drop("__total")


def with_group_total(counts: DataFrame, n: str, within, name: str) -> DataFrame:
    """``counts`` with the sum of ``n`` over the enclosing group; NULL is a group of its own."""
    return null_safe_join(counts, counts.groupBy(*within).agg(F.sum(n).alias(name)), list(within))


def share_total(counts: DataFrame, n: str) -> Column:
    """Sum of ``n`` over all of ``counts``, which holds one row per key and not the data."""
    return F.sum(n).over(Window.partitionBy(F.lit(0)))


def inventory(fact: DataFrame, by, score: str, where: Column | None = None, avg_usable_only: bool = False,
              usable_rows_only: bool = False, keep_empty: bool = True, digits: int | None = 2,
              whole_pct: bool = False) -> DataFrame:
    """Rows, usable rows, percent usable and score range per measure.

    ``avg_usable_only`` averages usable scores only; ``usable_rows_only`` drops other rows first;
    ``keep_empty=False`` drops measures without a usable row; ``whole_pct`` truncates the percent
    to whole numbers as integer division does.
    """
    df = fact if where is None else fact.where(where)
    df = df.where("is_score_usable") if usable_rows_only else df
    usable = F.count_if(F.col("is_score_usable"))
    share = pct(usable, F.count("*"), 2)
    if whole_pct:
        share = F.floor(F.lit(100) * usable / F.count("*")).cast("decimal(18,2)")
    averaged = F.when(F.col("is_score_usable"), F.col(score)) if avg_usable_only else F.col(score)
    out = df.groupBy(*by).agg(
        F.count("*").alias("total_rows"), usable.alias("usable_rows"), share.alias("pct_usable"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), exact_avg(averaged, digits).alias("avg_score"))
    return out if keep_empty else out.where(F.col("usable_rows") > 0)


def usability_gap(fact: DataFrame, by) -> DataFrame:
    """Scores that are published but flagged: availability minus usability, per key."""
    total = F.count("*")
    available, usable = F.count_if(F.col("score_available")), F.count_if(F.col("is_score_usable"))
    return fact.groupBy(*by).agg(
        total.alias("total_rows"), available.alias("score_available_num"), usable.alias("usable_rows_num"),
        pct(available, total, 2).alias("pct_available"), pct(usable, total, 2).alias("pct_usable"),
        pct(available - usable, total, 2).alias("availability_usability_gap_pct"))


def distinct_per_table(tables: dict[str, DataFrame], col: str, label: str = "source", n: str = "n_measures") -> DataFrame:
    return union_all([df.agg(F.count_distinct(col).alias(n)).select(F.lit(t).alias(label), n)
                      for t, df in tables.items()])


def overlap(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a boolean per set. One shuffle, whatever the number of sets."""
    tagged = union_all([
        df.select(key, *[F.lit(name == other).alias(other) for other in sets]) for name, df in sets.items()])
    return tagged.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.bool_or(s).alias(s) for s in sets])
