"""The column report: every metric against plain counts, each table read once, cells combined before the shuffle."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caremeter.operators.profiles import column_report
from caremeter.plans.bronze_checks import column_report as bronze_report
from caremeter.sources.schemas import RAW_COLUMNS, TABLES

ROWS = [("1", "a"), ("1", None), ("22.5", ""), ("Not Available", "a"), ("7 of 9", "B"), (None, "a"), ("", "Not Available"), (".5", "é")]
NUMBER = re.compile(r"\d+\.?\d*")


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "x string, y string")


def expected(values, listed):
    blank = [v for v in values if v in (None, "")]
    known = [v for v in values if v == "Not Available"]
    rest = [v for v in values if v not in (None, "", "Not Available")]
    odd = [v for v in rest if not NUMBER.fullmatch(v)]
    filled = sorted((v for v in values if v), key=str.encode)
    out = {("rows", None): (len(values), filled[0], filled[-1])}
    for metric, n in (("blank_or_null", len(blank)), ("known", len(known)), ("numeric", len(rest) - len(odd)), ("odd", len(odd)),
                      ("distinct", len({v for v in values if v is not None})), ("distinct_odd", len(set(odd)))):
        out[metric, None] = (n, None, None)
    for length, n in Counter(None if v is None else str(len(v)) for v in values).items():
        out["length", length] = (n, None, None)
    for value, n in Counter(values).items() if listed else ():
        out["value", value] = (n, None, None)
    return out


def test_every_metric_by_hand(small):
    out = column_report({"t": small}, {"t": ["x", "y"]}, {"t": ["y"]}).collect()
    for at, column in enumerate("xy"):
        got = {(r.metric, r.item): (r.n, r.least, r.greatest) for r in out if r.column_name == column}
        assert got == expected([row[at] for row in ROWS], column == "y")
    assert len(out) == len({(r.column_name, r.metric, r.item) for r in out})


def test_same_column_name_in_two_tables(small):
    """Listing a column of one table does not list its namesake."""
    out = column_report({"t": small, "u": small.limit(1)}, {"t": ["x"], "u": ["x"]}, {"u": ["x"]}).where("metric = 'value'").collect()
    assert [(r.table_name, r.n) for r in out] == [("u", 1)]


def test_empty_tables_nothing_listed_and_unknown_columns(small):
    assert column_report({"t": small.limit(0)}, {"t": ["x", "y"]}, {"t": ["x"]}).count() == 0
    assert column_report({"t": small}, {"t": ["x"]}, {}).where("metric = 'value'").count() == 0
    with pytest.raises(ValueError, match="listed"):
        column_report({"t": small}, {"t": ["x"]}, {"t": ["y"]})


def test_names_of_helper_columns_may_be_profiled(spark):
    names = ["table_name", "column_name", "value", "c", "n"]
    df = spark.createDataFrame([("p", "q", "r", "s", "1")], ", ".join(f"{c} string" for c in names))
    out = column_report({"t": df}, {"t": names}, {"t": names}).where("metric = 'value'").collect()
    assert {(r.column_name, r.item) for r in out} == set(zip(names, "pqrs1"))


def test_each_raw_table_is_read_once(spark, tmp_path):
    b = {}
    for t in TABLES:
        spark.createDataFrame([("1",) * len(RAW_COLUMNS[t])] * 3, ", ".join(f"{c} string" for c in RAW_COLUMNS[t])).write.parquet(f"{tmp_path}/{t}")
        b[t] = spark.read.parquet(f"{tmp_path}/{t}")
    df = bronze_report(b)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") == 5 and "Join" not in plan and "Python" not in plan
    assert {r.n for r in df.where("metric = 'rows'").collect()} == {3}
    assert df.where("metric = 'rows'").count() == sum(map(len, RAW_COLUMNS.values()))


def test_a_hot_value_is_counted_in_its_tasks(spark):
    """Half of all cells are one value; what is shuffled is one count per task and value."""
    df = spark.range(40_000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("x"))
    out = {r.metric: r.n for r in column_report({"t": df}, {"t": ["x"]}, {}).where("item IS NULL").collect()}
    assert out["rows"] == 40_000 and out["odd"] == 20_000 and out["distinct"] == 20_001 and out["distinct_odd"] == 1
    plan = column_report({"t": df}, {"t": ["x"]}, {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("HashAggregate") + plan.count("SortAggregate") >= 4


def test_cells_do_not_carry_names(spark):
    """Every cell would copy and compare the names of its table and column: cells are counted by a number."""
    df = spark.createDataFrame([("a", "b")], "`x.y` string, z string")
    found = column_report({"t": df, "u": df}, {"t": ["x.y", "z"], "u": ["z"]}, {})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    expands = [line for line in plan.splitlines() if "Expand" in line]
    assert len(expands) == 2 and not any("x.y," in line.split("], [")[0] or "table_name" in line for line in expands)
    rows = {(r.table_name, r.column_name, r.n) for r in found.where("metric = 'rows'").collect()}
    assert rows == {("t", "x.y", 1), ("t", "z", 1), ("u", "z", 1)}
