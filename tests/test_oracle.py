"""Every registered query against its DuckDB SQL (small scale; ``harness.compare`` runs larger ones)."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from harness.compare import difference, duck
from harness.lake import Lake, comparable
from harness.queries import REPORTS

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, SF)


def test_registry():
    """Every report has SQL; the operators of the training-data subpackage register beside them, if it is there."""
    assert set(REPORTS) <= set(queries()) and set(REPORTS) <= set(SQL) <= set(queries())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in set(queries()) - set(REPORTS))


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_matches_sql(lake, con, name):
    """Same columns, types and rows as the SQL; no cross join and no Python worker in the plan."""
    df = comparable(REPORTS[name](lake))
    assert difference(df, con, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python") if node in plan]


def test_wide_projections_are_compiled(spark):
    """Reading the tables sets the limit beyond which expressions are split over methods that the JVM compiles."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "65535")
        Lake(spark, SF)
        assert spark.conf.get(limit) == "8000"
    finally:
        spark.conf.set(limit, before)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "facility_id" and df.count() > 0
