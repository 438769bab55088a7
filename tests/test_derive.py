"""Raw tables as Spark reads them hold what the expressions shared with DuckDB say, NULLs included."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness.derive import RAW, raw_table

COLUMNS = {          # separated by comma and blank
    "customer": "id AS c_custkey, id * 1.37D AS c_acctbal, id % 25 AS c_nationkey, 'C' AS c_name, 'M' AS c_mktsegment",
    "orders": "id AS o_orderkey, id % 90 AS o_custkey, id * 17.31D AS o_totalprice, timestamp_ntz '2024-01-31' + make_dt_interval(id) AS o_orderdate",
    "lineitem": "id AS l_orderkey, id % 7 AS l_linenumber, id % 80 AS l_partkey, id % 9 AS l_suppkey, id * 3.19D AS l_extendedprice, "
                "id * 1.0D AS l_quantity, timestamp_ntz '2024-01-31' + make_dt_interval(id) AS l_shipdate",
    "events": "id AS event_id, id % 70 AS user_id, id * 0.77D AS value, timestamp_ntz '2024-01-31' + make_dt_interval(id) AS ts"}


def test_raw_tables_are_those_of_the_shared_expressions(spark, tmp_path):
    for source, columns in COLUMNS.items():
        rows = spark.range(300).selectExpr("CAST(id AS INT) AS id").selectExpr(*[c.strip() for c in columns.split(", ")])
        gaps = rows.select(*[F.when(F.rand(i) > 0.2, F.col(c)).alias(c) for i, c in enumerate(rows.columns)])
        rows.union(gaps).write.parquet(f"{tmp_path}/{source}.parquet")
    for table, (source, cols) in RAW.items():
        want = spark.read.parquet(f"{tmp_path}/{source}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in cols])
        got = raw_table(spark, str(tmp_path), table)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), table
