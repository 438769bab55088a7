"""Row differences against multisets, with few and many differing keys."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caremeter.operators.difference import differing_keys, row_difference

SCHEMA = "m string, k string, v double, t string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_differences_are_those_of_multisets(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice(["x", "y", None, ""]), rng.choice([None, 1.0, 2.0]),
             rng.choice([None, "", "t"])) for i in range(400)]
    other = rows[:150] + [("b", "x", 9.0, None), ("new", None, None, None)] + rows[160:] + rows[200:203]
    other.remove(rows[0])
    rng.shuffle(other)
    a, b = Counter(rows), Counter(other)
    want = {r: (a[r], b[r]) for r in a.keys() | b.keys() if a[r] != b[r]}
    for listed in (1_000, 2, 0):      # filters, then a join
        got = row_difference(table(spark, rows), table(spark, other).select("t", "v", "k", "m"), ["m", "k"], listed).collect()
        assert {(r.m, r.k, r.v, r.t): (r.n_left, r.n_right) for r in got} == want and len(got) == len(want)


def test_null_and_empty_and_places_are_told_apart(spark):
    left, right = table(spark, [("a", "x", None, "t")]), table(spark, [("a", "t", None, "x")])
    assert differing_keys(left, right, ["m"]).count() == 1
    assert row_difference(table(spark, [("a", None, 1.0, "")]), table(spark, [("a", "", 1.0, None)]), ["m"]).count() == 2


def test_equal_and_empty_tables(spark):
    df = table(spark, [("a", "x", 1.0, "t")] * 3)
    assert row_difference(df, df, ["m", "k"]).collect() == []
    assert row_difference(df.where("false"), df.where("false"), ["m"]).collect() == []
    only = row_difference(df, df.where("false"), ["m"]).collect()
    assert [(r.n_left, r.n_right) for r in only] == [(3, 0)]
    with pytest.raises(ValueError):
        row_difference(df, df.drop("t"), ["m"])


def test_one_changed_row_reads_one_range(spark, tmp_path):
    """Tables clustered by key: the scan of the last level asks for the one differing key only."""
    rows = spark.range(20_000).select(
        F.format_string("m%02d", F.col("id") % 40).alias("m"), F.format_string("k%05d", "id").alias("k"),
        F.col("id").cast("double").alias("v"), F.lit("t").alias("t"))
    rows.repartitionByRange(8, "m").sortWithinPartitions("m", "k").write.parquet(f"{tmp_path}/a")
    changed = F.when(F.col("k") == "k00017", F.lit(-1.0)).otherwise(F.col("v"))
    spark.read.parquet(f"{tmp_path}/a").withColumn("v", changed).write.parquet(f"{tmp_path}/b")
    found = row_difference(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"), ["m", "k"])
    got = {(r.m, r.k, r.v): (r.n_left, r.n_right) for r in found.collect()}
    assert got == {("m17", "k00017", 17.0): (1, 0), ("m17", "k00017", -1.0): (0, 1)}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("EqualTo(m,m17)") >= 2 and text.count("EqualTo(k,k00017)") >= 2 or \
        text.count("In(m, [m17])") >= 2 and text.count("In(k, [k00017])") >= 2


def test_many_differing_values_are_counted_without_another_level(spark, monkeypatch):
    """Where more of the next column's values differ than are listed, that level is not read, and no row is joined."""
    from caremeter.operators import difference

    depths = []
    keys = difference.differing_keys
    monkeypatch.setattr(difference, "differing_keys", lambda a, b, prefix, *cell: depths.append(len(prefix)) or keys(a, b, prefix, *cell))
    rows = spark.range(400).select(F.lit("m").alias("m"), F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"),
                                   F.lit(None).cast("string").alias("t"))
    changed = rows.withColumn("v", F.when(F.col("k") < "3", F.col("v") + 1).otherwise(F.col("v")))
    few = rows.withColumn("v", F.when(F.col("k") == "7", 0.5).otherwise(F.col("v")))
    found = row_difference(rows, changed, ["m", "k"], 20)
    assert depths == [1] and found.count() == 2 * changed.where("k < '3'").count()
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert row_difference(rows, few, ["m", "k"], 20).count() == 2 and depths == [1, 1, 2]
