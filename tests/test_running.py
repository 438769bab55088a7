"""Running totals against brute force: groups of one value to many, uneven values, every type of order."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caremeter.operators import running
from caremeter.operators.running import cut_ranges, earlier_totals

rng = random.Random(7)
ORDERS = {
    "string": [f"2024-{i:05d}" for i in range(300)] + ["", "2024-", "2024-é", "2024-\U0001f600", "zz"],
    "bigint": [rng.randint(-10 ** 18, 10 ** 18) for _ in range(300)] + [0, 1, 2, 3],
    "double": [rng.gauss(0, 1) for _ in range(300)] + [float("inf"), float("-inf"), float("nan"), 1.7e308, -1.7e308],
    "decimal(38,12)": [Decimal(i) / 10 ** 12 for i in range(300)] + [Decimal(10) ** 25],
    "date": [date(2020, 1, 1) + timedelta(i) for i in range(300)],
    "timestamp": [datetime(2024, 1, 1) + timedelta(microseconds=i) for i in range(300)],
    "timestamp_ntz": [datetime(2024, 1, 1) + timedelta(hours=i) for i in range(300)],
    "boolean": [False, True],
    "array<int>": [[i] for i in range(50)],
}


def smaller(kind, a, b):
    """a before b, NULL last and NaN after every number."""
    if a is None or b is None:
        return a is not None
    if kind == "double" and (a != a or b != b):
        return a == a
    return a.encode() < b.encode() if kind == "string" else a < b


@pytest.mark.parametrize("kind", ORDERS)
def test_totals_of_every_type(spark, kind):
    values = ORDERS[kind] + [None]
    rows = [(g, o, rng.randint(1, 9)) for g, part in (("hot", 1), (None, 3), ("b", 40)) for o in values[::part]]
    rows += [("alone", values[0], 4), ("empty", None, 5)]
    df = spark.createDataFrame(rows, f"g string, o {kind}, n bigint")
    shown = lambda o: f"{o:.12f}" if isinstance(o, Decimal) else repr(o)
    for most in (4, 10 ** 6):       # cut, not cut
        got = earlier_totals(df, ["g"], "o", "n", "before", most, levels=1 + (kind == "double")).collect()
        want = [(g, shown(o), n, sum(m for h, p, m in rows if h == g and smaller(kind, p, o))) for g, o, n in rows]
        key = lambda r: (str(r[0]), r[1])
        assert sorted([(r.g, shown(r.o), r.n, r.before) for r in got], key=key) == sorted(want, key=key)


def test_no_groups_and_empty(spark):
    df = spark.createDataFrame([(i, 1) for i in range(100)], "o int, n bigint")
    assert {r.o: r.b for r in earlier_totals(df, [], "o", "n", "b", 5).collect()} == {i: i for i in range(100)}
    assert earlier_totals(df.where("false"), [], "o", "n", "b").collect() == []


def cuts(df, times, most):
    """The parts of each cut in turn."""
    rows = df.withColumn("part", F.struct("g"))
    for _ in range(times):
        rows = cut_ranges(rows, "part", "o", most, F.lit(True)).withColumn("part", F.struct("part", "__range")).drop("__range")
        yield rows


def largest(parts):
    return parts.groupBy("part").count().agg(F.max("count")).first()[0]


def test_a_million_order_values_of_one_key_are_even_tasks(spark):
    values = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.format_string("order-%07d", "id").alias("o"))
    parts, = cuts(values, 1, running.MOST)
    assert largest(parts) <= running.MOST
    tasks = parts.repartition(8, "part").groupBy(F.spark_partition_id()).count().collect()
    rows = sorted(r["count"] for r in tasks)
    assert len(rows) == 8 and rows[-1] <= 2 * rows[4]


def test_uneven_values_are_cut_again(spark):
    """Nine tenths of the values in a billionth of the span: later cuts split their range."""
    spread = F.when(F.col("id") % 10 == 0, F.col("id") * 1000.0).otherwise(F.col("id") / 1e6)
    df = spark.range(20_000).select(spread.alias("o"), F.lit(1).cast("bigint").alias("n"), F.lit("hot").alias("g"))
    first, _, third = cuts(df, 3, 500)
    assert largest(first) > 15_000 and largest(third) < 500
    got = earlier_totals(df, ["g"], "o", "n", "b", 500, levels=2)
    assert got.agg(F.sum("b"), F.count_distinct("b")).first() == (20_000 * 19_999 // 2, 20_000)
