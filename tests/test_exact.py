"""Means and percentiles of any numeric type against Python's exact fractions."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from caremeter.functions.rules import exact_avg
from caremeter.functions.text import split_score
from caremeter.operators.ordered import distribution
from caremeter.plans.silver_checks import unread_values
from caremeter.sources.schemas import RAW_COLUMNS, TABLES

PS = {"p10": 0.1, "median": 0.5, "p90": 0.9, "odd": 0.33333333}


def half_up(x, digits=2):
    scaled = abs(x) * 10 ** digits
    n = scaled.numerator * 2 + scaled.denominator
    out = Decimal(n // (2 * scaled.denominator)).scaleb(-digits)
    return -out if x < 0 else out


def brute(values):
    exact = sorted(Fraction(v) for v in values)
    out = [len(exact), half_up(sum(exact) / len(exact)), half_up(exact[0]), half_up(exact[-1])]
    for p in PS.values():
        at = (len(exact) - 1) * Fraction(Decimal(str(p)))
        low = at.numerator // at.denominator
        high = min(low + 1, len(exact) - 1)
        out.append(half_up(exact[low] + (exact[high] - exact[low]) * (at - low)))
    return tuple(out)


def got(spark, values, kind="decimal(38,12)", digits=2):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return tuple(distribution(df, [], "v", PS, digits).first())


CASES = {
    "six digits and more": ["0.00499996"],
    "a half from thirds": ["0.005", "0.005", "0.005"],
    "ties to the outside": ["-0.005"], "mixed signs": ["-1.000000000001", "1", "0.999999999999", "-0.5"],
    "large and small": ["99999999999999999999999999.999999999999", "0.000000000001"],
    "large, alike": ["12345678901234567890123456.123456789012"] * 3 + ["12345678901234567890123456.123456789013"],
    "negative and large": ["-99999999999999999999999999.995", "-0.004999999999"],
    "sum to a tie": ["0.01", "0.000000000001", "0.004999999999"],
}


@pytest.mark.parametrize("name", CASES)
def test_decimals(spark, name):
    values = [Decimal(v) for v in CASES[name]]
    assert got(spark, values) == brute(values)


def test_random_decimals(spark):
    rng = random.Random(1)
    rows = [(g, Decimal(rng.randrange(-10 ** rng.randrange(1, 37), 10 ** rng.randrange(1, 37))).scaleb(-12)) for g in range(40) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g int, v decimal(38,12)")
    found = {r[0]: tuple(r[1:]) for r in distribution(df, ["g"], "v", PS).collect()}
    assert found == {g: brute([v for h, v in rows if h == g]) for g in range(40)}


def test_doubles_that_no_decimal_holds_have_a_place(spark):
    nan, inf = float("nan"), float("inf")
    n, mean, low, high, p10, median, p90, odd = got(spark, [nan, 1.0], "double")
    assert (n, mean, low, high, median) == (2, None, Decimal("1.00"), None, None)
    n, mean, low, high, p10, median, *_ = got(spark, [inf, 1.0, 2.0], "double")
    assert (n, mean, low, high, median) == (3, None, Decimal("1.00"), None, Decimal("2.00"))
    assert got(spark, [1e30], "double")[:4] == (1, None, None, None)
    assert got(spark, [-inf, 5.0, 5.0], "double")[:6] == (3, None, None, Decimal("5.00"), None, Decimal("5.00"))
    assert got(spark, [0.25, 0.5], "double")[:2] == (2, Decimal("0.38"))
    assert got(spark, [], "double")[:4] == (0, None, None, None) and got(spark, [None, None], "double")[1] is None
    assert got(spark, [9223372036854775807, -9223372036854775808], "bigint")[1:4] == (
        Decimal("-0.50"), Decimal("-9223372036854775808.00"), Decimal("9223372036854775807.00"))


def test_average_of_rows(spark):
    def avg(values, kind="double"):
        return spark.createDataFrame([(v,) for v in values], f"v {kind}").agg(exact_avg("v", 2)).first()[0]
    assert avg([0.00499996]) == Decimal("0.00") and avg([1.0, None, 2.0]) == Decimal("1.50") and avg([None]) is None
    assert avg([float("nan"), 1.0]) is None and avg([1e30, 1.0]) is None and avg([float("inf")]) is None


def test_a_score_is_never_lost(spark):
    texts = ["9" * 27, "0.1234567890123", "12", "high", "", "Not Available", None, "1.5000000000000"]
    numeric, text, present = split_score("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numeric.alias("n"), text.alias("s"), present.alias("p")).collect()
    for r in rows:
        assert r.p == (r.n is not None or r.s is not None) and not (r.n is not None and r.s is not None)
    assert {r.t: r.s for r in rows}["9" * 27] == "9" * 27
    bronze = {t: spark.createDataFrame([tuple(x if c == "score" else None for c in RAW_COLUMNS[t]) for x in texts], ", ".join(f"{c} string" for c in RAW_COLUMNS[t]))
              for t in TABLES}
    found = {r.table_name: r for r in unread_values(bronze, {}).where(F.col("column_name") == "score").collect()}
    assert {(r.real_values, r.wrong_form, r.beyond_type) for r in found.values()} == {(5, 1, 2)}
