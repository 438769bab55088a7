"""Edge rows of the cleaning rules: input text -> expected value."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest

from caremeter.functions.rules import region, safe_corr
from caremeter.functions.text import has_code, last_token, parse_codes, split_score, to_date_mdy, to_decimal, to_int
from caremeter.functions import values as V
from caremeter.functions.values import MEASURE_GROUPS
from caremeter.plans.silver import build_silver
from caremeter.sources.schemas import RAW_COLUMNS, SILVER_SCHEMAS, TABLES, bronze_schema
from pyspark.sql import functions as F


def raw(spark, table, *rows):
    names = RAW_COLUMNS[table]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], bronze_schema(table))


def silver(spark, table, *rows):
    """Typed rows in input order (facility_id is set to the row number unless given)."""
    numbered = [{"facility_id": f"{i:06d}", **r} for i, r in enumerate(rows)]
    return sorted(build_silver(table, raw(spark, table, *numbered)).collect(), key=lambda r: r.facility_id)


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select(column.alias("out"), "i").orderBy("i").collect()]


def test_codes_are_matched_whole(spark):
    for wanted, note, expected in [
        ("1", "13", False), ("1", "1, 5", True), ("5", "1, 5", True), ("3", " 3 ,13", True), ("1", None, False),
        ("1", "", False), ("13", "3, 13", True), ("22", "5, 19, 22, 23", True)]:
        assert values(spark, has_code(parse_codes("v"), [wanted]), [note]) == [expected], (wanted, note)
    df = spark.createDataFrame([("1, 5",)], "v string").withColumn("codes", parse_codes("v"))
    assert df.select(has_code("codes", ["5"])).first()[0] is True


# score, footnote, table -> usable, reason
USABILITY = [
    ("Not Available", "3, 13", "timely_care", False, "Not Applicable"),
    ("12.5", None, "timely_care", True, None),
    ("12.5", "", "timely_care", True, None),
    ("7", "11", "complications", True, "Use With Caution"),
    (None, "8", "infections", False, "No Score - Zero Infections"),
    ("3", "8", "timely_care", False, None),
    ("3", "8, 3", "infections", False, "No Score - Zero Infections"),
    ("3", "3 , 8", "infections", False, "No Score - Zero Infections"),
    ("3", "3, 13", "infections", False, "Not Applicable"),
    ("3", "13, 3", "outpatient_imaging", False, "Not Applicable"),
    ("3", "28, 5", "complications", False, "No Score"),
    (None, None, "timely_care", False, "No Score"),
    ("", None, "timely_care", False, "No Score"),
    ("N/A", None, "complications", False, "No Score"),
    ("Not Available", "", "outpatient_imaging", False, "No Score"),
    ("very high", None, "timely_care", True, None),
    ("very high", None, "outpatient_imaging", True, None),
]


def test_usability_and_reason(spark):
    for table in ("timely_care", "complications", "outpatient_imaging", "infections"):
        cases = [c for c in USABILITY if c[2] == table]
        rows = silver(spark, table, *[{"score": s, "footnote": f} for s, f, *_ in cases])
        for (score, note, _, usable, reason), row in zip(cases, rows):
            assert (row.is_score_usable, row.score_exclusion_reason) == (usable, reason), (score, note, table)


def test_rules_hold_on_random_rows(spark):
    """Code order never matters, and the invariants of the check suite hold for any mix of text."""
    rng = random.Random(11)
    all_codes = "1 2 3 4 5 7 8 11 12 13 16 19 22 23 28 29".split()
    scores = [None, "", "N/A", "Not Available", "very high", "3", "12.5", "-1", " 7", "0"]
    cases = []
    for _ in range(400):
        codes = rng.sample(all_codes, rng.randint(0, 4))
        cases.append((rng.choice(scores), codes, rng.choice([", ", ",", " , "]).join(codes) if codes else rng.choice([None, ""])))
    tiers = [({"1", "4", "5"}, "No Score"), ({"7", "12", "13"}, "Not Applicable"), ({"2", "3", "11", "23", "28", "29"}, "Use With Caution")]
    for table in ("timely_care", "infections"):
        rows = silver(spark, table, *[{"score": s, "footnote": f} for s, _, f in cases])
        assert len(rows) == len(cases)
        for (score, codes, note), row in zip(cases, rows):
            missing = score in (None, "", "N/A", "Not Available")
            ladder = ([({"8"}, "No Score - Zero Infections")] if table == "infections" else []) + tiers
            reason = next((label for wanted, label in ladder if wanted & set(codes)), "No Score" if missing else None)
            usable = not missing and not set(codes) & set(V.BLOCKED_CODES)
            assert (row.score_available, row.is_score_usable, row.score_exclusion_reason) == (not missing, usable, reason), (score, note)
            if table == "timely_care":
                assert row.score_numeric is None or row.score_text is None
                assert (row.score_numeric is None and row.score_text is None) == missing


def test_score_split(spark):
    texts = ["very high", "12.", "007", " 12", "-3", "1,234", "12\n", None, "", "N/A", "Not Available", "85.5", "1.2.3"]
    numeric, text, available = (values(spark, c, texts) for c in split_score("v"))
    assert numeric == [None, Decimal(12), Decimal(7), None, None, None, None, None, None, None, None, Decimal("85.5"), None]
    assert text == ["very high", None, None, " 12", "-3", "1,234", "12\n", None, None, None, None, None, "1.2.3"]
    assert available == [True] * 7 + [False] * 4 + [True] * 2
    numeric, text, available = (values(spark, c, ["1234567890123", "0.1234567"]) for c in split_score("v"))
    assert (numeric, text, available) == ([Decimal("1234567890123"), Decimal("0.1234567")], [None, None], [True, True])
    row = silver(spark, "outpatient_imaging", {"score": "very high"})[0]
    assert (row.score, row.score_available, row.is_score_usable) == (None, True, True)


def test_casts(spark):
    assert values(spark, to_int("v"), ["7", "007", "99999999999", "", None, "-1", "1.0", "5\n"]) == [
        7, 7, 99999999999, None, None, None, None, None]
    assert values(spark, to_decimal("v"), ["1.25", "1234567890123", "0.1234567", "9" * 27, "abc"]) == [
        Decimal("1.25"), Decimal("1234567890123"), Decimal("0.1234567"), None, None]
    assert values(spark, to_date_mdy("v"), ["01/31/2025", "", "2025-01-31", "02/31/2025", "01/31/2025 x", None, "1/3/2025"]) == [
        date(2025, 1, 31), None, None, None, date(2025, 1, 31), None, None]
    assert values(spark, last_token("v"), ["HAI_1_SIR", "X_", "plain"]) == ["SIR", None, "plain"]


def test_comparison_wording(spark):
    texts = ["Better Than the National Rate", "Better than National Benchmark", "No Different Than the National Rate",
             "Not Different Than National Rate", "WORSE than the National Rate", "Not Available", None]
    rows = silver(spark, "complications", *[{"compared_to_national": t} for t in texts])
    assert [r.compared_to_national for r in rows] == ["Better", "Better", "No Different", None, "Worse", None, None]


def test_facility_columns(spark):
    owners = ["Government - Local", "Veterans Health Administration", "Department of Defense", "Voluntary non-profit - Church",
              "Proprietary", "Physician", "Tribal", " Tribal", None]
    rows = silver(spark, "hospital_general", *[{"hospital_ownership": o} for o in owners])
    assert [r.hospital_ownership for r in rows] == [
        "Government", "Government", "Government", "Non-Profit", "For-Profit", "For-Profit", "Tribal", "Other", "Other"]
    assert rows[7].hospital_ownership_details == "Tribal"
    rows = silver(spark, "hospital_general", *[{"birthing_friendly_designation": b, "emergency_services": e} for b, e in
                                               [(None, "Yes"), ("Y", "No"), ("N", None)]])
    assert [(r.birthing_friendly_designation, r.emergency_services) for r in rows] == [(None, True), (True, False), (None, None)]
    row = silver(spark, "hospital_general", {"facility_id": " 01 ", "state": " pa ", "hospital_overall_rating": "Not Available"})[0]
    assert (row.facility_id, row.state, row.hospital_overall_rating) == ("01", "PA", None)
    assert values(spark, region("v"), ["PA", "XX", None, "PR", "HI"]) == ["Northeast", "Unknown", "Unknown", "Territory", "West"]


STATUS = [
    ("7", "7", None, "Fully Rated"), ("3", "7", None, "Partially Rated"), ("0", "7", None, "Not Rated"),
    ("Not Available", "7", None, "Not Rated"), ("0", "0", None, "Fully Rated"), ("7", "7", "5, 23", "Data Quality Issue"),
    ("7", "7", "5, 19, 22, 23", "Federal (DoD, VA)"), ("7", "7", "23, 19", "Not Participating"),
    ("7", "7", "5", "Insufficient Data"), ("99999999999", "7", "", "Partially Rated"), ("3", None, "16", "Partially Rated"),
]


@pytest.mark.parametrize("group", list(MEASURE_GROUPS))
def test_group_status_and_flags(spark, group):
    rows = silver(spark, "hospital_general", *[
        {f"facility_{group}_measure_count": own, f"{group}_group_measure_count": all_, f"{group}_group_footnote": note}
        for own, all_, note, _ in STATUS])
    tests_data_issue = MEASURE_GROUPS[group][1]
    for (own, all_, note, status), row in zip(STATUS, rows):
        if status == "Data Quality Issue" and not tests_data_issue:
            status = "Insufficient Data"
        assert row[f"{group}_reporting_status"] == status, (group, own, all_, note)
        codes = [c.strip() for c in (note or "").split(",")]
        assert row[f"{group}_not_reported"] == ("5" in codes)
        assert row[f"{group}_data_issue"] == (tests_data_issue and "23" in codes)
    lone = silver(spark, "hospital_general", {f"{group}_group_footnote": "23", f"facility_{group}_measure_count": "3"})[0]
    assert lone[f"{group}_reporting_status"] == ("Data Quality Issue" if tests_data_issue else "Partially Rated")


def test_silver_schemas(spark):
    for table in TABLES:
        built = build_silver(table, raw(spark, table, {})).schema
        assert [(f.name, f.dataType) for f in built] == [(f.name, f.dataType) for f in SILVER_SCHEMAS[table]]
        assert "telephone_number" not in built.names


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", None, 9.0)],
                               "g string, x double, y double")
    out = {r.g: (r.r, r.sd) for r in df.groupBy("g").agg(safe_corr("x", "y").alias("r"), F.stddev_samp("x").alias("sd")).collect()}
    assert out["a"] == (None, 0.0) and out["b"] == (None, None)
    assert abs(out["c"][0] - 1) < 1e-12
