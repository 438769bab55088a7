"""The verdict suite: one scan a table, and a broken row turns exactly its check."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caremeter.operators import suite
from caremeter.operators.suite import RowRule, Source, GroupRule, verdicts
from caremeter.plans.expectations import expectations, failed
from caremeter.plans.silver import build_silver
from caremeter.sources.schemas import RAW_COLUMNS, TABLES
from test_load import ROWS, fact, facility

MEASURES = {"timely_care": "OP_22", "complications": "PSI_03", "outpatient_imaging": "OP-10", "infections": "HAI_1_SIR"}
GOOD = {"hospital_general": [facility(i, emergency_services="Yes") for i in (1, 2, 3)]}
GOOD |= {t: [fact(i, m, "1") for i in (1, 2)] + [fact(3, m, "Not Available", footnote="5, 13")] for t, m in MEASURES.items()}
GOOD["infections"] = [fact(i, f"HAI_{k}_SIR", "0.5") for i in (1, 2) for k in range(36)]


def layers(spark, folder, rows):
    bronze, silver = {}, {}
    for t in TABLES:
        made = spark.createDataFrame([tuple(r.get(c) for c in RAW_COLUMNS[t]) for r in rows[t]], ", ".join(f"{c} string" for c in RAW_COLUMNS[t]))
        made.write.parquet(f"{folder}/bronze/{t}")
        bronze[t] = spark.read.parquet(f"{folder}/bronze/{t}")
        build_silver(t, bronze[t]).write.parquet(f"{folder}/silver/{t}")
        silver[t] = spark.read.parquet(f"{folder}/silver/{t}")
    return bronze, silver


@pytest.fixture(scope="module")
def good(spark, tmp_path_factory):
    return layers(spark, tmp_path_factory.mktemp("good"), GOOD)


def wrong(b, s):
    return {(r.check_name, r.table_name, r.metric): r.value for r in expectations(b, s).collect() if r.ok is False}


def test_good_tables_hold_and_each_is_read_once(good):
    b, s = good
    rows = expectations(b, s).collect()
    assert wrong(b, s) == {} and failed(b, s).count() == 0
    assert [r.check_name for r in rows] == sorted(r.check_name for r in rows)
    assert {r.value for r in rows if r.metric == "raw_rows"} == {3, 72} and {r.ok for r in rows if r.severity == "info"} == {None}
    assert len({r.check_name for r in rows}) >= 22 and len(rows) == len({(r.check_name, r.table_name, r.metric) for r in rows})
    physical = expectations(b, s)._jdf.queryExecution().executedPlan().toString()
    initial = physical.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan parquet") == 10 and "CartesianProduct" not in physical and "Python" not in physical


def changed(df, condition, **values):
    """``df`` with some columns of the rows that meet ``condition`` replaced."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(condition, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


BROKEN = {
    ("C00", "complications", "over_declared_length"): ("silver", dict(measure_name="x" * 5000)),
    ("C02", "timely_care", "null_facility_id"): ("silver", dict(facility_id=None)),
    ("C06", "hospital_general", "ownership_outside_set"): ("silver", dict(hospital_ownership="Unknown", hospital_ownership_details=None)),
    ("C06", "hospital_general", "rating_outside_set"): ("silver", dict(hospital_overall_rating=6)),
    ("C07", "hospital_general", "ownership_not_as_mapped"): ("silver", dict(hospital_ownership="Tribal")),
    ("C08", "hospital_general", "birthing_friendly_false"): ("silver", dict(birthing_friendly_designation=False)),
    ("C09", "hospital_general", "status_against_code"): ("silver", dict(te_group_footnote="22")),
    ("C10", "complications", "comparison_outside_set"): ("silver", dict(compared_to_national="Equal")),
    ("C10", "infections", "unlabelled_comparison"): ("bronze", dict(compared_to_national="Not Different")),
    ("C12", "outpatient_imaging", "unusable_score_without_reason"): ("silver", dict(is_score_usable=False)),
    ("C14", "timely_care", "number_and_text"): ("silver", dict(score_text="high")),
    ("C15", "outpatient_imaging", "negative_score"): ("silver", dict(score=Decimal("-1"))),
    ("C16", "complications", "unread_values"): ("bronze", dict(denominator="9" * 30)),
    ("C19", "outpatient_imaging", "period_out_of_range"): ("silver", dict(start_date=date(1066, 1, 1))),
    ("C20", "timely_care", "inverted_dates"): ("silver", dict(start_date=date(2025, 1, 1))),
    ("C21", "infections", "measure_without_suffix"): ("silver", dict(measure_suffix=None)),
    ("C33", "timely_care", "id_length_differs"): ("bronze", dict(facility_id=" 000001")),
    ("C34", "hospital_general", "unmapped_state"): ("silver", dict(state="XX")),
}


def test_a_broken_row_turns_its_check_alone(good):
    """All breaks at once, each in one row: every check counts its own row and no other check moves."""
    sides = {"bronze": dict(good[0]), "silver": dict(good[1])}
    for (_, table, metric), (layer, values) in sorted(BROKEN.items(), key=lambda item: "facility_id" in item[1][1]):
        if metric != "ownership_not_as_mapped":
            sides[layer][table] = changed(sides[layer][table], F.col("facility_id") == "000001", **values)
    # a label that no rule gives is not what the mapping gives either
    assert wrong(sides["bronze"], sides["silver"]) == {check: 36 if check[1] == "infections" else 1 for check in BROKEN}
    mapped = ("C07", "hospital_general", "ownership_not_as_mapped")
    b, s = good
    other = changed(s["hospital_general"], F.col("facility_id") == "000001", **BROKEN[mapped][1])
    assert wrong(b, {**s, "hospital_general": other}) == {mapped: 1}


def test_rules_over_keys_and_tables(good):
    b, s = good
    for t in ("hospital_general", "timely_care"):
        twice = wrong(b, {**s, t: s[t].unionByName(s[t].where("facility_id = '000002'"))})
        assert twice == {("C01", t, "row_count_difference"): 1, ("C03", t, "repeated_keys"): 1}
    lost = wrong(b, {**s, "complications": changed(s["complications"], F.col("facility_id") == "000001", score=None, is_score_usable=False)})
    assert lost == {("C16", "complications", "lost_scores"): 1}
    strange = wrong({t: (changed(b[t], F.col("facility_id") == "000002", facility_id="999999") if t == "infections" else b[t]) for t in TABLES},
                    {t: (changed(s[t], F.col("facility_id") == "000002", facility_id="999999") if t == "infections" else s[t]) for t in TABLES})
    assert strange == {("C05", "infections", "orphan_ids"): 1}
    fewer = wrong({**b, "infections": b["infections"].where("measure_id <> 'HAI_3_SIR'")}, {**s, "infections": s["infections"].where("measure_id <> 'HAI_3_SIR'")})
    assert fewer == {("C30", "infections", "odd_group_sizes"): 2}
    usable = {r.metric: r.value for r in expectations(b, s).collect()}
    assert usable["entities_without_usable_score"] == 1


def test_empty_layers_hold(spark, good):
    b, s = ({t: df.limit(0) for t, df in side.items()} for side in good)
    assert wrong(b, s) == {} and all(r.value == 0 for r in expectations(b, s).collect())


def test_source_rows_of_the_load_test_raise_what_they_should(spark, tmp_path):
    b, s = layers(spark, tmp_path, ROWS)
    assert ("C03", "infections", "repeated_keys") in wrong(b, s) and ("C05", "timely_care", "orphan_ids") in wrong(b, s)
    assert not [k for k in wrong(b, s) if k[0] in ("C01", "C02", "C11", "C13", "C14", "C17", "C20")]


def test_a_hot_entity_is_combined_before_the_shuffle(spark):
    """The planner's own interface: half of all rows belong to one entity and break a rule."""
    rows = spark.range(20_000).select((F.col("id") % 2 * F.col("id")).cast("string").alias("e"), F.col("id").cast("string").alias("p"))
    source = Source("t", "typed", rows, ("e", "p"), [RowRule("R1", "zero", F.col("e") == "0"), RowRule("R2", "none", F.lit(None).cast("boolean"))])
    out = {r.metric: (r.value, r.ok) for r in verdicts([source], "t", [GroupRule("R3", "t", "rows", F.col("t_typed"), at_most=19_999),
                                                                         GroupRule("R4", "t", "repeated", F.col("t_repeated"))]).collect()}
    assert out == {"zero": (10_000, False), "none": (0, True), "rows": (20_000, False), "repeated": (0, True)}


def test_rules_are_compiled_and_worked_out_once(spark):
    """No lambda and no rule inside the generator (both are interpreted), and no filter that repeats the rules."""
    rows = spark.createDataFrame([("a", "x")], "facility_id string, measure_id string")
    rules = [suite.RowRule("C", "m", F.col("measure_id").rlike("^x+$"))]
    records = suite._records(suite.Source("t", "raw", rows, ("facility_id", "measure_id"), rules), 0, 0)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert plan.count("RLIKE") == 1 and "RLIKE" not in generate and "lambda" not in plan
    assert sorted((r.rule, r.broken) for r in records.collect()) == [(-1, 0), (0, 1)]
