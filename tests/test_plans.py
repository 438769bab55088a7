"""Physical plans: no shuffle in the typed tables, no cross or hinted joins, pruned and pushed scans."""

from __future__ import annotations

import re

import pytest

from caremeter.functions.values import IMAGING_MEASURES
from caremeter.plans import analysis, bronze_checks, explore, gold_checks, silver_checks
from caremeter.plans.gold import gold_view
from caremeter.plans.silver import build_silver
from caremeter.sources.schemas import TABLES
from harness.lake import Lake

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("silver")
    lake = Lake(spark, SF)
    for t in TABLES:
        lake.silver[t].write.parquet(f"{root}/{t}")
    return {t: spark.read.parquet(f"{root}/{t}") for t in TABLES}


def test_silver_builds_do_not_shuffle(spark):
    for t in TABLES:
        text = plan(build_silver(t, Lake(spark, SF).bronze[t]))
        assert "Exchange" not in text and "Python" not in text


def test_views_prune_and_push(stored):
    text = plan(gold_view("vw_imaging_vs_ed_wait", stored))
    scans = dict(re.findall(r"(PushedFilters: \[[^\n]*\])\s*ReadSchema: (struct<[^\n]*>)", text))
    imaging = [s for s in scans.items() if "In(measure_id, [" + ",".join(IMAGING_MEASURES) in s[0]]
    assert len(imaging) == 1 and "EqualTo(is_score_usable,true)" in imaging[0][0].replace("IsNotNull(is_score_usable), ", "")
    columns = re.findall(r"(\w+):", imaging[0][1])
    assert set(columns) == {"facility_id", "measure_id", "score", "is_score_usable", "start_date", "end_date"}


def test_dimension_is_broadcast_only_while_small(spark, stored):
    assert "BroadcastHashJoin" in plan(gold_view("vw_imaging_vs_ed_wait", stored))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(gold_view("vw_imaging_vs_ed_wait", stored))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_checks_scan_each_fact_once(stored):
    text = plan(silver_checks.fact_invariants(stored, stored))
    assert text.count("ReadSchema") == 4


def scans(df) -> int:
    """Scan nodes of the plan that ran; reused exchanges and stages count once."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0].count("FileScan")


def test_inputs_are_read_once(stored):
    assert scans(explore.ed_percentiles(stored)) == 1
    assert scans(analysis.reporting_profiles(stored)) == 1
    views = {"vw_ownership_imaging_ed_stats": gold_view("vw_ownership_imaging_ed_stats", stored)}
    assert scans(gold_checks.ownership_shares(views)) == 3
    assert scans(explore.outcomes_by_category(stored)) == 1


def planned(df) -> int:
    """Scan nodes as planned, subqueries included, before any is reused."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_planned_scans(stored):
    assert planned(explore.survivors_by_ownership(stored)) == 3
    g4 = gold_view("vw_complications_vs_process_care", stored)
    # the rows, and the ranks of both measures (counts and their totals)
    assert planned(g4) == 3 and planned(analysis.process_outcome_quadrants(g4)) <= 3 * planned(g4)


def ordered_by(rows, *keys):
    """Whether rows follow the keys: "-x" descending with NULL first, "x" ascending with NULL last."""
    def place(r):
        return [((r[k[1:]] is not None, -r[k[1:]] if r[k[1:]] is not None else 0) if k[0] == "-" else (r[k] is None, r[k] or 0)
                 if not isinstance(r[k], str) else (False, r[k])) for k in keys]
    return len(rows) > 1 and [place(r) for r in rows] == sorted(place(r) for r in rows)


def test_reports_come_in_their_order(stored):
    assert ordered_by(analysis.ownership_overview(stored).collect(), "-total_hospitals")
    assert ordered_by(analysis.ownership_subtypes(stored).collect(), "ownership_group", "-total_hospitals")
    assert ordered_by(analysis.star_distribution(stored).collect(), "hospital_ownership", "stars")
    assert ordered_by(analysis.peer_ranking(stored).collect(), "rank_by_stars", "facility_name")
    assert ordered_by(analysis.gap_to_five_stars(stored).collect(), "-gap_to_close")
    assert ordered_by(explore.worst_complications(stored).collect(), "-worse_measure_count", "facility_id")
    assert ordered_by(explore.measure_counts(stored).collect(), "-n_measures")


def test_check_reports_come_in_order(spark):
    lake = Lake(spark, "/root/testdata/sf0.001")
    counts = [(r.n_hospitals, r.measure_id) for r in bronze_checks.value_counts(lake.bronze, "timely_care", "measure_id", "n_hospitals").collect()]
    assert counts == sorted(counts, key=lambda r: (-r[0], r[1] is None, r[1])) and len(counts) > 3
    notes = [(r.table_name, r.n) for r in silver_checks.footnote_counts(lake.bronze, lake.silver).collect()]
    assert notes == sorted(notes, key=lambda r: (r[0], -r[1]))
    regions = [r.n for r in gold_checks.region_counts(lake.gold).collect()]
    assert regions == sorted(regions, reverse=True)
    shares = [r.n_hospitals for r in gold_checks.ownership_shares(lake.gold).collect()]
    assert shares == sorted(shares, reverse=True)
