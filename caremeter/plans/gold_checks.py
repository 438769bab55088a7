"""Checks of the gold views. ``g`` maps view names to DataFrames, ``s`` is silver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.functions.rules import pct
from caremeter.operators import checks as C, profiles as P
from caremeter.operators.ordered import by_counts, in_order, top_k

Tables = Mapping[str, DataFrame]


@by_counts
def view_counts(g: Tables) -> DataFrame:
    return C.row_counts(g, "view_name", "n_rows")


@by_counts
def region_counts(g: Tables) -> DataFrame:
    return P.profile_values(g["dim_hospital"], ["region"])


def excluded_but_usable(s: Tables, measure: str = V.IMAGING_OFF_SCALE) -> DataFrame:
    """Usable rows of the measure that the composite leaves out on purpose."""
    rows = s["outpatient_imaging"].where(
        (F.col("measure_id") == measure) & F.col("is_score_usable") & F.col("score").isNotNull())
    return rows.agg(F.count("*").alias("usable_rows_excluded")).select(
        F.lit(f"{measure} excluded").alias("check_name"), "usable_rows_excluded")


def view_sample(g: Tables, k: int = 3) -> DataFrame:
    """First rows by id: the limit is the feature, and the order makes it repeatable."""
    view = g["vw_imaging_vs_ed_wait"].select(
        "facility_id", "facility_name", "avg_imaging_score", "imaging_measures_used", "avg_ed_wait_minutes",
        "ed_measures_used")
    return top_k(view, [F.asc_nulls_last("facility_id")], k)


@by_counts
def composite_inputs(s: Tables, facility: str) -> DataFrame:
    """Rows behind one facility's two composites."""
    def rows(table, score, measures):
        return s[table].where((F.col("facility_id") == facility) & F.col("measure_id").isin(*measures)
                              & F.col("is_score_usable") & F.col(score).isNotNull()).select(
            "facility_id", "measure_id", F.col(score).alias("score"))
    return rows("outpatient_imaging", "score", V.IMAGING_MEASURES).unionByName(
        rows("timely_care", "score_numeric", V.ED_WAIT_MEASURES))


@in_order("-n_hospitals", "hospital_ownership")
def ownership_shares(g: Tables) -> DataFrame:
    stats = g["vw_ownership_imaging_ed_stats"]
    return stats.select(
        "hospital_ownership", "n_hospitals",
        pct(F.col("n_hospitals"), P.share_total(stats, "n_hospitals"), 2).alias("pct_of_sample"),
        "avg_imaging_score", "stddev_imaging_score", "avg_ed_wait_minutes", "stddev_ed_wait_minutes")


def pct_worse_bounds(g: Tables) -> DataFrame:
    return C.pct_bounds(g["vw_complications_vs_process_care"], "complication_pct_worse")
