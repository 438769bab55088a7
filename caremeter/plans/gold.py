"""Gold views: lazy DataFrames over silver tables.

Every fact is aggregated to one row per facility before it is joined. Joins carry no hints: the
planner broadcasts the facility table only while its measured size allows it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.functions.rules import exact_avg, region
from caremeter.operators.compare import compare_means, entity_mean, group_stats, outcome_mix
from caremeter.operators.ordered import in_order
from caremeter.sources.store import LayerStore

DIM_COLUMNS = ("facility_id", "facility_name", "hospital_ownership", "hospital_type", "state", "region",
               "hospital_overall_rating")


def dim_hospital(hospital: DataFrame) -> DataFrame:
    return hospital.select(
        "facility_id", "facility_name", "hospital_type", "hospital_ownership", "hospital_ownership_details",
        "state", region("state").alias("region"), "hospital_overall_rating")


def imaging_scores(imaging: DataFrame) -> DataFrame:
    return entity_mean(imaging, "score", F.col("measure_id").isin(*V.IMAGING_MEASURES),
                       "avg_imaging_score", "imaging_measures_used", "imaging")


def ed_scores(timely: DataFrame, cap: float | None = V.ED_WAIT_CAP_MINUTES) -> DataFrame:
    return entity_mean(timely, "score_numeric", F.col("measure_id").isin(*V.ED_WAIT_MEASURES),
                       "avg_ed_wait_minutes", "ed_measures_used", "ed", cap=cap)


def process_scores(timely: DataFrame) -> DataFrame:
    return entity_mean(timely, "score_numeric", F.col("condition").isin(*V.PROCESS_CONDITIONS),
                       "avg_process_care_score", "process_measures_count", "process")


def imaging_vs_ed_wait(hospital: DataFrame, imaging: DataFrame, timely: DataFrame) -> DataFrame:
    joined = (dim_hospital(hospital).join(imaging_scores(imaging), "facility_id")
              .join(ed_scores(timely), "facility_id"))
    return joined.select(
        *DIM_COLUMNS, "avg_imaging_score", "imaging_measures_used", "avg_ed_wait_minutes", "ed_measures_used",
        "imaging_period_start", "imaging_period_end", "ed_period_start", "ed_period_end")


@in_order("-n_hospitals", "hospital_ownership")
def ownership_imaging_ed_stats(hospital: DataFrame, imaging: DataFrame, timely: DataFrame) -> DataFrame:
    """Group statistics by ownership (Tribal left out), the largest group first."""
    view = imaging_vs_ed_wait(hospital, imaging, timely).where(F.col("hospital_ownership") != V.TRIBAL_VALUE)
    return group_stats(view, ["hospital_ownership"], *ownership_stats())


def ownership_stats(r: str | None = None) -> list[Column]:
    """Aggregates of the ownership view; ``r`` names an extra correlation column."""
    names = dict(n="n_hospitals", mean_x="avg_imaging_score", sd_x="stddev_imaging_score",
                 mean_y="avg_ed_wait_minutes", sd_y="stddev_ed_wait_minutes")
    if r:
        names["r"] = r
    return [*compare_means("avg_imaging_score", "avg_ed_wait_minutes", names),
            exact_avg("hospital_overall_rating", 2).alias("avg_star_rating")]


def complications_vs_process_care(hospital: DataFrame, complications: DataFrame, timely: DataFrame) -> DataFrame:
    mix = outcome_mix(complications, V.OUTCOME_PREFIXES, V.MIN_RATED)
    joined = dim_hospital(hospital).join(mix, "facility_id").join(process_scores(timely), "facility_id")
    return joined.select(
        *DIM_COLUMNS, "comp_rated_total", "comp_better", "comp_no_different", "comp_worse", "complication_pct_worse",
        *[c for p in V.OUTCOME_PREFIXES for c in (f"{p}_rated", f"{p}_pct_worse")],
        "avg_process_care_score", "process_measures_count",
        "comp_period_start", "comp_period_end", "process_period_start", "process_period_end")


# view name -> (builder, silver tables it reads)
GOLD_VIEWS = {
    "dim_hospital": (dim_hospital, ("hospital_general",)),
    "vw_imaging_vs_ed_wait": (imaging_vs_ed_wait, ("hospital_general", "outpatient_imaging", "timely_care")),
    "vw_ownership_imaging_ed_stats": (
        ownership_imaging_ed_stats, ("hospital_general", "outpatient_imaging", "timely_care")),
    "vw_complications_vs_process_care": (
        complications_vs_process_care, ("hospital_general", "complications", "timely_care")),
}


def gold_view(name: str, silver: Mapping[str, DataFrame]) -> DataFrame:
    build, tables = GOLD_VIEWS[name]
    return build(*[silver[t] for t in tables])


def register_gold(store: LayerStore) -> list[str]:
    """Temp views over the store's current silver data; they stay lazy. Returns the views whose tables all have data."""
    needed = {t for _, tables in GOLD_VIEWS.values() for t in tables}
    silver = {t: store.read("silver", t) for t in sorted(needed) if store.has("silver", t)}
    found = [name for name, (_, tables) in GOLD_VIEWS.items() if all(t in silver for t in tables)]
    for name in found:
        gold_view(name, silver).createOrReplaceTempView(name)
    return found
