"""Stand-alone analyses. ``s`` is silver; some take the outcome view ``g4``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.functions.rules import completeness_pct, exact_avg, pct, r_squared, reporting_profile, safe_corr, sd
from caremeter.operators import checks as C, profiles as P
from caremeter.operators.compare import compare_means, entity_mean, group_stats, outcome_mix, quadrants
from caremeter.operators.ordered import column_distributions, in_order, peer_rank, pick, sort_rows
from caremeter.operators.peers import gap_to_best, vs_benchmark
from caremeter.plans.explore import stars_within_ownership
from caremeter.plans.gold import imaging_vs_ed_wait, ownership_stats
from caremeter.sources.schemas import FACTS

Tables = Mapping[str, DataFrame]

STARS = "hospital_overall_rating"
PEER_KEYS = ("state", "hospital_ownership", "hospital_type")


def _rated_shares(n: str) -> list[Column]:
    """High (4+) and low (2-) performers among the rated."""
    rated = F.count(STARS)
    high, low = F.count_if(F.col(STARS) >= 4), F.count_if(F.col(STARS) <= 2)
    return [rated.alias(n), high.alias("n_high_performers"), pct(high, rated, 1).alias("pct_high_performers"),
            low.alias("n_low_performers"), pct(low, rated, 1).alias("pct_low_performers")]


# ---- ownership and ratings -------------------------------------------------------------

@in_order("-total_hospitals", "hospital_ownership")
def ownership_overview(s: Tables) -> DataFrame:
    total, rated = F.count("*"), F.count(STARS)
    return s["hospital_general"].where(F.col("hospital_ownership") != V.TRIBAL_VALUE).groupBy("hospital_ownership").agg(
        total.alias("total_hospitals"), (total - rated).alias("hospitals_unrated"), pct(rated, total, 1).alias("pct_rated"),
        exact_avg(STARS, 2).alias("avg_star_rating"), sd(STARS, 2).alias("stddev_rating"), *_rated_shares("hospitals_rated"))


@in_order("hospital_ownership", "stars")
def star_distribution(s: Tables) -> DataFrame:
    return stars_within_ownership(s, digits=1).withColumnRenamed(STARS, "stars")


@in_order("ownership_group", "-total_hospitals", "ownership_subtype")
def ownership_subtypes(s: Tables) -> DataFrame:
    out = s["hospital_general"].groupBy(
        F.col("hospital_ownership").alias("ownership_group"), F.col("hospital_ownership_details").alias("ownership_subtype"))
    return out.agg(F.count("*").alias("total_hospitals"), exact_avg(STARS, 2).alias("avg_rating"),
                   *_rated_shares("rated")).drop("n_high_performers", "n_low_performers")


# ---- completeness and ratings ----------------------------------------------------------

@in_order("stars")
def completeness_by_stars(s: Tables) -> DataFrame:
    rows = s["hospital_general"].where(F.col(STARS).isNotNull()).select(
        F.col(STARS).alias("stars"), completeness_pct().alias("c"))
    return rows.groupBy("stars").agg(
        F.count("*").alias("n_hospitals"), exact_avg("c", 1).alias("avg_completeness_pct"),
        F.min("c").alias("min_completeness_pct"), F.max("c").alias("max_completeness_pct"))


def completeness_correlation(s: Tables) -> DataFrame:
    rows = s["hospital_general"].where(F.col(STARS).isNotNull()).select(STARS, completeness_pct().alias("c"))
    return rows.agg(F.count("*").alias("n"), F.round(safe_corr("c", STARS), 4).alias("pearson_r"),
                    F.round(r_squared("c", STARS), 4).alias("r_squared"))


@in_order("-n_hospitals", "reporting_profile")
def reporting_profiles(s: Tables) -> DataFrame:
    rows = s["hospital_general"].select(reporting_profile().alias("reporting_profile"), STARS)
    return P.share_within(rows, ["reporting_profile"], digits=1, n="n_hospitals", pct_name="pct_of_total", extra=[
        exact_avg(STARS, 2).alias("avg_star_rating"), F.count(STARS).alias("rated_hospitals")])


# ---- infections, complications, process ------------------------------------------------

def infections_vs_complications(s: Tables) -> DataFrame:
    ratios = entity_mean(s["infections"], "score", F.col("measure_suffix") == V.INFECTION_RATIO_SUFFIX,
                         "avg_sir", "sir_measures_used")
    outcomes = outcome_mix(s["complications"], {}, V.MIN_RATED).select("facility_id", "complication_pct_worse")
    names = dict(n="sample_size", mean_x="avg_sir", sd_x="sd_sir", mean_y="avg_complication_pct_worse",
                 sd_y="sd_complication_pct_worse", r="pearson_r", r2="r_squared")
    return group_stats(
        ratios.join(outcomes, "facility_id"), [], *compare_means("avg_sir", "complication_pct_worse", names, digits=(3, 2)))


def process_outcome_distribution(g4: DataFrame) -> DataFrame:
    process, worse, mort = "avg_process_care_score", "complication_pct_worse", "mort_pct_worse"
    stats = column_distributions(g4, [process, worse, mort], {"median": 0.5})
    return stats.agg(
        F.coalesce(pick("n", process), F.lit(0)).alias("n_hospitals"),
        pick("avg_val", process).alias("avg_process_compliance"),
        pick("avg_val", worse).alias("avg_complication_pct_worse"), pick("avg_val", mort).alias("avg_mort_pct_worse"),
        pick("median", process).alias("median_process_compliance"),
        pick("median", worse).alias("median_complication_pct_worse"), pick("median", mort).alias("median_mort_pct_worse"),
        pick("min_val", process).alias("min_process_compliance"), pick("max_val", process).alias("max_process_compliance"),
        pick("min_val", worse).alias("min_complication_pct_worse"), pick("max_val", worse).alias("max_complication_pct_worse"))


def process_outcome_correlations(g4: DataFrame) -> DataFrame:
    process = "avg_process_care_score"
    return g4.agg(
        F.count("*").alias("n_hospitals"),
        *[F.round(safe_corr(process, c), 4).alias(f"r_process_vs_{name}") for name, c in
          (("complications", "complication_pct_worse"), ("mortality", "mort_pct_worse"), ("psi", "psi_pct_worse"))],
        F.round(r_squared(process, "complication_pct_worse"), 4).alias("r_squared_overall"),
        F.round(r_squared(process, "mort_pct_worse"), 4).alias("r_squared_mortality"))


# ---- one entity against its peers ------------------------------------------------------

def entity_profile(s: Tables, name_pattern: str) -> DataFrame:
    return s["hospital_general"].where(F.col("facility_name").ilike(name_pattern)).select(
        "facility_id", "facility_name", "city", "state", "hospital_type", "hospital_ownership",
        F.col(STARS).alias("stars"), "emergency_services", *[f"{g}_reporting_status" for g in V.MEASURE_GROUPS])


def entity_outcomes(s: Tables, facility: str) -> DataFrame:
    """Every complication row of one facility, rated rows first."""
    rows = s["complications"].where(F.col("facility_id") == facility).select(
        "measure_id", "measure_name", "score", "compared_to_national", "is_score_usable", "score_exclusion_reason")
    return sort_rows(rows, "compared_to_national", "measure_id")


@in_order("measure_id", "facility_id")
def ed_waits_vs_state(s: Tables, facility: str | None = None) -> DataFrame:
    """Waits beside the state average; the average has no 24-hour cap. No ``facility``: all of them."""
    return vs_benchmark(s["timely_care"], s["hospital_general"], "score_numeric", V.ED_WAIT_MEASURES,
                        ("wait_minutes", "state_avg_wait", "vs_state_diff"), entity=facility, digits=1)


@in_order("measure_id", "facility_id", "measure_name")
def imaging_vs_state(s: Tables, facility: str | None = None) -> DataFrame:
    return vs_benchmark(s["outpatient_imaging"], s["hospital_general"], "score", V.IMAGING_MEASURES,
                        ("own_score", "state_avg_score", "vs_state_diff"), entity=facility, digits=2,
                        extra=("measure_name",))


@in_order("rank_by_stars", "facility_name", "facility_id")
def peer_ranking(s: Tables, within=PEER_KEYS, peers: Column | None = None) -> DataFrame:
    """Rank by stars inside each peer group, or inside the one group that ``peers`` selects."""
    rows = s["hospital_general"] if peers is None else s["hospital_general"].where(peers)
    cols = ["facility_id", "facility_name", STARS, *[f"{g}_reporting_status" for g in ("mort", "safety", "readm")]]
    ranked = peer_rank(rows.select(*within, *[c for c in cols if c not in within]), STARS, within, "rank_by_stars")
    return ranked.withColumnRenamed(STARS, "stars")


@in_order("-gap_to_close", "measure_id", "facility_id")
def gap_to_five_stars(s: Tables, facility: str | None = None, measures=None) -> DataFrame:
    measures = measures or V.GAP_MEASURES
    return gap_to_best({t: s[t] for t in measures}, s["hospital_general"], measures, F.col(STARS) == 5,
                       PEER_KEYS, facility)


# ---- further results -------------------------------------------------------------------

def process_outcome_quadrants(g4: DataFrame) -> DataFrame:
    return quadrants(g4, "avg_process_care_score", "complication_pct_worse")


def unusable_by_state(s: Tables) -> DataFrame:
    rows = C.stack_facts({t: s[t] for t in FACTS}, ["state", "is_score_usable"])
    unusable = F.count_if(~F.col("is_score_usable"))
    return rows.groupBy("state").agg(F.count("*").alias("total_rows"), unusable.alias("unusable_rows"),
                                     pct(unusable, F.count("*"), 1).alias("pct_unusable"))


def full_infection_reporters(s: Tables, measures: int = V.INFECTION_MEASURE_COUNT) -> DataFrame:
    """Facilities with a usable ratio on every infection measure, among all facilities."""
    usable = s["infections"].where((F.col("measure_suffix") == V.INFECTION_RATIO_SUFFIX) & F.col("is_score_usable"))
    full = usable.groupBy("facility_id").agg(F.count_distinct("measure_id").alias("n")).where(F.col("n") >= measures)
    total = s["hospital_general"].agg(F.count("*")).scalar()
    return full.agg(F.count("*").alias("full_reporters")).select(
        "full_reporters", total.alias("n_hospitals"), pct(F.col("full_reporters"), total, 1).alias("pct_full_reporters"))


def unrated_by_type(s: Tables) -> DataFrame:
    unrated = F.count_if(F.col(STARS).isNull())
    return s["hospital_general"].groupBy("hospital_type").agg(
        F.count("*").alias("n_hospitals"), unrated.alias("n_unrated"), pct(unrated, F.count("*"), 1).alias("pct_unrated"))


def ownership_stats_with_r(s: Tables) -> DataFrame:
    view = imaging_vs_ed_wait(s["hospital_general"], s["outpatient_imaging"], s["timely_care"])
    return group_stats(view.where(F.col("hospital_ownership") != V.TRIBAL_VALUE), ["hospital_ownership"],
                       *ownership_stats("pearson_r"))
