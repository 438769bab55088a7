"""Exploration of the typed tables: inventories, samples, distributions, correlations. ``s`` is silver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from caremeter.functions import values as V
from caremeter.functions.rules import known_states, mean_of, outcome_category, pct, region
from caremeter.operators import checks as C, profiles as P
from caremeter.operators.common import union_all
from caremeter.operators.compare import compare_means, group_stats
from caremeter.operators.ordered import distribution, in_order, top_k
from caremeter.plans.gold import ed_scores, imaging_scores
from caremeter.sources.schemas import FACTS

Tables = Mapping[str, DataFrame]

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def _is_ed():
    return F.col("condition") == V.ED_CONDITION


def _usable(df: DataFrame, score: str) -> DataFrame:
    return df.where(F.col("is_score_usable") & F.col(score).isNotNull())


# ---- measure inventory -----------------------------------------------------------------

def ed_inventory(s: Tables, whole_pct: bool = False) -> DataFrame:
    return P.inventory(s["timely_care"], ["measure_id", "measure_name"], "score_numeric", _is_ed(), whole_pct=whole_pct)


def imaging_inventory(s: Tables, usable_rows_only: bool = False) -> DataFrame:
    """``usable_rows_only=True`` is the variant whose percent is 100 by construction."""
    return P.inventory(s["outpatient_imaging"], ["measure_id", "measure_name"], "score", usable_rows_only=usable_rows_only)


@in_order("condition", "measure_id", "measure_name")
def process_inventory(s: Tables) -> DataFrame:
    out = P.inventory(s["timely_care"], ["condition", "measure_id", "measure_name"], "score_numeric",
                      F.col("condition") != V.ED_CONDITION, avg_usable_only=True, keep_empty=False)
    return out.withColumns({c: F.round(c, 2) for c in ("min_score", "max_score")})


def _rated(s: Tables) -> DataFrame:
    return s["complications"].where(F.col("is_score_usable") & F.col("compared_to_national").isNotNull())


@in_order("category", "compared_to_national")
def outcomes_by_category(s: Tables) -> DataFrame:
    rows = _rated(s).select(outcome_category("measure_id").alias("category"), "compared_to_national")
    return P.share_within(rows, ["category", "compared_to_national"], ["category"], pct_name="pct_within_category")


@in_order("hospital_ownership", "compared_to_national")
def outcomes_by_ownership(s: Tables) -> DataFrame:
    """Outcome shares per ownership; facts reach the join as counts per facility and outcome."""
    counts = _rated(s).groupBy("facility_id", "compared_to_national").agg(F.count("*").alias("__n"))
    by_owner = counts.join(s["hospital_general"].select("facility_id", "hospital_ownership"), "facility_id").groupBy(
        "hospital_ownership", "compared_to_national").agg(F.sum("__n").alias("n_hospitals"))
    return P.with_group_total(by_owner, "n_hospitals", ["hospital_ownership"], "__total").withColumn(
        "pct_of_total_per_ownership", pct(F.col("n_hospitals"), F.col("__total"), 2)).drop("__total")


# ---- sample sizes ----------------------------------------------------------------------

def _ed_and_imaging(s: Tables) -> DataFrame:
    return P.overlap({"ed": _usable(s["timely_care"].where(_is_ed()), "score_numeric"),
                      "imaging": _usable(s["outpatient_imaging"], "score")}, "facility_id")


def sample_overlap(s: Tables) -> DataFrame:
    facilities = s["hospital_general"].agg(F.count("*")).scalar()
    both = F.count_if(F.col("ed") & F.col("imaging"))
    return _ed_and_imaging(s).agg(
        F.count_if("ed").alias("usable_ed"), F.count_if("imaging").alias("usable_imaging"),
        both.alias("usable_with_both")).withColumn(
        "pct_of_all_hospitals", pct(F.col("usable_with_both"), facilities, 2))


def survivors_by_ownership(s: Tables) -> DataFrame:
    """Facilities with both measures per owner, beside the totals of each measure.

    Facts and owners meet in one grouping by facility, and the totals are sums over the counts per owner, so every table
    is read once. A facility counts once in the totals, and once per row of it in the counts of its owners.
    """
    owners = s["hospital_general"].groupBy("facility_id", "hospital_ownership").agg(F.count("*").alias("__rows"))
    none = F.lit(None).cast(T.StructType([owners.schema["hospital_ownership"], owners.schema["__rows"]]))
    records = union_all([
        _usable(s["timely_care"].where(_is_ed()), "score_numeric").select(
            "facility_id", F.lit(True).alias("ed"), F.lit(False).alias("imaging"), none.alias("owner")),
        _usable(s["outpatient_imaging"], "score").select(
            "facility_id", F.lit(False).alias("ed"), F.lit(True).alias("imaging"), none.alias("owner")),
        owners.select("facility_id", F.lit(False).alias("ed"), F.lit(False).alias("imaging"),
                      F.struct("hospital_ownership", "__rows").alias("owner"))])
    # a fact has no owner and adds nothing to the list, which holds the distinct owners of one facility
    facilities = records.where(F.col("facility_id").isNotNull()).groupBy("facility_id").agg(
        F.bool_or("ed").alias("ed"), F.bool_or("imaging").alias("imaging"), F.collect_list("owner").alias("owners"))
    per_owner = facilities.select("ed", "imaging", F.posexplode_outer("owners").alias("place", "owner"))
    once = F.coalesce(F.col("place"), F.lit(0)) == 0
    counts = per_owner.groupBy(F.col("owner.hospital_ownership").alias("hospital_ownership")).agg(
        F.count_if(F.col("ed") & once).alias("usable_ed"), F.count_if(F.col("imaging") & once).alias("usable_imaging"),
        F.sum(F.when(F.col("ed") & F.col("imaging"), F.col("owner.__rows"))).alias("usable_with_both"))
    counts = counts.withColumns({c: P.share_total(counts, c) for c in ("usable_ed", "usable_imaging")}).where(
        (F.col("hospital_ownership") != V.TRIBAL_VALUE) & (F.col("usable_with_both") > 0))
    return counts.select(
        "hospital_ownership", "usable_ed", "usable_imaging", "usable_with_both",
        pct(F.col("usable_with_both"), P.share_total(counts, "usable_with_both"), 2).alias("pct_of_joined_sample"))


def complication_sample(s: Tables, min_rated: int = V.MIN_RATED) -> DataFrame:
    rated = _rated(s).groupBy("facility_id").agg(F.count("*").alias("__n"))
    flags = P.overlap({"comp": rated, "strong": rated.where(F.col("__n") >= min_rated),
                       "ed": _usable(s["timely_care"].where(_is_ed()), "score_numeric")}, "facility_id")
    return flags.agg(
        F.count_if("comp").alias("hospitals_with_comp"), F.count_if("strong").alias("hospitals_with_comp_3plus"),
        F.count_if("ed").alias("hospitals_timely_care"),
        F.count_if(F.col("strong") & F.col("ed")).alias("hospitals_with_both"))


# ---- distributions ---------------------------------------------------------------------

@in_order("measure_id")
def ed_percentiles(s: Tables) -> DataFrame:
    return distribution(_usable(s["timely_care"].where(_is_ed()), "score_numeric"), ["measure_id"], "score_numeric",
                        QUARTILES).drop("avg_val")


@in_order("measure_id", "measure_name")
def imaging_percentiles(s: Tables) -> DataFrame:
    return distribution(_usable(s["outpatient_imaging"], "score"), ["measure_id", "measure_name"], "score",
                        QUARTILES).drop("avg_val")


def imaging_outliers(s: Tables, measure: str = V.IMAGING_OUTLIER, k: int = 50) -> DataFrame:
    """Top-k report; ties are broken by facility and score columns."""
    rows = _usable(s["outpatient_imaging"].where(F.col("measure_id") == measure), "score").select("facility_id", "score")
    dim = s["hospital_general"].select("facility_id", "facility_name", "state", "hospital_type", "hospital_ownership",
                                       "hospital_overall_rating")
    return top_k(rows.join(dim, "facility_id"), [F.desc_nulls_last("score")], k, [F.asc_nulls_last("facility_id")])


@in_order("hospital_ownership", "hospital_overall_rating")
def stars_within_ownership(s: Tables, digits: int = 2) -> DataFrame:
    return P.share_within(s["hospital_general"].where(F.col("hospital_overall_rating").isNotNull()),
                          ["hospital_ownership", "hospital_overall_rating"], ["hospital_ownership"], digits,
                          "n_hospitals", "pct_within_ownership")


# ---- design checks ---------------------------------------------------------------------

@in_order("region", "state")
def state_regions(s: Tables) -> DataFrame:
    rows = s["hospital_general"].select("state", region("state", "UNMAPPED").alias("region"))
    return P.profile_values(rows, ["state", "region"], n="n_hospitals")


def unmapped_states(s: Tables) -> DataFrame:
    return P.profile_distinct(s["hospital_general"].where(~F.col("state").isin(*known_states())), ["state"])


@in_order("measure_id")
def shared_measures(s: Tables) -> DataFrame:
    return C.in_many({t: s[t] for t in FACTS}, "measure_id")


@in_order("-n_measures", "source")
def measure_counts(s: Tables) -> DataFrame:
    return P.distinct_per_table({t: s[t] for t in FACTS}, "measure_id")


@in_order("-availability_usability_gap_pct", "measure_id")
def availability_gap(s: Tables) -> DataFrame:
    return P.usability_gap(s["infections"], ["measure_id"])


# ---- outcomes against process ----------------------------------------------------------

def worst_complications(s: Tables, min_worse: int = V.MIN_RATED, k: int = 50) -> DataFrame:
    """Facilities with the most 'Worse' ratings beside their process scores (left join: may have none)."""
    worse = s["complications"].where(F.col("is_score_usable") & (F.col("compared_to_national") == "Worse")).groupBy(
        "facility_id").agg(F.count("*").alias("worse_measure_count")).where(F.col("worse_measure_count") >= min_worse)
    process = _usable(s["timely_care"].where(F.col("condition") != V.ED_CONDITION), "score_numeric").groupBy(
        "facility_id").agg(F.count("measure_id").alias("__n"), F.sum("score_numeric").alias("__s"), F.count("*").alias("__rows"))
    dim = s["hospital_general"].select("facility_id", "hospital_ownership", "hospital_overall_rating")
    rows = worse.join(dim, "facility_id").join(process, "facility_id", "left").select(
        "facility_id", "hospital_ownership", "hospital_overall_rating", "worse_measure_count",
        F.coalesce("__n", F.lit(0)).alias("process_care_measures"),
        mean_of(F.col("__s"), F.col("__rows"), 2).alias("avg_process_care_score"))
    return top_k(rows, [F.desc("worse_measure_count")], k, [F.asc("facility_id")])


PAIR_NAMES = dict(mean_x="avg_imaging_score", sd_x="sd_imaging", mean_y="avg_ed_wait_minutes", sd_y="sd_ed_wait",
                  r="pearson_r")


def _imaging_and_ed(s: Tables) -> DataFrame:
    return imaging_scores(s["outpatient_imaging"]).join(ed_scores(s["timely_care"]), "facility_id")


def imaging_ed_correlation(s: Tables) -> DataFrame:
    return group_stats(_imaging_and_ed(s), [], *compare_means(
        "avg_imaging_score", "avg_ed_wait_minutes", dict(PAIR_NAMES, n="sample_size", r2="r_squared")))


@in_order("-n_hospitals", "hospital_ownership")
def imaging_ed_by_ownership(s: Tables) -> DataFrame:
    owners = s["hospital_general"].select("facility_id", "hospital_ownership").where(
        F.col("hospital_ownership") != V.TRIBAL_VALUE)
    return group_stats(_imaging_and_ed(s).join(owners, "facility_id"), ["hospital_ownership"], *compare_means(
        "avg_imaging_score", "avg_ed_wait_minutes", dict(PAIR_NAMES, n="n_hospitals")))


