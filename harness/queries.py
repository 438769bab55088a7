"""Registered queries: the library's reports over the provider tables of one driver directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caremeter.plans import analysis as N, bronze_checks as B, expectations as X, explore as E, gold_checks as G, silver_checks as S
from caremeter.sources.schemas import FACTS, RAW_COLUMNS, SILVER_SCHEMAS
from harness.direct import DIRECT
from harness.lake import Lake, comparable
from harness.oracle import SPOT_IDS

STARS = "hospital_overall_rating"
NAME_PATTERN = "%#%99 machinery%"
FACILITY = "000012"

REPORTS: dict[str, Callable[[Lake], DataFrame]] = {
    **{f"t_silver_{t}": lambda k, t=t: k.silver[t] for t in SILVER_SCHEMAS},
    **{f"s_bronze_{t}": lambda k, t=t: k.bronze[t] for t in RAW_COLUMNS},
    # bronze profiles
    "c24_bronze_row_counts": lambda k: B.table_counts(k.bronze),
    "c03_repeated_facilities": lambda k: B.repeated_facilities(k.bronze),
    **{f"c04_duplicate_rows_{t}": lambda k, t=t: B.duplicate_rows(k.bronze, t) for t in FACTS},
    "c25_c33_column_report": lambda k: B.column_report(k.bronze),
    "c25_missing_scores": lambda k: B.missing_scores(k.bronze),
    **{f"c26_odd_scores_{t}": lambda k, t=t: B.odd_scores(k.bronze, t) for t in ("timely_care", "outpatient_imaging")},
    **{f"c27_distinct_{c}": lambda k, t=t, c=c: B.distinct_values(k.bronze, t, c) for t, c in (
        ("hospital_general", STARS), ("hospital_general", "hospital_type"), ("hospital_general", "hospital_ownership"),
        ("hospital_general", "emergency_services"), ("hospital_general", "birthing_friendly_designation"),
        ("timely_care", "condition"), ("infections", "measure_id"))},
    "c27_distinct_start_dates": lambda k: B.distinct_values(k.bronze, "timely_care", "start_date"),
    "c27_distinct_end_dates": lambda k: B.distinct_values(k.bronze, "complications", "end_date"),
    "c28_hospital_type_counts": lambda k: B.value_counts(k.bronze, "hospital_general", "hospital_type"),
    "c28_ownership_counts": lambda k: B.value_counts(k.bronze, "hospital_general", "hospital_ownership"),
    "c28_timely_measure_counts": lambda k: B.value_counts(k.bronze, "timely_care", "measure_id", "n_hospitals"),
    "c28_complication_measure_counts": lambda k: B.value_counts(k.bronze, "complications", "measure_id", "n_hospitals"),
    "c28_imaging_measure_counts": lambda k: B.value_counts(k.bronze, "outpatient_imaging", "measure_id", "n_measure_id"),
    "c28_complication_comparisons": lambda k: B.value_counts(k.bronze, "complications", "compared_to_national", "n_of_appearances"),
    "c28_infection_comparisons": lambda k: B.value_counts(k.bronze, "infections", "compared_to_national", "n_of_times"),
    "c28_rows_per_facility": lambda k: B.value_counts(k.bronze, "infections", "facility_id", "n_per_id"),
    "c29_footnote_coverage": lambda k: B.footnote_coverage(k.bronze),
    "c22_group_footnotes": lambda k: B.group_footnote_codes(k.bronze),
    "c22_bronze_footnotes": lambda k: B.footnotes(k.bronze),
    "c30_odd_infection_counts": lambda k: B.odd_infection_counts(k.bronze),
    "c31_text_date_range": lambda k: B.text_date_range(k.bronze),
    "c32_join_match_count": lambda k: B.join_match_counts(k.bronze),
    "c33_id_lengths": lambda k: B.id_lengths(k.bronze),
    # the checks of both layers as one suite
    "c00_c38_expectations": lambda k: X.expectations(k.bronze, k.silver),
    # silver validation
    "c01_count_parity": lambda k: S.count_parity(k.bronze, k.silver),
    "c02_null_keys": lambda k: S.null_keys(k.bronze, k.silver),
    "c03_duplicate_pairs": lambda k: S.duplicate_pairs(k.bronze, k.silver),
    "c05_orphan_ids": lambda k: S.orphan_ids(k.bronze, k.silver),
    "c11_c12_c17_c20_fact_invariants": lambda k: S.fact_invariants(k.bronze, k.silver),
    "c00_text_lengths": lambda k: S.text_lengths(k.bronze, k.silver),
    "c06_ownership_domain": lambda k: S.domain(k.bronze, k.silver, "hospital_ownership"),
    "c06_rating_domain": lambda k: S.domain(k.bronze, k.silver, STARS),
    "c06_type_domain": lambda k: S.domain(k.bronze, k.silver, "hospital_type"),
    "c07_ownership_mapping": lambda k: S.ownership_mapping(k.bronze, k.silver),
    "c08_boolean_profile": lambda k: S.boolean_profile(k.bronze, k.silver),
    "c09_status_by_footnote": lambda k: S.status_by_footnote(k.bronze, k.silver),
    "c06_comparison_counts": lambda k: S.comparison_counts(k.bronze, k.silver),
    "c10_comparison_variants": lambda k: S.comparison_variants(k.bronze, k.silver),
    "c10_unmatched_comparisons": lambda k: S.unmatched_comparisons(k.bronze, k.silver),
    "c13_multi_code_tiers": lambda k: S.multi_code_tiers(k.bronze, k.silver),
    "c14_score_split": lambda k: S.score_split(k.bronze, k.silver),
    "c15_score_ranges": lambda k: S.score_ranges(k.bronze, k.silver),
    "c16_lost_scores": lambda k: S.lost_scores(k.bronze, k.silver),
    "c16_unlike_scores": lambda k: S.unlike_scores(k.bronze, k.silver),
    "c16_unread_values": lambda k: S.unread_values(k.bronze, k.silver),
    "c18_spot_hospital": lambda k: S.spot_hospital(k.bronze, k.silver, SPOT_IDS),
    "c18_spot_timely_care": lambda k: S.spot_timely_care(k.bronze, k.silver, SPOT_IDS),
    "c18_spot_complications": lambda k: S.spot_complications(k.bronze, k.silver, SPOT_IDS),
    "c18_spot_infections": lambda k: S.spot_infections(k.bronze, k.silver, SPOT_IDS),
    "c19_date_ranges": lambda k: S.date_ranges(k.bronze, k.silver),
    "c21_suffixes": lambda k: S.suffixes(k.bronze, k.silver),
    "c22_footnotes": lambda k: S.footnote_counts(k.bronze, k.silver),
    "c22_multi_code_footnotes": lambda k: S.multi_code_footnotes(k.bronze, k.silver),
    "c22_multi_code_group_footnotes": lambda k: S.multi_code_group_footnotes(k.bronze, k.silver),
    "c23_unusable_facilities": lambda k: S.unusable_facilities(k.bronze, k.silver),
    "c23_unusable_by_type": lambda k: S.unusable_by_type(k.bronze, k.silver),
    "c23_unusable_listed": lambda k: S.unusable_listed(k.bronze, k.silver),
    # gold
    "g1_dim_hospital": lambda k: k.gold["dim_hospital"],
    "g2_imaging_vs_ed_wait": lambda k: k.gold["vw_imaging_vs_ed_wait"],
    "g3_ownership_imaging_ed_stats": lambda k: k.gold["vw_ownership_imaging_ed_stats"],
    "g4_complications_vs_process_care": lambda k: k.gold["vw_complications_vs_process_care"],
    "c24_view_counts": lambda k: G.view_counts(k.gold),
    "c06_region_counts": lambda k: G.region_counts(k.gold),
    "c35_excluded_but_usable": lambda k: G.excluded_but_usable(k.silver),
    "c36_view_sample": lambda k: G.view_sample(k.gold),
    "c18_composite_inputs": lambda k: G.composite_inputs(k.silver, FACILITY),
    "c37_ownership_shares": lambda k: G.ownership_shares(k.gold),
    "c38_pct_worse_bounds": lambda k: G.pct_worse_bounds(k.gold),
    # exploration
    "e1_ed_inventory": lambda k: E.ed_inventory(k.silver),
    "e2_imaging_inventory": lambda k: E.imaging_inventory(k.silver),
    "e2_imaging_inventory_usable": lambda k: E.imaging_inventory(k.silver, usable_rows_only=True),
    "e3_process_inventory": lambda k: E.process_inventory(k.silver),
    "e4_outcomes_by_category": lambda k: E.outcomes_by_category(k.silver),
    "e5_outcomes_by_ownership": lambda k: E.outcomes_by_ownership(k.silver),
    "e6_sample_overlap": lambda k: E.sample_overlap(k.silver),
    "e7_survivors_by_ownership": lambda k: E.survivors_by_ownership(k.silver),
    "e8_complication_sample": lambda k: E.complication_sample(k.silver),
    "e9_ed_percentiles": lambda k: E.ed_percentiles(k.silver),
    "e10_imaging_percentiles": lambda k: E.imaging_percentiles(k.silver),
    "e11_imaging_outliers": lambda k: E.imaging_outliers(k.silver),
    "e12_stars_within_ownership": lambda k: E.stars_within_ownership(k.silver),
    "e13_state_regions": lambda k: E.state_regions(k.silver),
    "c34_unmapped_states": lambda k: E.unmapped_states(k.silver),
    "e14_shared_measures": lambda k: E.shared_measures(k.silver),
    "e15_measure_counts": lambda k: E.measure_counts(k.silver),
    "e16_availability_gap": lambda k: E.availability_gap(k.silver),
    "e17_worst_complications": lambda k: E.worst_complications(k.silver),
    "e18_imaging_ed_correlation": lambda k: E.imaging_ed_correlation(k.silver),
    "e19_imaging_ed_by_ownership": lambda k: E.imaging_ed_by_ownership(k.silver),
    # analyses
    "n1_ownership_overview": lambda k: N.ownership_overview(k.silver),
    "n1_star_distribution": lambda k: N.star_distribution(k.silver),
    "n2_ownership_subtypes": lambda k: N.ownership_subtypes(k.silver),
    "n3_completeness_by_stars": lambda k: N.completeness_by_stars(k.silver),
    "n4_completeness_correlation": lambda k: N.completeness_correlation(k.silver),
    "n5_reporting_profiles": lambda k: N.reporting_profiles(k.silver),
    "n6_infections_vs_complications": lambda k: N.infections_vs_complications(k.silver),
    "n7_process_outcome_distribution": lambda k: N.process_outcome_distribution(k.gold["vw_complications_vs_process_care"]),
    "n8_process_outcome_correlations": lambda k: N.process_outcome_correlations(k.gold["vw_complications_vs_process_care"]),
    "n9_entity_profile": lambda k: N.entity_profile(k.silver, NAME_PATTERN),
    "n10_entity_outcomes": lambda k: N.entity_outcomes(k.silver, FACILITY),
    "n11_ed_waits_vs_state": lambda k: N.ed_waits_vs_state(k.silver),
    "n12_imaging_vs_state": lambda k: N.imaging_vs_state(k.silver),
    "n13_peer_ranking": lambda k: N.peer_ranking(k.silver),
    "n13_peer_ranking_overall": lambda k: N.peer_ranking(k.silver, within=()),
    "n14_gap_to_best": lambda k: N.gap_to_five_stars(k.silver),
    # further results
    "x1_quadrants": lambda k: N.process_outcome_quadrants(k.gold["vw_complications_vs_process_care"]),
    "x2_unusable_by_state": lambda k: N.unusable_by_state(k.silver),
    "x3_full_infection_reporters": lambda k: N.full_infection_reporters(k.silver),
    "x4_unrated_by_type": lambda k: N.unrated_by_type(k.silver),
    "x5_ownership_stats_with_r": lambda k: N.ownership_stats_with_r(k.silver),
    # the same operators on the driver's own tables
    **DIRECT,
}


def _runner(report: Callable[[Lake], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: comparable(report(Lake(spark, sf_dir)))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(report) for name, report in REPORTS.items()}
