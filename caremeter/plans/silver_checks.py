"""Validation of the typed tables against the raw ones. ``b`` is bronze, ``s`` is silver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.functions.rules import comparison_label
from caremeter.functions.text import SCORE_TYPE, cut_decimals, is_missing, looks_decimal, mdy_value, to_decimal
from caremeter.operators import checks as C, profiles as P
from caremeter.operators.common import tagged, union_all
from caremeter.operators.duplicates import check_duplicates
from caremeter.operators.difference import row_difference
from caremeter.operators.ordered import by_counts, in_order
from caremeter.sources.schemas import FACTS, LENGTH_LIMITS, RAW_COLUMNS, TABLES

Tables = Mapping[str, DataFrame]

TYPED_SCORES = {
    "timely_care": ("score_numeric", "score_text"),
    "complications": ("score",),
    "outpatient_imaging": ("score",),
    "infections": ("score",),
}
WHOLE_NUMBERS = {
    "hospital_general": ["hospital_overall_rating", *[
        c for c in RAW_COLUMNS["hospital_general"] if c.endswith("_measure_count") or "_measures_" in c]],
    "timely_care": ["sample"], "complications": ["denominator"], "outpatient_imaging": [], "infections": [],
}
DECIMALS = {t: ["score"] for t in FACTS} | {"complications": ["score", "lower_estimate", "higher_estimate"], "hospital_general": []}
FACT_KEYS = ("facility_id", "measure_id")
COMPARED = ("complications", "infections")


@by_counts
def count_parity(b: Tables, s: Tables) -> DataFrame:
    return C.check_counts(b, s)


@by_counts
def null_keys(b: Tables, s: Tables) -> DataFrame:
    return C.check_null_keys({t: s[t] for t in TABLES}, "facility_id")


@by_counts
def duplicate_pairs(b: Tables, s: Tables) -> DataFrame:
    return union_all([check_duplicates(s[t], t, FACT_KEYS) for t in FACTS])


@by_counts
def orphan_ids(b: Tables, s: Tables) -> DataFrame:
    return union_all([C.check_orphans(s[t], s["hospital_general"], t, "facility_id") for t in FACTS])


@by_counts
def fact_invariants(b: Tables, s: Tables) -> DataFrame:
    """Null ids, usability, reasons, blocked codes and inverted dates: one scan per fact."""
    return union_all([C.violations(s[t], t, C.fact_rules(TYPED_SCORES[t])) for t in FACTS])


@by_counts
def text_lengths(b: Tables, s: Tables) -> DataFrame:
    """Warn-level: values longer than the declared lengths."""
    return union_all([C.check_lengths(s[t], t, LENGTH_LIMITS[t]) for t in TABLES])


@by_counts
def domain(b: Tables, s: Tables, column: str, table: str = "hospital_general") -> DataFrame:
    return P.profile_values(s[table], [column])


@by_counts
def ownership_mapping(b: Tables, s: Tables) -> DataFrame:
    return P.profile_distinct(s["hospital_general"], ["hospital_ownership", "hospital_ownership_details"])


@by_counts
def boolean_profile(b: Tables, s: Tables) -> DataFrame:
    return P.profile_booleans(s["hospital_general"], ["emergency_services", "birthing_friendly_designation"])


@by_counts
def status_by_footnote(b: Tables, s: Tables, group: str = "mort") -> DataFrame:
    status = f"{group}_reporting_status"
    return P.profile_values(s["hospital_general"], [status, f"{group}_group_footnote"], F.col(status).isNotNull())


@by_counts
def comparison_counts(b: Tables, s: Tables) -> DataFrame:
    return union_all([tagged(P.profile_values(s[t], ["compared_to_national"]), t) for t in COMPARED])


@by_counts
def comparison_variants(b: Tables, s: Tables) -> DataFrame:
    sources = {f"{layer}_{t}": tables[t] for layer, tables in (("bronze", b), ("silver", s)) for t in COMPARED}
    return C.compare_sets(sources, "compared_to_national")


@by_counts
def unmatched_comparisons(b: Tables, s: Tables) -> DataFrame:
    """Raw wordings that the recode leaves NULL, such as variants the patterns do not cover."""
    return union_all([tagged(C.unmatched_values(b[t], "compared_to_national", comparison_label("compared_to_national")), t)
                      for t in COMPARED])


@by_counts
def multi_code_tiers(b: Tables, s: Tables) -> DataFrame:
    """Reasons given to unusable rows that carry several codes."""
    rows = C.stack_facts({t: s[t].where(F.col("footnote").contains(",") & ~F.col("is_score_usable")) for t in FACTS},
                   ["footnote", "score_exclusion_reason"])
    return P.profile_values(rows, ["table_name", "footnote", "score_exclusion_reason"])


def score_split(b: Tables, s: Tables) -> DataFrame:
    return C.exclusive_columns(s["timely_care"], "score_numeric", "score_text")


@by_counts
def score_ranges(b: Tables, s: Tables) -> DataFrame:
    return union_all([C.check_range(s[t], t, TYPED_SCORES[t][0]) for t in FACTS])


@by_counts
def lost_scores(b: Tables, s: Tables) -> DataFrame:
    return union_all([C.check_lost_values(b[t], s[t], t, FACT_KEYS, "score", TYPED_SCORES[t]) for t in FACTS])


@in_order("table_name", "facility_id", "measure_id", "score_number", "score_text")
def unlike_scores(b: Tables, s: Tables) -> DataFrame:
    """Every score that the typed table holds otherwise than published: facility, measure, the value, and how often each layer has it.

    Numbers are compared as numbers, other scores as trimmed text, missing ones as NULL; see ``row_difference``.
    """
    def published(t):
        number = to_decimal("score")
        text = F.when(number.isNull() & ~is_missing("score"), F.trim("score"))
        return b[t].select(F.trim("measure_id").alias("measure_id"), F.trim("facility_id").alias("facility_id"),
                           number.alias("score_number"), F.nullif(text, F.lit("")).alias("score_text"))

    def typed(t):
        number, *text = TYPED_SCORES[t]
        return s[t].select("measure_id", "facility_id", F.col(number).cast("decimal(38,12)").alias("score_number"),
                           (F.trim(text[0]) if text else F.lit(None).cast("string")).alias("score_text"))

    found = {t: row_difference(published(t), typed(t), ("measure_id", "facility_id")) for t in FACTS}
    return union_all([tagged(df, t) for t, df in found.items()]).withColumnsRenamed(
        {"n_left": "n_published", "n_right": "n_typed"})


def typed_columns(table: str) -> dict:
    """Raw column -> (has the form, value of a text that has it) for every column that the load types; NULL if the type cuts digits off."""
    whole = {c: (F.col(c).rlike(V.INT_PATTERN), F.col(c).try_cast("bigint")) for c in WHOLE_NUMBERS[table]}
    decimal = {c: (looks_decimal(c), F.when(~cut_decimals(c), F.col(c).try_cast(SCORE_TYPE))) for c in DECIMALS[table]}
    date = {c: (F.col(c).rlike(V.DATE_PREFIX_PATTERN), mdy_value(c)) for c in ("start_date", "end_date") if table in FACTS}
    return whole | decimal | date


@by_counts
def unread_values(b: Tables, s: Tables) -> DataFrame:
    return union_all([C.check_unread_values(b[t], t, typed_columns(t)) for t in TABLES])


@by_counts
def date_ranges(b: Tables, s: Tables) -> DataFrame:
    return union_all([C.check_range(s[t], t, "start_date", "end_date", ("earliest", "latest")) for t in FACTS])


@by_counts
def suffixes(b: Tables, s: Tables) -> DataFrame:
    return P.profile_distinct(s["infections"], ["measure_suffix"])


@by_counts
def footnote_counts(b: Tables, s: Tables) -> DataFrame:
    return union_all([tagged(P.profile_values(s[t], ["footnote"]), t) for t in FACTS])


@by_counts
def multi_code_footnotes(b: Tables, s: Tables) -> DataFrame:
    return union_all([tagged(P.profile_values(s[t], ["footnote"], F.col("footnote").contains(",")), t) for t in FACTS])


@by_counts
def multi_code_group_footnotes(b: Tables, s: Tables, group: str = "safety") -> DataFrame:
    c = f"{group}_group_footnote"
    return P.profile_values(s["hospital_general"], [c], F.col(c).contains(","))


@by_counts
def spot_hospital(b: Tables, s: Tables, ids) -> DataFrame:
    names = ("name", "ownership", "rating", "emergency")
    cols = ("facility_name", "hospital_ownership", "hospital_overall_rating", "emergency_services")
    return C.spot_check(b["hospital_general"], s["hospital_general"], ["facility_id"], "facility_id", ids,
                        {c: f"bronze_{n}" for c, n in zip(cols, names)}, {c: f"silver_{n}" for c, n in zip(cols, names)})


@by_counts
def spot_timely_care(b: Tables, s: Tables, ids) -> DataFrame:
    return C.spot_check(b["timely_care"], s["timely_care"], FACT_KEYS, "facility_id", ids,
                        {"measure_name": "measure_name", "score": "bronze_score"},
                        {c: c for c in ("score_numeric", "score_text", "is_score_usable", "score_exclusion_reason")})


@by_counts
def spot_complications(b: Tables, s: Tables, ids) -> DataFrame:
    cols = {"compared_to_national": "compared", "score": "score", "start_date": "start_date", "end_date": "end_date"}
    return C.spot_check(b["complications"], s["complications"], FACT_KEYS, "facility_id", ids,
                        {c: f"bronze_{a}" for c, a in cols.items()}, {c: f"silver_{a}" for c, a in cols.items()})


@by_counts
def spot_infections(b: Tables, s: Tables, ids) -> DataFrame:
    return C.spot_check(b["infections"], s["infections"], FACT_KEYS, "facility_id", ids,
                        {"score": "bronze_score"}, {"score": "silver_score", "measure_suffix": "measure_suffix"})


def _no_usable_score(s: Tables) -> DataFrame:
    return C.never_true(C.stack_facts({t: s[t] for t in FACTS}, ["facility_id", "is_score_usable"]), "facility_id", "is_score_usable")


def unusable_facilities(b: Tables, s: Tables) -> DataFrame:
    return _no_usable_score(s).agg(F.count("*").alias("hospitals_with_no_usable_scores"))


@by_counts
def unusable_by_type(b: Tables, s: Tables) -> DataFrame:
    kinds = ["hospital_type", "hospital_ownership", "emergency_services", "hospital_overall_rating"]
    return P.profile_values(_no_usable_score(s).join(s["hospital_general"], "facility_id"), kinds, n="n_hospitals")


@by_counts
def unusable_listed(b: Tables, s: Tables, types=V.ACUTE_TYPES) -> DataFrame:
    rows = s["hospital_general"].where(F.col("hospital_type").isin(*types)).join(
        _no_usable_score(s), "facility_id", "left_semi")
    return rows.select("facility_id", "facility_name", "hospital_type", "state", "hospital_ownership",
                       "emergency_services", "hospital_overall_rating",
                       *[f"{g}_reporting_status" for g in V.MEASURE_GROUPS])
