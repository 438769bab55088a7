"""Profiles of the raw tables. ``b`` maps table names to bronze DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.operators import checks as C, profiles as P
from caremeter.operators.common import tagged, union_all
from caremeter.operators.duplicates import duplicate_keys, list_duplicates
from caremeter.operators.ordered import by_counts, in_order
from caremeter.sources.schemas import FACTS, RAW_COLUMNS

Tables = Mapping[str, DataFrame]

# columns profiled for missing scores, per fact
SCORE_COLUMNS = {
    "timely_care": ("score",),
    "complications": ("score", "denominator", "lower_estimate", "higher_estimate"),
    "outpatient_imaging": ("score",),
    "infections": ("score",),
}
ROW_KEYS = {
    "timely_care": ("facility_id", "measure_id", "condition"),
    "complications": ("facility_id", "measure_id"),
    "outpatient_imaging": ("facility_id", "measure_id"),
    "infections": ("facility_id", "measure_id"),
}
# columns whose values are listed one by one, per table
LISTED_COLUMNS = {
    "hospital_general": ["hospital_type", "hospital_ownership", "emergency_services", "birthing_friendly_designation",
                         "hospital_overall_rating", *[f"{g}_group_footnote" for g in V.MEASURE_GROUPS]],
    "timely_care": ["condition", "measure_id", "footnote", "start_date", "end_date"],
    "complications": ["measure_id", "compared_to_national", "footnote", "start_date", "end_date"],
    "outpatient_imaging": ["measure_id", "footnote", "start_date", "end_date"],
    "infections": ["facility_id", "measure_id", "compared_to_national", "footnote", "start_date", "end_date"],
}


@in_order("table_name", "column_name", "metric", "-n", "item")
def column_report(b: Tables) -> DataFrame:
    """Missingness, odd values, distincts, value counts, lengths and text ranges of every raw column; one scan a table."""
    return P.column_report(b, RAW_COLUMNS, LISTED_COLUMNS)


@by_counts
def table_counts(b: Tables) -> DataFrame:
    return C.row_counts(b)


@by_counts
def repeated_facilities(b: Tables) -> DataFrame:
    return duplicate_keys(b["hospital_general"], ["facility_id"])


def duplicate_rows(b: Tables, table: str) -> DataFrame:
    return list_duplicates(b[table], ROW_KEYS[table], "start_date")


@by_counts
def distinct_values(b: Tables, table: str, column: str) -> DataFrame:
    return P.profile_distinct(b[table], [column])


@by_counts
def value_counts(b: Tables, table: str, column: str, n: str = "n") -> DataFrame:
    return P.profile_values(b[table], [column], n=n)


@by_counts
def group_footnote_codes(b: Tables, group: str = "mort") -> DataFrame:
    c = f"{group}_group_footnote"
    return P.profile_values(b["hospital_general"], [c], F.col(c).isNotNull() & (F.col(c) != ""))


def footnote_coverage(b: Tables) -> DataFrame:
    return P.profile_filled(b["hospital_general"], {f"{g}_footnoted": f"{g}_group_footnote" for g in V.MEASURE_GROUPS},
                            total="total_hospitals")


@by_counts
def missing_scores(b: Tables) -> DataFrame:
    """Missingness of every score column of every fact: one scan per fact."""
    return union_all([tagged(P.profile_missing(b[t], cols), t) for t, cols in SCORE_COLUMNS.items()])


@by_counts
def odd_scores(b: Tables, table: str) -> DataFrame:
    return P.profile_odd_values(b[table], "score")


@by_counts
def footnotes(b: Tables) -> DataFrame:
    return union_all([tagged(P.profile_values(b[t], ["footnote"]), t) for t in FACTS])


@by_counts
def text_date_range(b: Tables) -> DataFrame:
    """First and last period as text (text order); the true range is a silver check."""
    return union_all([C.check_range(b[t], t, "start_date", "end_date", ("earliest_period", "latest_period"))
                      for t in FACTS])


@by_counts
def odd_infection_counts(b: Tables, expected: int = V.INFECTION_ROWS_PER_FACILITY) -> DataFrame:
    return P.odd_group_sizes(b["infections"], "facility_id", expected)


def join_match_counts(b: Tables) -> DataFrame:
    return C.join_size(b["hospital_general"], b["timely_care"], "facility_id", "hospital_to_timely_care")


@by_counts
def id_lengths(b: Tables) -> DataFrame:
    return P.profile_length(b, "facility_id")
