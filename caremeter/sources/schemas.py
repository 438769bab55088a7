"""Declared schemas. Nothing is inferred: bronze is all text, silver is typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from caremeter.functions.text import SCORE_PRECISION
from caremeter.functions.values import MEASURE_GROUPS

TABLES = ("hospital_general", "timely_care", "complications", "outpatient_imaging", "infections")
FACTS = TABLES[1:]

# fixed values: published file per table
CSV_FILES = {
    "hospital_general": "Hospital_General_Information.csv",
    "timely_care": "Timely_and_Effective_Care-Hospital.csv",
    "complications": "Complications_and_Deaths-Hospital.csv",
    "outpatient_imaging": "Outpatient_Imaging_Efficiency-Hospital.csv",
    "infections": "Healthcare_Associated_Infections-Hospital.csv",
}

# fixed values: column order of the published files
PLACE = [
    "facility_id", "facility_name", "address", "city", "state", "zip_code", "county",
]


def _raw_group_columns() -> list[str]:
    out = []
    for g, (with_outcomes, _) in MEASURE_GROUPS.items():
        out += [f"{g}_group_measure_count", f"facility_{g}_measure_count"]
        out += [f"{g}_measures_{o}" for o in ("better", "no_different", "worse")] if with_outcomes else []
        out += [f"{g}_group_footnote"]
    return out


RAW_COLUMNS = {
    "hospital_general": PLACE + [
        "telephone_number", "hospital_type", "hospital_ownership", "emergency_services",
        "birthing_friendly_designation", "hospital_overall_rating", "hospital_overall_rating_footnote",
    ] + _raw_group_columns(),
    "timely_care": PLACE + [
        "telephone_number", "condition", "measure_id", "measure_name", "score", "sample", "footnote", "start_date",
        "end_date",
    ],
    "complications": PLACE + [
        "telephone_number", "measure_id", "measure_name", "compared_to_national", "denominator", "score",
        "lower_estimate", "higher_estimate", "footnote", "start_date", "end_date",
    ],
    "outpatient_imaging": PLACE + [
        "telephone_number", "measure_id", "measure_name", "score", "footnote", "start_date", "end_date",
    ],
    "infections": PLACE + [
        "telephone_number", "measure_id", "measure_name", "compared_to_national", "score", "footnote", "start_date",
        "end_date",
    ],
}

BRONZE_AUDIT = "dwh_load_date"
SILVER_AUDIT = "dwh_create_date"


def bronze_schema(table: str) -> T.StructType:
    """Schema of the CSV file itself (no audit column)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS[table]])


TEXT, WHOLE, DECIMAL, FLAG, DATE = (
    T.StringType(), T.LongType(), T.DecimalType(*SCORE_PRECISION), T.BooleanType(), T.DateType())


def _fields(names, kind: T.DataType = TEXT) -> list[T.StructField]:
    return [T.StructField(n, kind, nullable=n != "facility_id") for n in names]


def _group_fields() -> list[T.StructField]:
    out = []
    for g, (with_outcomes, _) in MEASURE_GROUPS.items():
        out += _fields([f"{g}_group_measures_count", f"facility_{g}_measures_count"], WHOLE)
        out += _fields([f"{g}_measures_{o}" for o in ("better", "no_different", "worse")], WHOLE) if with_outcomes else []
        out += _fields([f"{g}_group_footnote"])
        out += _fields([f"{g}_{f}" for f in ("not_reported", "not_participating", "dod_hospital", "data_issue")], FLAG)
        out += _fields([f"{g}_reporting_status"])
    return out


_USABILITY = [*_fields(["score_available", "is_score_usable"], FLAG), *_fields(["score_exclusion_reason"])]
_PERIOD = [*_fields(["footnote"]), *_fields(["start_date", "end_date"], DATE)]

SILVER_SCHEMAS = {
    "hospital_general": T.StructType([
        *_fields([*PLACE, "hospital_type", "hospital_ownership", "hospital_ownership_details"]),
        *_fields(["emergency_services", "birthing_friendly_designation"], FLAG),
        *_fields(["hospital_overall_rating"], WHOLE),
        *_fields(["hospital_overall_rating_footnote"]),
        *_group_fields()]),
    "timely_care": T.StructType([
        *_fields([*PLACE, "condition", "measure_id", "measure_name"]),
        *_fields(["score_numeric"], DECIMAL), *_fields(["score_text"]),
        *_USABILITY, *_fields(["sample"], WHOLE), *_PERIOD]),
    "complications": T.StructType([
        *_fields([*PLACE, "measure_id", "measure_name", "compared_to_national"]),
        *_fields(["denominator"], WHOLE), *_fields(["score", "lower_estimate", "higher_estimate"], DECIMAL),
        *_USABILITY, *_PERIOD]),
    "outpatient_imaging": T.StructType([
        *_fields([*PLACE, "measure_id", "measure_name"]), *_fields(["score"], DECIMAL), *_USABILITY, *_PERIOD]),
    "infections": T.StructType([
        *_fields([*PLACE, "measure_id", "measure_suffix", "measure_name", "compared_to_national"]),
        *_fields(["score"], DECIMAL), *_USABILITY, *_PERIOD]),
}

# fixed values: declared text lengths, kept as warn-level checks instead of storage limits
_PLACE_LIMITS = dict(facility_id=6, facility_name=255, address=255, city=100, state=2, zip_code=10, county=100)
_FACT_LIMITS = dict(_PLACE_LIMITS, measure_id=50, measure_name=255, score_exclusion_reason=25, footnote=50)
LENGTH_LIMITS = {
    "hospital_general": dict(
        _PLACE_LIMITS, city=50, zip_code=15, hospital_type=100, hospital_ownership=50,
        hospital_ownership_details=100, hospital_overall_rating_footnote=50,
        **{f"{g}_group_footnote": 10 for g in MEASURE_GROUPS},
        **{f"{g}_reporting_status": 50 for g in MEASURE_GROUPS}),
    "timely_care": dict(_FACT_LIMITS, condition=255, measure_id=100, score_text=50),
    "complications": dict(_FACT_LIMITS, compared_to_national=50),
    "outpatient_imaging": dict(_FACT_LIMITS),
    "infections": dict(_FACT_LIMITS, measure_suffix=20, compared_to_national=50),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name, in order; a type that differs is a programming error."""
    out = df.select(*schema.fieldNames())
    wrong = [f.name for f, g in zip(schema.fields, out.schema.fields) if f.dataType != g.dataType]
    if wrong:
        raise TypeError(f"columns with a type other than declared: {wrong}")
    return out
