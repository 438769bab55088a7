"""Text tables to typed tables: one narrow projection per table, no shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caremeter.functions import values as V
from caremeter.functions.rules import (
    comparison_label, exclusion_reason, group_flags, group_status, ownership_group, score_usable, yes_no,
    yes_or_unknown,
)
from caremeter.functions.text import is_missing, last_token, parse_codes, split_score, to_date_mdy, to_decimal, to_int
from caremeter.plans.batch import run_batch
from caremeter.sources.schemas import FACTS, PLACE, SILVER_AUDIT, SILVER_SCHEMAS, TABLES, conform
from caremeter.sources.store import LayerStore

CODES = "__codes"


def _trimmed(*names: str) -> list[Column]:
    return [F.trim(n).alias(n) for n in names]


def _place() -> list[Column]:
    return [F.trim(F.upper(n)).alias(n) if n == "state" else F.trim(n).alias(n) for n in PLACE]


def _usability(tiers=V.REASON_TIERS) -> list[Column]:
    return [
        (~is_missing("score")).alias("score_available"),
        score_usable("score", CODES).alias("is_score_usable"),
        exclusion_reason("score", CODES, tiers).alias("score_exclusion_reason"),
    ]


def _period() -> list[Column]:
    return [F.trim("footnote").alias("footnote"), *[to_date_mdy(d).alias(d) for d in ("start_date", "end_date")]]


def _hospital_general(raw: DataFrame) -> DataFrame:
    codes = {g: f"{CODES}_{g}" for g in V.MEASURE_GROUPS}
    coded = raw.withColumns({codes[g]: parse_codes(f"{g}_group_footnote") for g in codes})
    columns = [
        *_place(), *_trimmed("hospital_type"),
        ownership_group("hospital_ownership").alias("hospital_ownership"),
        F.trim("hospital_ownership").alias("hospital_ownership_details"),
        yes_no("emergency_services").alias("emergency_services"),
        yes_or_unknown("birthing_friendly_designation").alias("birthing_friendly_designation"),
        to_int("hospital_overall_rating").alias("hospital_overall_rating"),
        *_trimmed("hospital_overall_rating_footnote"),
    ]
    for g, (with_outcomes, check_data_issue) in V.MEASURE_GROUPS.items():
        columns += [to_int(f"{g}_group_measure_count").alias(f"{g}_group_measures_count"),
                    to_int(f"facility_{g}_measure_count").alias(f"facility_{g}_measures_count")]
        if with_outcomes:
            columns += [to_int(f"{g}_measures_{o}").alias(f"{g}_measures_{o}") for o in ("better", "no_different", "worse")]
        columns += [*_trimmed(f"{g}_group_footnote"), *group_flags(g, codes[g], check_data_issue), codes[g]]
    return coded.select(*columns).withColumns({
        f"{g}_reporting_status": group_status(g, codes[g], check_data_issue)
        for g, (_, check_data_issue) in V.MEASURE_GROUPS.items()})


def _timely_care(raw: DataFrame) -> DataFrame:
    numeric, text, _ = split_score("score")
    return raw.select(
        *_place(), *_trimmed("condition", "measure_id", "measure_name"),
        numeric.alias("score_numeric"), text.alias("score_text"), *_usability(),
        to_int("sample").alias("sample"), *_period())


def _complications(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_place(), *_trimmed("measure_id", "measure_name"),
        comparison_label("compared_to_national").alias("compared_to_national"),
        to_int("denominator").alias("denominator"),
        *[to_decimal(c).alias(c) for c in ("score", "lower_estimate", "higher_estimate")], *_usability(), *_period())


def _outpatient_imaging(raw: DataFrame) -> DataFrame:
    return raw.select(*_place(), *_trimmed("measure_id", "measure_name"), to_decimal("score").alias("score"),
                      *_usability(), *_period())


def _infections(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_place(), *_trimmed("measure_id"), last_token("measure_id").alias("measure_suffix"),
        *_trimmed("measure_name"), comparison_label("compared_to_national").alias("compared_to_national"),
        to_decimal("score").alias("score"), *_usability((V.ZERO_INFECTIONS_TIER, *V.REASON_TIERS)), *_period())


BUILDERS = {
    "hospital_general": _hospital_general,
    "timely_care": _timely_care,
    "complications": _complications,
    "outpatient_imaging": _outpatient_imaging,
    "infections": _infections,
}


def build_silver(table: str, bronze: DataFrame) -> DataFrame:
    """Typed table from its raw table: one row in, one row out.

    The footnote array of a fact is computed once per row, below the projection that uses it.
    """
    raw = bronze.withColumn(CODES, parse_codes("footnote")) if table in FACTS else bronze
    return conform(BUILDERS[table](raw), SILVER_SCHEMAS[table])


def load_silver(spark: SparkSession, store: LayerStore, batch_ts: datetime | None = None,
                tables=TABLES) -> DataFrame:
    """Full refresh of the silver tables from the store's bronze layer; returns the run log.

    Facts are sorted by measure inside each task (no shuffle), so that the measure filters of the
    views can skip Parquet row groups.
    """
    def builder(table):
        def build():
            df = build_silver(table, store.read("bronze", table))
            return df.sortWithinPartitions("measure_id", "facility_id") if table in FACTS else df
        return build

    return run_batch(spark, store, "silver", {t: builder(t) for t in tables}, SILVER_AUDIT, batch_ts)
