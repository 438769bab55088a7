"""What a good refresh looks like: the expectations on both layers, with one verdict each."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.functions import values as V
from caremeter.functions.rules import comparison_label, exclusion_reason, known_states, ownership_group
from caremeter.functions.text import has_code, is_missing, parse_codes
from caremeter.operators.checks import fact_rules
from caremeter.operators.ordered import in_order
from caremeter.operators.suite import GroupRule, RowRule, Source, verdicts
from caremeter.plans.silver_checks import COMPARED, FACT_KEYS, TYPED_SCORES, typed_columns
from caremeter.sources.schemas import FACTS, LENGTH_LIMITS, TABLES

Tables = Mapping[str, DataFrame]

ENTITIES = "hospital_general"
OWNERSHIP_LABELS = ("Government", "Non-Profit", "For-Profit", "Tribal", "Other")
PERIOD = (date(1990, 1, 1), date(2100, 1, 1))
ID_LENGTH = 6
FACT_CHECKS = {"null_facility_id": "C02", "usable_without_score": "C11", "unusable_score_without_reason": "C12",
               "usable_with_blocked_code": "C17", "inverted_dates": "C20"}


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def outside(column: str, allowed) -> Column:
    """A value beyond the known set; NULL is not a value."""
    return ~F.col(column).isin(*allowed)


def raw_rules(table: str) -> list[RowRule]:
    rules = [RowRule("C33", "id_length_differs", F.length("facility_id") != ID_LENGTH, "warn"),
             RowRule("C16", "unread_values", any_of(form & value.isNull() for form, value in typed_columns(table).values()), "warn")]
    if table in COMPARED:
        unlabelled = ~is_missing("compared_to_national") & comparison_label("compared_to_national").isNull()
        rules.append(RowRule("C10", "unlabelled_comparison", unlabelled, "warn"))
    return rules


def _status_differs(group: str) -> Column:
    codes = parse_codes(f"{group}_group_footnote")
    federal, apart = (has_code(codes, [V.GROUP_FLAG_CODES[k]]) for k in ("dod_hospital", "not_participating"))
    status = F.col(f"{group}_reporting_status")
    return (federal & (status != V.STATUS_FEDERAL)) | (apart & ~federal & (status != V.STATUS_NOT_PARTICIPATING))


def hospital_rules() -> list[RowRule]:
    return [
        RowRule("C02", "null_facility_id", F.col("facility_id").isNull()),
        RowRule("C06", "ownership_outside_set", outside("hospital_ownership", OWNERSHIP_LABELS)),
        RowRule("C06", "rating_outside_set", ~F.col("hospital_overall_rating").between(1, 5)),
        RowRule("C07", "ownership_not_as_mapped", ownership_group("hospital_ownership_details") != F.col("hospital_ownership")),
        RowRule("C08", "birthing_friendly_false", ~F.col("birthing_friendly_designation")),
        RowRule("C09", "status_against_code", any_of(_status_differs(g) for g in V.MEASURE_GROUPS)),
        RowRule("C34", "unmapped_state", outside("state", known_states()), "warn"),
    ]


def typed_rules(table: str) -> list[RowRule]:
    too_long = any_of(F.length(c) > n for c, n in LENGTH_LIMITS[table].items())
    lengths = RowRule("C00", "over_declared_length", too_long, "warn")
    if table == ENTITIES:
        return [*hospital_rules(), lengths]
    rules = [RowRule(FACT_CHECKS[name], name, broken) for name, broken in fact_rules(TYPED_SCORES[table]).items()]
    score, codes = TYPED_SCORES[table][0], parse_codes("footnote")
    # whether a score is missing is read off the flags, so the tiers are worked out anew from the codes alone
    tiers = ((V.ZERO_INFECTIONS_TIER,) if table == "infections" else ()) + V.REASON_TIERS
    by_codes = exclusion_reason(F.lit("1"), codes, tiers)
    rules += [
        RowRule("C13", "reason_not_first_tier", F.col("footnote").contains(",") & by_codes.isNotNull()
                & ~by_codes.eqNullSafe(F.col("score_exclusion_reason"))),
        RowRule("C15", "negative_score", F.col(score) < 0),
        RowRule("C19", "period_out_of_range", any_of(~F.col(c).between(*map(F.lit, PERIOD)) for c in ("start_date", "end_date"))),
        lengths,
    ]
    if table == "timely_care":
        rules.append(RowRule("C14", "number_and_text", F.col("score_numeric").isNotNull() & F.col("score_text").isNotNull()))
    if table in COMPARED:
        rules.append(RowRule("C10", "comparison_outside_set", outside("compared_to_national", [label for _, label in V.COMPARISONS])))
    if table == "infections":
        rules.append(RowRule("C21", "measure_without_suffix", F.col("measure_suffix").isNull()))
    return rules


def sources(b: Tables, s: Tables) -> list[Source]:
    found = []
    for t in TABLES:
        key = ("facility_id",) if t == ENTITIES else FACT_KEYS
        fact = t != ENTITIES
        real = ~is_missing("score") & ~F.col("score").rlike(V.BLANK_PATTERN) if fact else None
        empty = F.coalesce(*[F.col(c).cast("string") for c in TYPED_SCORES[t]]).isNull() if fact else None
        found += [Source(t, "raw", b[t], key, raw_rules(t), real=real),
                  Source(t, "typed", s[t], key, typed_rules(t), empty=empty, usable=F.col("is_score_usable") if fact else None)]
    return found


def group_rules() -> list[GroupRule]:
    rules = [GroupRule("C01", t, "row_count_difference", F.abs(F.col(f"{t}_raw") - F.col(f"{t}_typed"))) for t in TABLES]
    rules += [GroupRule("C24", t, "raw_rows", F.col(f"{t}_raw"), "info", None) for t in TABLES]
    rules += [GroupRule("C03", t, "repeated_keys", F.col(f"{t}_repeated")) for t in TABLES]
    rules += [GroupRule("C05", t, "orphan_ids", F.col(f"{t}_orphans")) for t in FACTS]
    rules += [GroupRule("C16", t, "lost_scores", F.col(f"{t}_lost")) for t in FACTS]
    return [*rules, GroupRule("C30", "infections", "odd_group_sizes", F.col("infections_odd"), "warn"),
            GroupRule("C23", "all facts", "entities_without_usable_score", F.col("unusable"), "info", None)]


@in_order("check_name", "table_name", "metric")
def expectations(b: Tables, s: Tables) -> DataFrame:
    """The verdicts on a refresh of both layers, in the order of the checks; each of the ten tables is read once."""
    return verdicts(sources(b, s), ENTITIES, group_rules(), {"infections": V.INFECTION_ROWS_PER_FACILITY})


def failed(b: Tables, s: Tables, severity: str = "error") -> DataFrame:
    """Only the expectations of a severity that do not hold."""
    return expectations(b, s).where((F.col("severity") == severity) & ~F.col("ok"))
