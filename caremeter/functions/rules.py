"""Business rules built from the text functions: recodes, usability, reporting status."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, functions as F

from caremeter.functions import values as V
from caremeter.functions.text import SCORE_TYPE, as_col, has_code, is_missing


# ---- recodes ---------------------------------------------------------------------------

def ilike_any(*patterns):
    return lambda c: reduce(or_, [c.ilike(p) for p in patterns])


def like(pattern):
    return lambda c: c.like(pattern)


def one_of(*items):
    return lambda c: c.isin(*items)


def recode(text: Column | str, rules, default: str | None = None) -> Column:
    """First matching ``(predicate, label)`` wins; ``predicate`` maps a Column to a boolean Column."""
    c = as_col(text)
    out = F
    for matches, label in rules:
        out = out.when(matches(c), F.lit(label))
    return out.otherwise(F.lit(default))


OWNERSHIP_RULES = (
    (ilike_any(*V.GOVERNMENT_PATTERNS), "Government"),
    (ilike_any(V.NON_PROFIT_PATTERN), "Non-Profit"),
    (one_of(*V.FOR_PROFIT_VALUES), "For-Profit"),
    (one_of(V.TRIBAL_VALUE), "Tribal"),
)


def ownership_group(raw: Column | str) -> Column:
    return recode(raw, OWNERSHIP_RULES, "Other")


def comparison_label(raw: Column | str) -> Column:
    return recode(raw, [(ilike_any(p), label) for p, label in V.COMPARISONS])


def region(state: Column | str, default: str = "Unknown") -> Column:
    return recode(state, [(one_of(*states), name) for name, states in V.REGIONS.items()], default)


def known_states() -> list[str]:
    return [s for states in V.REGIONS.values() for s in states]


def outcome_category(measure: Column | str) -> Column:
    return recode(measure, [(like(p), label) for p, label in V.OUTCOME_CATEGORIES], "Other")


def yes_no(raw: Column | str) -> Column:
    return F.when(as_col(raw) == "Yes", True).when(as_col(raw) == "No", False)


def yes_or_unknown(raw: Column | str) -> Column:
    """'Y' -> True, anything else is unknown (NULL), never False."""
    return F.when(as_col(raw) == "Y", True)


# ---- score usability -------------------------------------------------------------------

def score_usable(score: Column | str, codes: Column | str, blocked=V.BLOCKED_CODES) -> Column:
    return ~is_missing(score) & ~has_code(codes, blocked)


def exclusion_reason(score: Column | str, codes: Column | str, tiers=V.REASON_TIERS) -> Column:
    """Ordered footnote tiers first, then the generic label for a missing score, else NULL."""
    out = F
    for label, wanted in tiers:
        out = out.when(has_code(codes, wanted), F.lit(label))
    return out.when(is_missing(score), F.lit(V.NO_SCORE))


# ---- measure groups of the facility table ----------------------------------------------

def group_flags(group: str, codes: Column | str, check_data_issue: bool = True) -> list[Column]:
    return [
        (F.lit(False) if name == "data_issue" and not check_data_issue else has_code(codes, [code]))
        .alias(f"{group}_{name}")
        for name, code in V.GROUP_FLAG_CODES.items()
    ]


def group_status(group: str, codes: Column | str, check_data_issue: bool = True) -> Column:
    """Reporting status from the typed counts: footnote codes outrank the counts, equal counts a positive count."""
    code = V.GROUP_FLAG_CODES
    reported, possible = F.col(f"facility_{group}_measures_count"), F.col(f"{group}_group_measures_count")
    ladder = [
        (has_code(codes, [code["dod_hospital"]]), V.STATUS_FEDERAL),
        (has_code(codes, [code["not_participating"]]), V.STATUS_NOT_PARTICIPATING),
        (has_code(codes, [code["data_issue"]]) if check_data_issue else None, V.STATUS_DATA_ISSUE),
        (has_code(codes, [code["not_reported"]]), V.STATUS_INSUFFICIENT),
        (reported == possible, V.STATUS_FULL),
        (reported > 0, V.STATUS_PARTIAL),
    ]
    out = F
    for test, label in ladder:
        if test is not None:
            out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(V.STATUS_NONE))


def completeness_pct(groups=tuple(V.MEASURE_GROUPS), digits: int = 1) -> Column:
    """Measures reported over measures possible, all groups together; NULL when none is possible."""
    reported = reduce(add, [F.coalesce(f"facility_{g}_measures_count", F.lit(0)).cast("bigint") for g in groups])
    possible = reduce(add, [F.coalesce(f"{g}_group_measures_count", F.lit(0)).cast("bigint") for g in groups])
    return pct(reported, possible, digits)


def reporting_profile(status_cols=tuple(f"{g}_reporting_status" for g in V.MEASURE_GROUPS)) -> Column:
    def each(label):
        return [F.col(c) == label for c in status_cols]

    return (
        F.when(reduce(and_, each(V.STATUS_FULL)), "All Groups Fully Rated")
        .when(reduce(or_, each(V.STATUS_NOT_PARTICIPATING)), "At Least One Not Participating")
        .when(reduce(or_, each(V.STATUS_FEDERAL)), "Federal Hospital")
        .otherwise("Mixed / Partial")
    )


# ---- arithmetic ------------------------------------------------------------------------

def pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole in decimal arithmetic (half-up rounding), NULL when whole is 0."""
    ratio = F.lit(100).cast("decimal(3,0)") * part.cast("decimal(18,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)")
    return F.round(ratio, digits).cast(f"decimal(18,{digits})")


def exact_avg(value: Column | str, digits: int) -> Column:
    """AVG in decimal arithmetic, rounded half up: no drift from the order of partial sums.

    NULL values are left out. NULL if a value is no number of the decimal type: NaN, infinite, or too large for it.
    """
    given, held = as_col(value), as_col(value).try_cast(SCORE_TYPE)
    return F.when(F.count(given) == F.count(held), F.round(F.try_avg(held), digits).cast(f"decimal(38,{digits})"))


def mean_of(total: Column, n: Column, digits: int) -> Column:
    """Average from a pre-aggregated sum and count (same result as ``exact_avg`` on the rows)."""
    return F.round(total.cast(SCORE_TYPE) / F.nullif(n, F.lit(0)).cast("decimal(19,0)"), digits).cast(f"decimal(38,{digits})")


def sd(value: Column | str, digits: int) -> Column:
    return F.round(F.stddev_samp(as_col(value).cast("double")), digits)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over rows where both values exist; NULL (no error) on zero variance or < 2 rows."""
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def r_squared(x: Column | str, y: Column | str) -> Column:
    return F.pow(safe_corr(x, y), F.lit(2))
