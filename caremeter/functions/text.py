"""Text to value: footnote code lists, missing tokens, guarded casts.

All guarded casts return NULL for text they do not accept; none of them can fail a job
under ANSI mode. Patterns end in ``\\z`` because Java's ``$`` also matches before a final
newline.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caremeter.functions import values as V

SCORE_PRECISION = (38, 12)     # 26 digits before the point, 12 after it; what is beyond is counted by lost_values
SCORE_TYPE = "decimal(38,12)"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_codes(footnote: Column | str) -> Column:
    """``'3, 13'`` -> ``['3', '13']``; NULL stays NULL."""
    return F.split(F.trim(as_col(footnote)), " *, *")


def has_code(codes: Column | str, wanted) -> Column:
    """True if the parsed code array holds any wanted code. NULL array -> False."""
    return F.coalesce(F.arrays_overlap(as_col(codes), F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def is_missing(text: Column | str, tokens=V.MISSING_TOKENS) -> Column:
    c = as_col(text)
    return c.isNull() | c.isin(*tokens)


def to_int(text: Column | str) -> Column:
    c = as_col(text)
    return F.when(c.rlike(V.INT_PATTERN), c.try_cast("bigint"))


def looks_decimal(text: Column | str) -> Column:
    return as_col(text).rlike(V.DECIMAL_PATTERN)


def to_decimal(text: Column | str) -> Column:
    c = as_col(text)
    return F.when(looks_decimal(c), c.try_cast(SCORE_TYPE))


def cut_decimals(text: Column | str) -> Column:
    """Whether a decimal's text has digits, other than zeros, beyond those the type keeps."""
    c = as_col(text)
    return (F.length(c) > SCORE_PRECISION[1] + 2) & c.rlike(V.CUT_DECIMALS_PATTERN)     # no shorter text has the form


def to_date_mdy(text: Column | str) -> Column:
    """``MM/DD/YYYY`` prefix to a date; trailing text is ignored, impossible dates are NULL."""
    c = as_col(text)
    return F.when(c.rlike(V.DATE_PREFIX_PATTERN), mdy_value(c))


def mdy_value(text: Column | str) -> Column:
    """The date of a text that is known to start like ``MM/DD/YYYY``; impossible dates are NULL."""
    c = as_col(text)
    return F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 1, 2), F.substring(c, 4, 2)).try_cast("date")


def last_token(text: Column | str) -> Column:
    """Part after the last underscore; NULL when there is none."""
    return F.trim(F.regexp_substr(as_col(text), F.lit(V.LAST_TOKEN_PATTERN)))


def split_score(text: Column | str) -> tuple[Column, Column, Column]:
    """One mixed score column -> (numeric, text, available). What the numeric column cannot hold stays as text."""
    c = as_col(text)
    present, number = ~is_missing(c), to_decimal(c)
    return number, F.when(present & number.isNull(), c), present
