"""Sums, means and interpolation without a lost digit: a number is its whole part and a fraction below one.

Products and sums of 38-digit decimals drop decimals when they get too long. The two parts never do: whole parts are summed
as integers, fractions as units of the last decimal.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, functions as F

WHOLE, TOTAL = "decimal(27,0)", "decimal(38,0)"
DECIMALS = 12
HELD = f"decimal(38,{DECIMALS})"
UNITS = 10 ** DECIMALS


def held(value: Column) -> Column:
    """``value`` as an exact decimal; NULL for NaN, infinity and what is too large."""
    return value.try_cast(HELD)


def fraction(number: Column) -> Column:
    return number % F.lit(Decimal(1))


def whole(number: Column) -> Column:
    return (number - fraction(number)).cast(WHOLE)


def quotient(a: Column, b: Column) -> Column:
    """a / b without its remainder, for integers as decimals."""
    return ((a - a % b) / b).cast(TOTAL)


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each worked out once however often the body names it."""
    one = F.array(F.struct(*[v.alias(name) for name, v in values.items()]))
    return F.element_at(F.transform(one, body), 1)


def assembled(q: Column, rest: Column, one: Column, to_steps: Callable[[Column], Column], digits: int) -> Column:
    """q + rest / one as a decimal of ``digits``, for a rest of less than ``one`` in size.

    ``to_steps`` rounds a rest that is not negative to steps of the last digit. The parts get the same sign first, so halves
    are rounded away from zero.
    """
    def align(v: Column) -> Column:
        lower, upper = (v["q"] > 0) & (v["r"] < 0), (v["q"] < 0) & (v["r"] > 0)
        return let(size, negative=(v["q"] < 0) | ((v["q"] == 0) & (v["r"] < 0)),
                   q=F.abs(F.when(lower, v["q"] - 1).when(upper, v["q"] + 1).otherwise(v["q"])),
                   r=F.abs(F.when(lower, v["r"] + one).when(upper, v["r"] - one).otherwise(v["r"])))

    def size(v: Column) -> Column:
        step = F.lit(Decimal(1).scaleb(-digits)).cast(f"decimal({digits + 1},{digits})")
        kind = f"decimal(38,{digits})"
        total = (v["q"].cast(kind) + (to_steps(v["r"]).cast("decimal(9,0)") * step).cast(kind)).cast(kind)
        return F.when(v["negative"], (-total).cast(kind)).otherwise(total)

    return let(align, q=q, r=rest)


def sum_parts(value: Column, n: Column) -> dict[str, Column]:
    """Aggregates for the exact mean of values that stand for ``n`` rows each; see ``mean_from``.

    ``bad`` counts values that no decimal holds, or whose sum is beyond 38 digits.
    """
    number, rows = held(value), n.cast("decimal(19,0)")
    product = F.try_multiply(whole(number), rows).cast(TOTAL)
    units = (fraction(number) * F.lit(UNITS).cast("decimal(13,0)")).cast("decimal(13,0)")
    return {"whole": F.try_sum(product), "units": F.sum((units * rows).cast("decimal(32,0)")).cast(TOTAL),
            "bad": F.count_if(value.isNotNull() & product.isNull())}


def mean_from(total: Column, units: Column, bad: Column, n: Column, digits: int) -> Column:
    """Mean of ``n`` rows from ``sum_parts``, rounded half up; NULL without rows or with any bad value."""
    one = F.lit(UNITS).cast("decimal(13,0)")

    def carry(v: Column) -> Column:
        return let(divide, total=F.try_add(v["total"], v["carry"]).cast(TOTAL), units=v["units"] - v["carry"] * one, rows=v["rows"])

    def divide(v: Column) -> Column:
        return let(round_off, q=quotient(v["total"], v["rows"]), rest=((v["total"] % v["rows"]) * one + v["units"]).cast(TOTAL),
                   span=(v["rows"] * one).cast(TOTAL))

    def round_off(v: Column) -> Column:
        def steps(rest: Column) -> Column:
            twice = (rest.cast(TOTAL) * F.lit(2 * 10 ** digits).cast("decimal(9,0)")).cast(TOTAL)
            return let(lambda w: quotient(w["a"], w["b"]), a=(twice + v["span"]).cast(TOTAL), b=(v["span"] * 2).cast(TOTAL))
        return assembled(v["q"], v["rest"], v["span"], steps, digits)

    rows = F.nullif(n, F.lit(0)).cast("decimal(19,0)")
    return F.when(bad == 0, let(carry, total=total, units=units, carry=quotient(units, one), rows=rows))


def rounded(number: Column, digits: int) -> Column:
    return F.round(number, digits).cast(f"decimal(38,{digits})")


def between(low: Column, high: Column, share: Column, digits: int) -> Column:
    """low + (high - low) * share, rounded half up once, at the end. ``share`` is a decimal(9,8) from 0 to below 1."""
    def move(v: Column) -> Column:
        gap = (whole(v["high"]) - whole(v["low"])).cast(WHOLE)
        bit = (fraction(v["high"]) - fraction(v["low"])).cast("decimal(14,12)")
        return let(add, low=v["low"], moved=(gap * v["share"]).cast("decimal(36,8)"), bit=(bit * v["share"]).cast("decimal(23,20)"))

    def add(v: Column) -> Column:
        rest = (fraction(v["low"]).cast("decimal(14,12)") + fraction(v["moved"])).cast("decimal(24,20)")
        return let(carry, q=(whole(v["low"]) + whole(v["moved"])).cast(TOTAL), rest=(rest + v["bit"]).cast("decimal(25,20)"))

    def carry(v: Column) -> Column:
        q = (v["q"] + (v["rest"] - fraction(v["rest"])).cast("decimal(5,0)")).cast(TOTAL)
        return assembled(q, fraction(v["rest"]).cast("decimal(25,20)"), F.lit(Decimal(1)), steps, digits)

    def steps(rest: Column) -> Column:
        return F.round(rest.cast("decimal(25,20)"), digits) * F.lit(10 ** digits).cast("decimal(9,0)")

    return F.when(share == 0, rounded(low, digits)).otherwise(let(move, low=low, high=high, share=share))
