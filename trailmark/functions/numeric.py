"""Rounding, guarded ratios and order-independent sums of prices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Sums of prices are kept as whole units (in two parts, so that they do not
# overflow) and millionths in bigints: a sum of doubles depends on the order in
# which partitions are merged, which would make the last digit vary between
# runs. What a value has beyond millionths, if it is more than the rounding of a
# double, and values that are too large for whole units (or infinite) are added
# as doubles on the side.
LARGEST_EXACT = 9e15
HIGH_UNIT = 1 << 26
MILLIONTH = Decimal("0.000001")
ROUNDING = 2.0**-51


def round_to(value: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as numpy and pandas do."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent; 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, round_to(part / whole * F.lit(100.0), digits)).otherwise(F.lit(0.0))


def sum_parts(value: Column) -> dict[str, Column]:
    """The aggregates of an exact sum; they can be summed again level by level."""
    small = F.abs(value) < LARGEST_EXACT
    units = F.floor(value)
    fraction = value - units
    millionths = F.rint(fraction * 1e6)
    rest = fraction - millionths / 1e6
    is_more = F.abs(rest) > F.abs(value) * ROUNDING + 1e-16
    return {
        "high_units": F.sum(F.when(small, F.floor(units / HIGH_UNIT))),
        "units": F.sum(F.when(small, F.pmod(units, F.lit(HIGH_UNIT)))),
        "millionths": F.sum(F.when(small, millionths).cast("bigint")),
        "rest": F.sum(F.when(~small, value).when(is_more, rest)),
    }


def sum_total(high_units: Column, units: Column, millionths: Column, rest: Column) -> Column:
    """Put an exact sum together; null when there were no values."""
    whole = high_units.cast("decimal(20,0)") * F.lit(Decimal(HIGH_UNIT)) + units.cast("decimal(20,0)")
    exact = (whole + millionths.cast("decimal(20,0)") * F.lit(MILLIONTH)).cast("double")
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def exact_mean(value: Column) -> Column:
    """Aggregate: mean of the non-null values, independent of row order."""
    return F.when(F.count(value) > 0, sum_total(**sum_parts(value)) / F.count(value))
