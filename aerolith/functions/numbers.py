from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(value: Column) -> Column:
    """Text to int; what does not parse is null instead of an ANSI error."""
    return value.try_cast("int")


def to_double(value: Column) -> Column:
    return value.try_cast("double")


def to_date(value: Column) -> Column:
    return value.try_cast("date")


def or_default(value: Column, default: int | str) -> Column:
    """Default for null; a numeric default casts first, so text does not widen the type."""
    if isinstance(default, int):
        value = to_int(value)
    return F.coalesce(value, F.lit(default))


def round_even(value: Column, digits: int = 2) -> Column:
    """Scale, round half to even, scale back: NumPy's rounding of a double.

    ``F.bround`` rounds the shortest decimal text of the double instead and
    disagrees on values such as 1.015.
    """
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def exact_mean(total: Column, count: Column) -> Column:
    """Quotient of an exact sum, so the result does not depend on row order."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))
