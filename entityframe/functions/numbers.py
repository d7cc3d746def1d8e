"""Numeric functions; ceilings and floors of integers and doubles are doubles, of decimals decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on every double is a whole number.
WHOLE = 2.0**52


def _whole(c: Column, rounded: Column) -> Column:
    return F.when(F.abs(c) < WHOLE, rounded.cast("double")).otherwise(c.cast("double"))


def ceil(c: Column) -> Column:
    return _whole(c, F.ceil(F.when(F.abs(c) < WHOLE, c)))


def floor(c: Column) -> Column:
    return _whole(c, F.floor(F.when(F.abs(c) < WHOLE, c)))


def mod(c: Column, n: float, in_double: bool = False) -> Column:
    """The remainder; by zero it is not a number in doubles, and an error otherwise."""
    if in_double and n == 0:
        return F.when(c.isNotNull(), F.lit(float("nan")))
    return c % F.lit(n)


def round_to(c: Column, digits: int = 0) -> Column:
    return F.round(c, digits)
