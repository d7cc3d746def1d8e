"""Date and datetime functions on zoneless timestamps.

Differences count the unit boundaries between two instants, not full units, and are the
same in every session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "day_of_week": lambda c: F.dayofweek(c) - 1,
}
UNITS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")


def part(c: Column, name: str) -> Column:
    return PARTS[name](c).cast("long")


def add(c: Column, unit: str, n: int) -> Column:
    """A timestamp ``n`` units later; month ends are kept within the month."""
    return F.timestamp_add(unit, F.lit(n), c.cast("timestamp_ntz"))


def diff(c: Column, unit: str, other: Column) -> Column:
    """Boundaries of ``unit`` from ``c`` to ``other``."""
    years = F.year(other) - F.year(c)
    if unit == "YEAR":
        return years.cast("long")
    if unit == "MONTH":
        return (years * 12 + F.month(other) - F.month(c)).cast("long")
    out = F.datediff(other, c).cast("long")
    for name, step, take in (("DAY", 1, None), ("HOUR", 24, F.hour), ("MINUTE", 60, F.minute), ("SECOND", 60, F.second)):
        if take is not None:
            out = out * step + take(other) - take(c)
        if name == unit:
            return out.cast("long")
    raise ValueError(f"unknown unit {unit}")
