"""Typed attributes: the methods that each primitive type offers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, numbers, strings
from ..model.milestoning import date_lit, datetime_lit
from .expr import Aggregate, ColumnRef, Expr, Function, Literal, Sort, Test, WindowFunction, spec


def _compare(name: str):
    def method(self, value) -> Test:
        other = value if isinstance(value, Expr) else Literal(lambda: self.literal(value))
        make = {"eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}[name]
        return Test((self, other), make, name)

    method.__name__ = name
    return method


@dataclass(frozen=True)
class Attribute(ColumnRef):
    def literal(self, value) -> Column:
        return F.lit(value)

    def ascending(self) -> Sort:
        return Sort(self)

    def descending(self) -> Sort:
        return Sort(self, True)

    def is_null(self) -> Test:
        return Test((self,), Column.isNull, "is_null")

    def is_not_null(self) -> Test:
        return Test((self,), Column.isNotNull, "is_not_null")

    def count(self) -> Aggregate:
        return Aggregate(self, "count", f"{self.label} Count")

    def _function(self, label: str, make) -> Function:
        return Function(self, make, f"{label} {self.label}")

    def rank(self, method: str = "min", pct: bool = False, partition_by=None, order_by=None) -> WindowFunction:
        if method not in ("min", "dense", "first", "max"):
            raise ValueError(f"unknown rank method {method}")
        if pct:
            op = "cume_dist" if method == "max" else "percent_rank"
        else:
            op = {"first": "row_number", "dense": "dense_rank"}.get(method, "rank")
        return WindowFunction(None, op, op.replace("_", " ").title(), window=spec(partition_by, order_by))

    def qcut(self, buckets: int, partition_by=None, order_by=None) -> WindowFunction:
        return WindowFunction(None, "ntile", "Quantile", buckets, window=spec(partition_by, order_by))

    def shift(self, periods: int = 1, fill_value=None, partition_by=None, order_by=None) -> WindowFunction:
        op = "lag" if periods >= 0 else "lead"
        return WindowFunction(self, op, f"{op.title()} {self.label}", abs(periods), fill_value, spec(partition_by, order_by))

    def first(self, partition_by=None, order_by=None) -> WindowFunction:
        return WindowFunction(self, "first", f"First {self.label}", window=spec(partition_by, order_by))

    def last(self, partition_by=None, order_by=None) -> WindowFunction:
        return WindowFunction(self, "last", f"Last {self.label}", window=spec(partition_by, order_by))


class StringAttribute(Attribute):
    eq, ne = _compare("eq"), _compare("ne")

    def _like(self, pattern: str, negated: bool = False) -> Test:
        return Test((self,), lambda c: ~strings.like(c, pattern) if negated else strings.like(c, pattern), "like")

    def contains(self, value: str) -> Test:
        return self._like(f"%{value}%")

    def starts_with(self, value: str) -> Test:
        return self._like(f"{value}%")

    def ends_with(self, value: str) -> Test:
        return self._like(f"%{value}")

    def not_contains(self, value: str) -> Test:
        return self._like(f"%{value}%", True)

    def upper(self):
        return self._function("Upper", F.upper)

    def lower(self):
        return self._function("Lower", F.lower)

    def strip(self):
        return self._function("Strip", F.trim)

    def lstrip(self):
        return self._function("Lstrip", F.ltrim)

    def rstrip(self):
        return self._function("Rstrip", F.rtrim)

    def length(self):
        return self._function("Length", strings.length)

    def reverse(self):
        return self._function("Reverse", F.reverse)

    def left(self, n: int):
        return self._function("Left", lambda c: strings.left(c, n))

    def right(self, n: int):
        return self._function("Right", lambda c: strings.right(c, n))

    def repeat(self, n: int):
        return self._function("Repeat", lambda c: F.repeat(c, n))

    def replace(self, old: str, new: str):
        return self._function("Replace", lambda c: strings.replace(c, old, new))

    def substring(self, start: int, size: int | None = None):
        return self._function("Substring", lambda c: strings.substring(c, start, size))


class NumericAttribute(Attribute):
    eq, ne, gt, lt, gte, lte = map(_compare, ("eq", "ne", "gt", "lt", "gte", "lte"))

    def sum(self):
        return Aggregate(self, "sum", f"{self.label} Sum")

    def min(self):
        return Aggregate(self, "min", f"{self.label} Min")

    def max(self):
        return Aggregate(self, "max", f"{self.label} Max")

    def average(self):
        return Aggregate(self, "average", f"{self.label} Average")

    def abs(self):
        return self._function("Abs", F.abs)

    def ceil(self):
        return self._function("Ceil", numbers.ceil)

    def floor(self):
        return self._function("Floor", numbers.floor)

    def sqrt(self):
        return self._function("Sqrt", F.sqrt)

    def mod(self, n):
        return self._function("Mod", lambda c: numbers.mod(c, n, isinstance(n, float) or isinstance(self, DoubleAttribute)))

    def power(self, n):
        return self._function("Power", lambda c: F.pow(c, F.lit(n)))

    def round(self, digits: int = 0):
        return self._function("Round", lambda c: numbers.round_to(c, digits))


class IntegerAttribute(NumericAttribute):
    pass


class DoubleAttribute(NumericAttribute):
    def literal(self, value):
        return F.lit(float(value))


class FloatAttribute(DoubleAttribute):
    pass


class DecimalAttribute(NumericAttribute):
    def ceil(self):
        return self._function("Ceil", F.ceil)

    def floor(self):
        return self._function("Floor", F.floor)

    def literal(self, value):
        return F.lit(Decimal(str(value)))


class BooleanAttribute(Attribute):
    eq = _compare("eq")

    def is_true(self) -> Test:
        return self.eq(True)

    def is_false(self) -> Test:
        return self.eq(False)


class DateAttribute(Attribute):
    eq, ne, gt, lt, gte, lte = map(_compare, ("eq", "ne", "gt", "lt", "gte", "lte"))

    def literal(self, value):
        return date_lit(value)

    def _part(self, name: str):
        return self._function(name.replace("_", " ").title(), lambda c: dates.part(c, name))

    def _add(self, unit: str, n: int):
        return Function(self, lambda c: dates.add(c, unit, n), self.label)

    def _diff(self, unit: str, other: dt.datetime | dt.date | str):
        return Function(self, lambda c: dates.diff(c, unit, datetime_lit(other)), self.label)


class DateTimeAttribute(DateAttribute):
    def literal(self, value):
        return datetime_lit(value)


def _date_methods() -> None:
    """year() .. day_of_week(), add_days(n) .., subtract_days(n) .., diff_days(other) ..; time parts on datetimes only."""
    for name in dates.PARTS:
        owner = DateTimeAttribute if name in ("hour", "minute", "second") else DateAttribute
        setattr(owner, name, lambda self, name=name: self._part(name))
    for unit in dates.UNITS:
        owner = DateTimeAttribute if unit in ("HOUR", "MINUTE", "SECOND") else DateAttribute
        plural = unit.lower() + "s"
        setattr(owner, f"add_{plural}", lambda self, n, unit=unit: self._add(unit, n))
        setattr(owner, f"subtract_{plural}", lambda self, n, unit=unit: self._add(unit, -n))
        setattr(owner, f"diff_{plural}", lambda self, other, unit=unit: self._diff(unit, other))


_date_methods()
TYPES = {"String": StringAttribute, "Integer": IntegerAttribute, "Double": DoubleAttribute, "Float": FloatAttribute, "Decimal": DecimalAttribute, "Boolean": BooleanAttribute, "Date": DateAttribute, "DateTime": DateTimeAttribute}
