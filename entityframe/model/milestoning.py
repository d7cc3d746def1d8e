"""Temporal kinds of tables and their point-in-time predicates.

Intervals are half open. A date that is not given drops its dimension's predicate. An open
end is null, unless the kind says that ends are never null (``infinite_end``); the value of
the infinite end doesn't matter.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Instant = dt.datetime | dt.date | str | None


def as_datetime(value: Instant) -> dt.datetime | None:
    """A naive UTC wall-clock instant to the second."""
    if value is None:
        return None
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    return value.replace(microsecond=0)


def datetime_lit(value: Instant) -> Column:
    return F.lit(as_datetime(value).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def date_lit(value: Instant) -> Column:
    return F.lit(as_datetime(value).strftime("%Y-%m-%d")).cast("date")


def _within(table: str, start: str, end: str, at: Column, infinite_end: bool) -> Column:
    last = F.col(f"{table}.{end}")
    open_ended = last > at if infinite_end else (last > at) | last.isNull()
    return (F.col(f"{table}.{start}") <= at) & open_ended


class Milestoning:
    uses_business = uses_processing = False

    def columns(self) -> list[str]:
        """The table's columns that hold the dates."""
        return [v for f in (dataclasses.fields(self) if dataclasses.is_dataclass(self) else ()) if isinstance(v := getattr(self, f.name), str)]

    def predicates(self, table: str, business: Instant, processing: Instant) -> list[Column]:
        return []

    def predicate(self, table: str, business: Instant, processing: Instant) -> Column | None:
        out = None
        for p in self.predicates(table, business, processing):
            out = p if out is None else out & p
        return out

    def gate(self, business: Instant, processing: Instant) -> tuple[Instant, Instant]:
        """The dates that a root of this kind passes on, to itself and to what it joins."""
        return (business if self.uses_business else None, processing if self.uses_processing else None)


@dataclass(frozen=True)
class Processing(Milestoning):
    start: str
    end: str
    infinite_end: bool = False
    uses_processing = True

    def predicates(self, table, business, processing):
        return [] if processing is None else [_within(table, self.start, self.end, datetime_lit(processing), self.infinite_end)]


@dataclass(frozen=True)
class BusinessDate(Milestoning):
    date: str
    uses_business = True

    def predicates(self, table, business, processing):
        return [] if business is None else [F.col(f"{table}.{self.date}") == date_lit(business)]


@dataclass(frozen=True)
class BusinessDateAndProcessing(Milestoning):
    date: str
    start: str
    end: str
    infinite_end: bool = False
    uses_business = uses_processing = True

    def predicates(self, table, business, processing):
        return BusinessDate(self.date).predicates(table, business, None) + Processing(self.start, self.end, self.infinite_end).predicates(table, None, processing)


@dataclass(frozen=True)
class BiTemporal(Milestoning):
    business_from: str
    business_to: str
    start: str
    end: str
    infinite_end: bool = False
    uses_business = uses_processing = True

    def predicates(self, table, business, processing):
        first = [] if business is None else [_within(table, self.business_from, self.business_to, date_lit(business), self.infinite_end)]
        return first + Processing(self.start, self.end, self.infinite_end).predicates(table, None, processing)


NONE = Milestoning()
