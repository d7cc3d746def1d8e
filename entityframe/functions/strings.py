"""String functions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(c: Column) -> Column:
    return F.length(c).cast("long")


def left(c: Column, n: int) -> Column:
    """The first n characters; a negative n leaves the last -n out."""
    return F.left(c, F.lit(n)) if n >= 0 else F.left(c, F.greatest(F.length(c) + n, F.lit(0)))


def right(c: Column, n: int) -> Column:
    """The last n characters; a negative n leaves the first -n out."""
    return F.right(c, F.lit(n)) if n >= 0 else F.right(c, F.greatest(F.length(c) + n, F.lit(0)))


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def substring(c: Column, start: int, size: int | None = None) -> Column:
    """Characters from the 0-based ``start``.

    Position 0 of the 1-based SQL function (start -1) stands before the first character and uses up one of ``size``.
    """
    if start == -1:
        return c.substr(F.lit(1), F.greatest(F.lit(size) - 1, F.lit(0))) if size is not None else c
    return c.substr(F.lit(start + 1), F.lit(size) if size is not None else F.length(c))


def like(c: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash is itself."""
    return c.like(pattern.replace("\\", "\\\\"))
