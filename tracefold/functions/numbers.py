"""Ratios that stay NULL, not an error, on an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(part: str | Column, whole: str | Column) -> Column:
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def percent(part: str | Column, whole: str | Column) -> Column:
    return F.try_divide(F.lit(100.0) * col(part).cast("double"), col(whole).cast("double"))


def or_zero(value: str | Column) -> Column:
    """Counters of an unmatched outer join are zero, not NULL."""
    return F.coalesce(col(value), F.lit(0))
