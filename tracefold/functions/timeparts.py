"""Epoch-millisecond columns to calendar columns, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions.numbers import col

DAY_MS = 86_400_000
MINUTE_MS = 60_000


def second_of(ms: str | Column) -> Column:
    """Timestamp with whole seconds; the fraction is dropped, not rounded."""
    return F.timestamp_seconds(F.floor(col(ms) / F.lit(1000)))


def date_of(ms: str | Column) -> Column:
    return F.date_from_unix_date(F.floor(col(ms) / F.lit(DAY_MS)).cast("int"))


def hour_of(ms: str | Column) -> Column:
    return F.date_trunc("hour", second_of(ms))


def month_of(date: str | Column) -> Column:
    """yyyymm as an integer: the partition column of every table."""
    return (F.year(col(date)) * 100 + F.month(col(date))).cast("int")


def minutes(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000) / F.lit(60)


def ago(as_of: str | Column, interval: str) -> Column:
    """`as_of` less an interval such as '24 HOURS'."""
    return _moment(as_of) - F.expr(f"INTERVAL {interval}")


def _moment(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


# Spellings that are not ISO 8601: shape of the text and its pattern. Fixed values.
OTHER_TIMESTAMPS = (
    (r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d$", "dd/MM/yyyy HH:mm:ss"),
    (r"^\d\d/\d\d/\d{4}$", "dd/MM/yyyy"),
    (r"^\d\d-[A-Za-z]{3}-\d{4} \d\d:\d\d:\d\d$", "dd-MMM-yyyy HH:mm:ss"),
    (r"^\d\d [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d$", "dd MMM yyyy HH:mm:ss"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{8}$", "yyyyMMdd"),
)


def parse_any_timestamp(text: str | Column) -> Column:
    """Best-effort reading of free-form time text; NULL when nothing fits.

    ISO 8601 dates and times, ten- and thirteen-digit epoch numbers, and the
    spellings above. A leading weekday and a trailing GMT or UTC are skipped.
    The shape decides which single parser runs: a parser that fails is far
    dearer than a pattern that does not match.
    """
    value = F.regexp_replace(F.trim(col(text)), r"^[A-Za-z]{3}, | (GMT|UTC)$", "")
    parsed = (
        F.when(value.rlike(r"^\d{4}-\d"), value.try_cast("timestamp"))
        .when(value.rlike(r"^\d{10}$"), F.timestamp_seconds(value.try_cast("bigint")))
        .when(value.rlike(r"^\d{13}$"), F.timestamp_millis(value.try_cast("bigint")))
    )
    for shape, pattern in OTHER_TIMESTAMPS:
        parsed = parsed.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)))
    return parsed
