"""Derived columns of the event tables, added when rows are loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.timeparts import date_of, hour_of, parse_any_timestamp, second_of

# Event types sent by the first extension protocol. Fixed values.
OLD_EVENT_TYPES = ("navigation", "widget_detected")


def _timed(df: DataFrame, upper: bool) -> DataFrame:
    name = str.upper if upper else str.lower
    start, end = name("start_timestamp"), name("end_timestamp")
    return df.withColumns({
        name("start_time"): second_of(start),
        name("end_time"): second_of(end),
        name("event_date"): date_of(start),
        name("event_hour"): hour_of(start),
    })


def traces_enriched(traces: DataFrame) -> DataFrame:
    """Times, date and hour of raw traces."""
    return _timed(traces, upper=False)


def traces_processed_enriched(traces_processed: DataFrame) -> DataFrame:
    """Times, date and hour of traces with KPIs."""
    return _timed(traces_processed, upper=True)


def metrics_enriched(metrics: DataFrame) -> DataFrame:
    """Times, date and hour of gateway metrics."""
    return _timed(metrics, upper=False)


def discover_events_enriched(events: DataFrame) -> DataFrame:
    """Defaults of browser events; values sent with the event win.

    `hour` keeps its minutes and seconds.
    """
    def flag(condition):
        return F.when(condition, 1).otherwise(0)

    count = F.coalesce("sensitive_data_count", F.lit(0)) if "sensitive_data_count" in events.columns else F.lit(0)
    events = events.withColumn("sensitive_data_count", count.cast("bigint"))
    defaults = {
        "sensitive_data_types": F.array().cast("array<string>"),
        "sensitive_data_categories": F.array().cast("array<string>"),
        "date": date_of("timestamp"),
        "hour": second_of("timestamp"),
        "has_sensitive_data": flag(F.col("sensitive_data_count") > 0),
        "is_blocked": flag(F.col("action") == "block"),
        "is_warned": flag(F.col("action") == "warn"),
        "event_format": F.when(F.col("event_type").isin(*OLD_EVENT_TYPES), "old").otherwise("new"),
    }
    return events.withColumns({
        name: F.coalesce(name, value) if name in events.columns else value
        for name, value in defaults.items()
    })


def gpt_usage_enriched(gpt_usage: DataFrame) -> DataFrame:
    """Detection time, and date and hour read from the free-form time text."""
    at = parse_any_timestamp("timestamp")
    return gpt_usage.withColumns({
        "detected_time": second_of("detected_at"),
        "event_date": F.to_date(at),
        "event_hour": F.date_trunc("hour", at),
    })
