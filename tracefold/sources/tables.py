"""Table layout on disk, retention, lookup indexes and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold import schemas
from tracefold.functions.timeparts import ago, month_of


def with_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("yyyymm", month_of(date))


def write_monthly(
    df: DataFrame,
    path: str,
    date: str,
    order: Sequence[str],
    bloom: Sequence[str] = (),
    mode: str = "append",
    clustered: bool = False,
) -> None:
    """Write by month, each file sorted by the table's key.

    By default rows are rebalanced on (month, leading key) in one pass over the
    input: adaptive execution cuts a month or key that holds most rows into
    files of even size, and sorted row groups keep min/max statistics narrow.

    `clustered` range-partitions on (month, whole key) instead, so that whole
    files have narrow ranges. It samples the input first, which reads it twice:
    meant for rewriting tables, not for parsing records.
    """
    keys = ["yyyymm", *order]
    by_month = with_month(df, date)
    spread = by_month.repartitionByRange(*keys) if clustered else by_month.hint("rebalance", *keys[:2])
    writer = spread.sortWithinPartitions(*keys).write.mode(mode).partitionBy("yyyymm")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def write_table(df: DataFrame, path: str, table: str, **options) -> None:
    """Write one of the known tables in its own layout."""
    order, date, _ = schemas.LAYOUT[table]
    bloom = schemas.DISCOVER_BLOOM if table == "discover_events" else ()
    write_monthly(df, path, date, order, bloom, **options)


def between_dates(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Rows of a date range, with the month predicate that prunes partitions."""
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    kept = df.filter(F.col(date).between(low, high))
    if "yyyymm" in df.columns:
        kept = kept.filter(F.col("yyyymm").between(month_of(low), month_of(high)))
    return kept


def apply_retention(df: DataFrame, date: str, keep: str, as_of: str | Column) -> DataFrame:
    """Rows not yet expired: date + keep > as_of. Rows without a date have no age and stay.

    On a table partitioned by month, months that are over are not read.
    """
    moment = F.col(date).cast("timestamp")
    kept = df.filter(moment.isNull() | (moment + F.expr(f"INTERVAL {keep}") > _moment(as_of)))
    if "yyyymm" in df.columns:
        kept = kept.filter(F.col("yyyymm").isNull() | (F.col("yyyymm") >= month_of(_oldest(as_of, keep))))
    return kept


def retain(df: DataFrame, table: str, as_of: str | Column) -> DataFrame:
    """Rows of one of the known tables within its own lifetime."""
    _, date, keep = schemas.LAYOUT[table]
    return apply_retention(df, date, keep, as_of)


def invalid_values(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value outside the table's enumerations."""
    wrong = F.lit(False)
    for column, allowed in schemas.ENUMS[table].items():
        wrong = wrong | ~F.col(column).isin(*allowed)
    return df.filter(wrong)


def expired_months(df: DataFrame, keep: str, as_of: str | Column) -> DataFrame:
    """Month partitions in which every row has expired."""
    return df.filter(F.col("yyyymm") < month_of(_oldest(as_of, keep))).select("yyyymm").distinct()


def drop_expired_months(spark: SparkSession, table: str, keep: str, as_of: str | Column) -> list[int]:
    """Drop the expired month partitions of a catalog table.

    One metadata call per month; the list has at most a few entries a year.
    """
    months = [row.yyyymm for row in expired_months(spark.table(table), keep, as_of).collect()]
    for month in months:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (yyyymm = {int(month)})")
    return sorted(months)


def _moment(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def _oldest(as_of: str | Column, keep: str) -> Column:
    # One day and month ends of slack: the exact filter decides inside a month.
    return F.to_date(ago(as_of, keep)) - F.expr("INTERVAL 3 DAYS")


def snapshot_export(tables: dict[str, DataFrame], base: str, stamp: str) -> dict[str, str]:
    """Full copy of every table below `<base>/<stamp>/`; gives the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{base.rstrip('/')}/{stamp}/{name}"
        df.write.mode("errorifexists").parquet(paths[name])
    return paths
