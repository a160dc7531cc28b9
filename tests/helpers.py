from __future__ import annotations

from pyspark.sql import DataFrame


def collected(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Rows as sorted text, in a fixed column order."""
    columns = columns or sorted(df.columns)
    return sorted(str(tuple(row)) for row in df.select(*columns).collect())


def same(left: DataFrame, right: DataFrame) -> None:
    assert sorted(left.columns) == sorted(right.columns)
    columns = sorted(left.columns)
    assert collected(left, columns) == collected(right, columns)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
