"""Dimension tables: teams, apps, classifiers, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracefold.operators.merge import latest_by_version

# Credentials and request headers never leave the source. Fixed values.
SECRET_COLUMNS = ("modelApiKey", "modelExtraHeaders")


def load_dimension(rows: DataFrame, keys: tuple[str, ...] = ("id",), version: str = "updatedAt") -> DataFrame:
    """Newest row per id, without secrets, so that joins cannot multiply rows."""
    return latest_by_version(rows.drop(*SECRET_COLUMNS), keys, version)


def load_dimensions(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: load_dimension(rows) for name, rows in tables.items()}
