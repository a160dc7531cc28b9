"""Reconciling row versions: upserts, signed rows and tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_version(
    df: DataFrame,
    keys: Sequence[str],
    version: str,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Keep the newest row per key.

    An aggregate, not a window: map-side combine leaves one row per key and
    task, so a key with very many versions never gathers in one task. Rows that
    tie on version and tie-break are settled by their remaining columns in
    column order, which keeps retried tasks deterministic.
    """
    lead = [version, *tiebreak]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    newest = F.max(F.struct(*lead, *rest)).alias("newest")
    return df.groupBy(*keys).agg(newest).select(
        *[F.col(c) if c in keys else F.col(f"newest.`{c}`").alias(c) for c in df.columns]
    )


def drop_deleted(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Remove keys whose newest row is a tombstone."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def collapse_by_sign(
    df: DataFrame,
    keys: Sequence[str],
    sign: str,
    order: Sequence[str],
) -> DataFrame:
    """Cancel +1/-1 pairs; keep the last +1 row of each key left positive."""
    rest = [c for c in df.columns if c not in keys and c not in order and c != sign]
    last = F.max(F.when(F.col(sign) == 1, F.struct(*order, *rest))).alias("last")
    balance = F.sum(F.col(sign).cast("bigint")).alias("balance")
    out = [
        F.col(c) if c in keys
        else F.lit(1).cast(df.schema[c].dataType).alias(c) if c == sign
        else F.col(f"last.`{c}`").alias(c)
        for c in df.columns
    ]
    return df.groupBy(*keys).agg(balance, last).filter("balance > 0").select(*out)


GPT_USAGE_KEYS = ("team_id", "gizmo_id", "author_user_id")


def gpt_usage_current(gpt_usage: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest row per team, assistant and author, by detection time."""
    current = latest_by_version(gpt_usage, GPT_USAGE_KEYS, "detected_at", tiebreak)
    return drop_deleted(current) if "is_deleted" in current.columns else current


def current_tests(tests: DataFrame, order: Sequence[str] = ("updatedAt",)) -> DataFrame:
    return collapse_by_sign(tests, ("id", "scenarioId", "targetId"), "sign", order)


def current_test_runs(test_runs: DataFrame, order: Sequence[str] = ("runAt",)) -> DataFrame:
    return collapse_by_sign(test_runs, ("id",), "sign", order)
