"""Partial aggregates that can be merged, stored and finished later.

A `Rollup` names its grouping keys and measures once. The same definition
serves three plans: `partial` over raw rows in batch, `partial` over one
micro-batch in a stream, and `merge` over stored partial rows.

Exact distinct counts hold one row per (group, id) instead of an id set in one
cell, so the busiest group is spread over all tasks like any other key. All
measures combine on the map side, so a hot key sends at most one row per task
through the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# measure kind -> (aggregate over rows, aggregate over partial rows)
_KINDS = {
    "count": ("count({0})", "sum({0})"),
    "sum": ("sum({0})", "sum({0})"),
    "min": ("min({0})", "min({0})"),
    "max": ("max({0})", "max({0})"),
    # {0} is a struct led by the ordering columns
    "first": ("min({0})", "min({0})"),
    "last": ("max({0})", "max({0})"),
    "set": (
        "sort_array(collect_set({0}))",
        "sort_array(array_distinct(flatten(collect_set({0}))))",
    ),
    "approx_distinct": ("hll_sketch_agg({0})", "hll_union_agg({0})"),
}


@dataclass(frozen=True)
class Rollup:
    name: str
    keys: tuple[str, ...]
    # output column -> (kind, SQL expression over the source rows)
    measures: dict[str, tuple[str, str]]
    # source rows -> rows to aggregate (filters, derived columns)
    rows: Callable[..., DataFrame] = field(default=lambda df: df)

    def partial(self, df: DataFrame, *others: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """Aggregate source rows, by default on the rollup's own keys."""
        return _aggregate(self.rows(df, *others), keys or self.keys, [
            F.expr(_KINDS[kind][0].format(expr)).alias(out)
            for out, (kind, expr) in self.measures.items()
        ])

    def merge(self, state: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """Combine partial rows, by default on the rollup's own keys."""
        return _aggregate(state, keys or self.keys, [
            F.expr(_KINDS[kind][1].format(f"`{out}`")).alias(out)
            for out, (kind, _) in self.measures.items()
        ])


@dataclass(frozen=True)
class Kept:
    """Rows stored beside roll-ups as they are, for lists that no cell can hold.

    `keys` order the rows; they need not be unique. Merging changes nothing.
    """

    name: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    rows: Callable[..., DataFrame] = field(default=lambda df: df)

    def partial(self, df: DataFrame, *others: DataFrame) -> DataFrame:
        return self.merge(self.rows(df, *others))

    def merge(self, state: DataFrame) -> DataFrame:
        return state.select(*self.keys, *self.measures)


def _aggregate(df: DataFrame, keys: Sequence[str], measures: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*measures)


def merge_states(state: DataFrame, keys: Sequence[str], spec: dict[str, str]) -> DataFrame:
    """Finish partial rows; `spec` maps each state column to its kind."""
    return _aggregate(state, keys, [
        F.expr(_KINDS[kind][1].format(f"`{column}`")).alias(column)
        for column, kind in spec.items()
    ])


def sum_counters(state: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Add up counter columns per key."""
    return merge_states(state, keys, dict.fromkeys(counters, "sum"))
