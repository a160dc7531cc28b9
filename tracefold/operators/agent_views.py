"""Read views over the agent tables, as of a given moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.numbers import or_zero
from tracefold.functions.timeparts import ago
from tracefold.operators.agents import AGENT, DEPENDENCY, PERMISSION


def _latest(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], *extra: Column
) -> DataFrame:
    """Values of the row updated last, with other aggregates next to them."""
    newest = F.max(F.struct("updated_at", *values)).alias("newest")
    names = df.groupBy(*keys).agg(newest, *extra)
    kept = [c for c in names.columns if c not in (*keys, "newest")]
    return names.select(*keys, *[f"newest.{value}" for value in values], *kept)


def v_agents_with_metrics(
    agents: DataFrame,
    guardian_invocations: DataFrame,
    agent_requests: DataFrame,
    agent_tool_permissions: DataFrame,
    as_of: str | Column,
) -> DataFrame:
    """Agents with a day's checks and requests, all requests, and their tools."""
    day_ago = ago(as_of, "24 HOURS")
    known = _latest(
        agents,
        AGENT,
        ("agent_name", "framework", "policy_role", "risk_level", "status"),
        F.max("last_activity").alias("last_activity"),
    )
    checks = (
        guardian_invocations.filter(F.col("timestamp") >= day_ago)
        .groupBy(*AGENT)
        .agg(F.count("*").alias("guardian_invocations_24h"))
    )
    requests = agent_requests.groupBy(*AGENT).agg(
        F.count_if(F.col("timestamp") >= day_ago).alias("requests_24h"),
        F.count("*").alias("requests_total"),
    )
    allowed = (
        agent_tool_permissions.filter("approved")
        .groupBy(*AGENT)
        .agg(F.sort_array(F.collect_set("tool_name")).alias("allowed_tools"))
    )
    counters = ("guardian_invocations_24h", "requests_24h", "requests_total")
    joined = known.join(checks, AGENT, "left").join(requests, AGENT, "left").join(allowed, AGENT, "left")
    return joined.select(
        *known.columns,
        *[or_zero(name).alias(name) for name in counters],
        F.coalesce("allowed_tools", F.array().cast("array<string>")).alias("allowed_tools"),
    )


def v_agent_permissions_with_metrics(
    agent_tool_permissions: DataFrame, tool_requests: DataFrame, as_of: str | Column
) -> DataFrame:
    """Permissions with the tool calls of the last day and the last 30 days."""
    known = _latest(
        agent_tool_permissions,
        PERMISSION,
        ("tool_name", "tool_category", "tool_action", "approved"),
        F.max("last_requested").alias("last_requested"),
    )
    calls = (
        tool_requests.filter(F.col("timestamp") >= ago(as_of, "30 DAYS"))
        .groupBy(*PERMISSION)
        .agg(
            F.count_if(F.col("timestamp") >= ago(as_of, "24 HOURS")).alias("requests_24h"),
            F.count("*").alias("requests_1m"),
        )
    )
    return known.join(calls, PERMISSION, "left").select(
        *known.columns, *[or_zero(name).alias(name) for name in ("requests_24h", "requests_1m")]
    )


def v_agent_dependency_graph(agent_dependencies: DataFrame, as_of: str | Column) -> DataFrame:
    """Edges seen in the last seven days, busiest first."""
    edges = _latest(
        agent_dependencies,
        DEPENDENCY,
        ("target_name", "dependency_type"),
        F.sum("connection_count").alias("connection_count"),
        F.max("last_seen").alias("last_seen"),
    )
    return edges.filter(F.col("last_seen") >= ago(as_of, "7 DAYS")).orderBy(
        F.desc("connection_count"), *DEPENDENCY
    )
