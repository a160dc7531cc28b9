"""Agent registry, tools, permissions, requests and dependencies from spans.

Spans are joined to their parents on (team, trace, span id). Two rules keep the
joins linear however documents are delivered:

* A span delivered again counts once, as its newest row (largest `ingested_at`,
  then document and position). Parents are reduced to one narrow row per span id
  before they are joined.
* A blank id names nothing: a span without an id is nobody's parent and is told
  from others by its place in its document; a blank parent id has no parent.

Permissions need only the distinct pairs, so their child side is aggregated
before the join and a parent with very many children meets it as a few rows.
Requests keep every child as an output row: those are plain equi joins, which
adaptive execution splits when one parent is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.merge import latest_by_version

AGENT = ["team_id", "agent_id"]
TOOL = ["team_id", "tool_id"]
PERMISSION = ["team_id", "agent_id", "tool_id"]
DEPENDENCY = ["team_id", "source_agent_id", "target_type", "target_id"]

_PARENT = ["team_id", "trace_id", "parent_id"]
_SPAN = ["team_id", "trace_id", "span_id"]


def _kind(spans: DataFrame, kind: str) -> DataFrame:
    return spans.filter(F.col("kind") == kind)


def _once(spans: DataFrame) -> DataFrame:
    """The newest row of every span; blank ids are told apart by their place."""
    place = F.when(F.col("span_id") == "", F.concat_ws("/", "doc_id", "position")).otherwise("")
    rows = latest_by_version(
        spans.withColumn("place", place), [*_SPAN, "place"], "ingested_at", ["doc_id", "position"]
    )
    return rows.drop("place")


def _children(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("parent_id") != "")


def _named_workflows(spans: DataFrame) -> DataFrame:
    """Named agents by span id, as join partners of their children."""
    newest = F.max(F.struct("ingested_at", "agent_name")).alias("newest")
    return (
        _kind(spans, "workflow")
        .filter(F.col("span_id") != "")
        .groupBy("team_id", "trace_id", F.col("span_id").alias("parent_id"))
        .agg(newest)
        .select(*_PARENT, F.col("newest.agent_name").alias("agent_id"))
        .filter(F.col("agent_id") != "")
    )


def _const(**values: str) -> list[Column]:
    return [F.lit(value).alias(name) for name, value in values.items()]


def agent_rows(spans: DataFrame) -> DataFrame:
    """A registry row for every named workflow span."""
    return _kind(spans, "workflow").filter(F.col("agent_name") != "").select(
        "team_id",
        F.col("agent_name").alias("agent_id"),
        "agent_name",
        "framework",
        *_const(policy_role="Assistant", risk_level="Low", status="Active", metadata="{}"),
        F.col("ingested_at").alias("first_seen"),
        F.col("ingested_at").alias("last_activity"),
        F.col("ingested_at").alias("updated_at"),
    )


def agents(spans: DataFrame) -> DataFrame:
    """Newest registry row per agent."""
    return latest_by_version(agent_rows(spans), AGENT, "updated_at")


def tool_rows(spans: DataFrame) -> DataFrame:
    """A catalog row for every tool span with a function name."""
    return _kind(spans, "tool").filter(F.col("function_name") != "").select(
        "team_id",
        F.col("function_name").alias("tool_id"),
        F.col("function_name").alias("tool_name"),
        *_const(tool_category="API", tool_action="execute", description=""),
        F.col("ingested_at").alias("first_seen"),
        F.col("ingested_at").alias("updated_at"),
    )


def tools(spans: DataFrame) -> DataFrame:
    """Newest catalog row per tool."""
    return latest_by_version(tool_rows(spans), TOOL, "updated_at")


def permission_uses(spans: DataFrame) -> DataFrame:
    """Agent, tool and newest use, per trace."""
    uses = (
        _children(_kind(spans, "tool"))
        .filter(F.col("function_name") != "")
        .groupBy(*_PARENT, F.col("function_name").alias("tool_id"))
        .agg(F.max("ingested_at").alias("updated_at"))
    )
    return (
        uses.join(_named_workflows(spans), _PARENT)
        .groupBy(*PERMISSION, "trace_id")
        .agg(F.max("updated_at").alias("updated_at"))
    )


def newest_permissions(uses: DataFrame) -> DataFrame:
    """One permission per agent and tool from `permission_uses`."""
    newest = uses.groupBy(*PERMISSION).agg(F.max("updated_at").alias("updated_at"))
    return newest.select(
        *PERMISSION,
        F.col("tool_id").alias("tool_name"),
        *_const(tool_category="API", tool_action="execute"),
        F.lit(True).alias("approved"),
        F.col("updated_at").alias("approved_at"),
        F.col("updated_at").alias("first_requested"),
        F.col("updated_at").alias("last_requested"),
        "updated_at",
    )


def agent_tool_permissions(spans: DataFrame) -> DataFrame:
    """Newest permission per agent and tool: every use counts as approved."""
    return newest_permissions(permission_uses(spans))


def _mentions(text: str, *needles: str) -> Column:
    """Case-sensitive containment of any needle."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.col(text).contains(needle)
    return found


# Texts by which a refused call is recognised. Fixed values.
BLOCKED_TEXTS = ("jailbreak", "Error code: 403")


def tool_requests(spans: DataFrame) -> DataFrame:
    """Every tool call made by a named agent.

    An 'ok' span without a lower-case 'error' in its output is a success even
    if the text says it was blocked; `approved` looks at the text only.
    """
    failed = _mentions("output", "error")
    blocked = _mentions("output", *BLOCKED_TEXTS)
    calls = _once(_children(_kind(spans, "tool"))).filter(F.col("called_name") != "")
    return calls.join(_named_workflows(spans), _PARENT).select(
        "team_id",
        F.col("span_id").alias("request_id"),
        "trace_id",
        "span_id",
        "agent_id",
        F.col("called_name").alias("tool_id"),
        F.col("called_name").alias("tool_name"),
        *_const(tool_category="API", tool_action="execute"),
        F.when((F.col("status") == "ok") & ~failed, "success")
        .when(blocked, "blocked")
        .otherwise("error")
        .alias("status"),
        (~blocked).alias("approved"),
        ((F.col("ended_at") - F.col("started_at")) * 1000).alias("duration_ms"),
        F.col("input").alias("request_params"),
        F.col("output").alias("response_data"),
        F.when(failed, F.col("output")).otherwise("").alias("error_message"),
        F.col("ingested_at").alias("timestamp"),
        F.to_date("ingested_at").alias("date"),
    )


def dependency_edges(spans: DataFrame) -> DataFrame:
    """Edges from agents to the agents and tools they call, a row per trace and document.

    An agent calls another one directly (parent span) or through one tool span
    (grandparent span).
    """
    seen = ["trace_id", "ingested_at", "doc_id"]
    parents = _named_workflows(spans).withColumnRenamed("agent_id", "source_agent_id")
    children = _children(spans).filter(F.col("kind").isin("workflow", "tool")).select(
        *_PARENT,
        "kind",
        "span_id",
        F.when(F.col("kind") == "tool", F.col("called_name")).otherwise(F.col("agent_name")).alias("target_id"),
        "ingested_at",
        "doc_id",
    )
    linked = children.join(parents, _PARENT)
    direct = linked.filter(
        (F.col("kind") == "tool") | (F.col("target_id") != F.col("source_agent_id"))
    ).select(
        "team_id",
        "source_agent_id",
        F.when(F.col("kind") == "tool", "tool").otherwise("agent").alias("target_type"),
        "target_id",
        *seen,
    )

    bridges = (
        linked.filter((F.col("kind") == "tool") & (F.col("span_id") != ""))
        .select("team_id", "trace_id", F.col("span_id").alias("parent_id"), "source_agent_id")
        .distinct()
    )
    callees = children.filter(F.col("kind") == "workflow").select(*_PARENT, "target_id", "ingested_at", "doc_id")
    through_tool = (
        callees.join(bridges, _PARENT)
        .filter(F.col("target_id") != F.col("source_agent_id"))
        .select("team_id", "source_agent_id", F.lit("agent").alias("target_type"), "target_id", *seen)
    )

    edges = direct.unionByName(through_tool).filter(F.col("target_id") != "")
    return edges.groupBy(*DEPENDENCY, "trace_id", "doc_id").agg(
        F.min("ingested_at").alias("first_seen"), F.max("ingested_at").alias("last_seen")
    )


def count_dependencies(edges: DataFrame) -> DataFrame:
    """One row per edge of `dependency_edges`; `connection_count` is the number of distinct documents."""
    return edges.groupBy(*DEPENDENCY).agg(
        F.col("target_id").alias("target_name"),
        F.when(F.col("target_type") == "agent", "calls").otherwise("uses").alias("dependency_type"),
        F.count_distinct("doc_id").alias("connection_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("last_seen").alias("updated_at"),
    )


def agent_dependencies(spans: DataFrame) -> DataFrame:
    """Edges from agents to the agents and tools they call, with the number of documents that contain them."""
    return count_dependencies(dependency_edges(spans))


# Score texts in a refusal, strongest first, and the score without one. Fixed values.
RISK_SCORES = (("score 0.97", 0.97), ("score 0.95", 0.95), ("score 0.90", 0.90))
RISK_DEFAULT = 0.85


def guardian_invocations(spans: DataFrame) -> DataFrame:
    """Blocked tool calls as security checks; the reason is the call's whole output."""
    risk = F.lit(RISK_DEFAULT)
    for text, score in reversed(RISK_SCORES):
        risk = F.when(F.col("output").contains(text), score).otherwise(risk)
    calls = _once(_children(_kind(spans, "tool"))).filter(_mentions("output", *BLOCKED_TEXTS))
    return calls.join(_named_workflows(spans), _PARENT).select(
        "team_id",
        F.concat(F.lit("guard_"), "span_id").alias("invocation_id"),
        "trace_id",
        "agent_id",
        *_const(check_type="jailbreak_detection", result="blocked"),
        risk.cast("float").alias("risk_score"),
        F.col("output").alias("reason"),
        F.concat(F.lit('{"tool": "'), "function_name", F.lit('"}')).alias("metadata"),
        F.col("ingested_at").alias("timestamp"),
        F.to_date("ingested_at").alias("date"),
    )


def agent_requests(spans: DataFrame) -> DataFrame:
    """Every run of a named agent, with the input and output of its last LLM
    child span and the agent that called it."""
    runs = _once(_kind(spans, "workflow")).filter(F.col("agent_name") != "")
    callers = _named_workflows(spans).withColumnRenamed("agent_id", "parent_agent_id")
    llm = (
        _kind(spans, "llm")
        .filter(F.col("parent_id") != "")  # so a run without an id meets none
        .groupBy("team_id", "trace_id", F.col("parent_id").alias("span_id"))
        .agg(F.max(F.struct("started_at", "input", "output")).alias("latest"))
        .select(
            "team_id",
            "trace_id",
            "span_id",
            F.col("latest.input").alias("input_data"),
            F.col("latest.output").alias("output_data"),
        )
    )
    blank = lambda name: F.coalesce(name, F.lit("")).alias(name)
    timed = (F.col("ended_at") > 0) & (F.col("started_at") > 0)
    return (
        runs.join(callers, _PARENT, "left")
        .join(llm, ["team_id", "trace_id", "span_id"], "left")
        .select(
            "team_id",
            F.col("span_id").alias("request_id"),
            "trace_id",
            "span_id",
            F.col("agent_name").alias("agent_id"),
            blank("parent_agent_id"),
            F.col("parent_id").alias("parent_span_id"),
            F.when(F.col("status") == "error", "error").otherwise("success").alias("status"),
            F.when(timed, (F.col("ended_at") - F.col("started_at")) * 1000).otherwise(0.0).alias("duration_ms"),
            blank("input_data"),
            blank("output_data"),
            "agent_tools",
            "agent_output_type",
            "framework",
            F.lit("").alias("error_message"),
            F.col("ingested_at").alias("timestamp"),
            F.to_date("ingested_at").alias("date"),
        )
    )
