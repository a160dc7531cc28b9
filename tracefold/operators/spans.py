"""Spans of agent-trace documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.json import json_array, json_float, json_str, parse


def explode_spans(agent_traces: DataFrame, blank_as_null: bool = False) -> DataFrame:
    """One row per span of every document's traces; `doc_id` and `position` name its place.

    Each document is parsed once, into VARIANT; the fields of a span are then
    read by path. Documents that are not JSON give no span (see
    `unparsed_documents`).

    By default a missing team or function name is ''. `blank_as_null=True`
    falls back to the resource's team ('default' when that is missing too), to
    the span's name as the function name, and to 'unknown' for the framework.
    """
    if blank_as_null:
        team = F.coalesce(
            json_str("doc", "$.team_id", True), json_str("doc", "$.resource.team_id", True), F.lit("default")
        )
        framework = F.coalesce(json_str("doc", "$.resource.library_name", True), F.lit("unknown"))
        called = F.coalesce(
            json_str("span", "$.attributes.function_name", True), json_str("span", "$.name")
        )
    else:
        team = json_str("doc", "$.team_id")
        framework = json_str("doc", "$.resource.library_name")
        called = json_str("span", "$.attributes.function_name")

    docs = agent_traces.select(
        parse("raw_json").alias("doc"), F.md5("raw_json").alias("doc_id"), "ingested_at"
    )
    traces = docs.select(
        "doc_id",
        "ingested_at",
        team.alias("team_id"),
        framework.alias("framework"),
        F.posexplode(json_array("doc", "$.traces")).alias("trace_no", "trace"),
    )
    spans = traces.select(
        "doc_id",
        "ingested_at",
        "team_id",
        "framework",
        "trace_no",
        json_str("trace", "$.trace_id").alias("trace_id"),
        F.posexplode(json_array("trace", "$.spans")).alias("span_no", "span"),
    )
    return spans.select(
        "doc_id",
        F.concat_ws("/", "trace_no", "span_no").alias("position"),
        "ingested_at",
        "team_id",
        "framework",
        "trace_id",
        json_str("span", "$.id").alias("span_id"),
        json_str("span", "$.parent_id").alias("parent_id"),
        json_str("span", "$.kind").alias("kind"),
        json_str("span", "$.name").alias("name"),
        json_str("span", "$.status").alias("status"),
        json_float("span", "$.started_at").alias("started_at"),
        json_float("span", "$.ended_at").alias("ended_at"),
        json_str("span", "$.attributes.agent_name").alias("agent_name"),
        json_str("span", "$.attributes.function_name").alias("function_name"),
        called.alias("called_name"),
        json_str("span", "$.attributes.input").alias("input"),
        json_str("span", "$.attributes.output").alias("output"),
        json_str("span", "$.attributes.agent_tools").alias("agent_tools"),
        json_str("span", "$.attributes.agent_output_type").alias("agent_output_type"),
    )


def write_spans(agent_traces: DataFrame, path: str, mode: str = "append", **options) -> DataFrame:
    """Store the spans and read them back.

    Operators that use spans several times should read them from here: the
    documents are parsed once, and each use reads only its own columns and the
    kinds of span it filters on.
    """
    spans = explode_spans(agent_traces, **options)
    spans.write.mode(mode).parquet(path)
    return agent_traces.sparkSession.read.schema(spans.schema).parquet(path)


def unparsed_documents(agent_traces: DataFrame) -> DataFrame:
    """Documents that yield no spans because they are not JSON."""
    return agent_traces.filter(parse("raw_json").isNull())
