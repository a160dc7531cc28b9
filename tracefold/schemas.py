"""Table schemas. Strings, numbers and flags are never NULL unless noted: a
missing value loads as '' or 0."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _table(columns: str) -> T.StructType:
    """A schema from "name type, ..." text, without a running session."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_TRACE = (
    "app_id string, team_id string, trace_id string, parent_id string, interaction_id string, "
    "conversation_id string, session_id string, start_timestamp bigint, end_timestamp bigint, latency int, "
    "input string, output string, feedback_tag string, feedback_text string, channel_id string, "
    "user_id string, user_ip string, user_email string, user_phone string, location string, locale string, "
    "device string, os string, browser string, task string, custom string"
)

TRACES = _table(_TRACE)

TRACES_PROCESSED = _table(
    ", ".join(f"{c.split()[0].upper()} {c.split()[1]}" for c in _TRACE.split(", "))
    + ", OUTPUT_CLASSIFIERS string, TOKENS_SPENT_PROMPT int, TOKENS_SPENT_RESPONSE int, "
    "READABILITY_RESPONSE double, NUM_WORDS_PROMPT int, NUM_WORDS_RESPONSE int, "
    "LANG_PROMPT string, LANG_RESPONSE string, "
    "SENTIMENT_PROMPT string, SENTIMENT_PROMPT_POSITIVE double, SENTIMENT_PROMPT_NEGATIVE double, "
    "SENTIMENT_PROMPT_NEUTRAL double, SENTIMENT_RESPONSE string, SENTIMENT_RESPONSE_POSITIVE double, "
    "SENTIMENT_RESPONSE_NEGATIVE double, SENTIMENT_RESPONSE_NEUTRAL double"
)

METRICS = _table(
    "gateway_id string, engine_id string, trace_id string, interaction_id string, conversation_id string, "
    "path string, input string, output string, session_id string, task string, type string, "
    "start_timestamp bigint, end_timestamp bigint, latency int, user_ip string, params string, method string, "
    "upstream string, plugin string, request_headers string, response_headers string, status_code int"
)

DISCOVER_EVENTS = _table(
    "timestamp bigint, submission_timestamp bigint, event_type string, user_id string, user_email string, "
    "action string, application_id string, application_name string, url string, session_id string, "
    "team_id string, tab_id bigint, extension_version string, user_agent string, prompt_text string, "
    "content_length bigint, sensitive_data_types array<string>, sensitive_data_categories array<string>, "
    "sensitive_data_level string, sensitive_data_count bigint, detection_method string, category string, "
    "frame_type string, date date, hour timestamp, has_sensitive_data int, is_blocked int, is_warned int, "
    "event_format string"
)
# Columns that may be NULL, and columns computed when absent.
DISCOVER_NULLABLE = (
    "tab_id", "extension_version", "user_agent", "prompt_text", "content_length", "sensitive_data_level",
    "detection_method", "category", "frame_type",
    "date", "hour", "has_sensitive_data", "is_blocked", "is_warned", "event_format",
)

GPT_USAGE = _table(
    "team_id string, gizmo_id string, name string, description string, author_user_id string, "
    "author_display_name string, author_is_verified int, categories array<string>, created_at string, "
    "updated_at string, num_interactions bigint, model string, tools array<string>, kind string, "
    "tags array<string>, share_recipient string, workspace_id string, organization_id string, "
    "sharing_targets string, current_sharing string, workspace_approved int, "
    "workspace_approval_date string, detected_at bigint, timestamp string, extensionVersion string"
)

AGENT_TRACES = _table("raw_json string, ingested_at timestamp, ingested_date date")

# Sort keys, the date that partitions a table by month, and how long rows live.
LAYOUT = {
    "traces": (("event_hour", "app_id", "conversation_id", "interaction_id"), "event_date", "12 MONTHS"),
    "traces_processed": (("EVENT_HOUR", "APP_ID", "CONVERSATION_ID", "INTERACTION_ID"), "EVENT_DATE", "12 MONTHS"),
    "metrics": (("event_hour", "gateway_id", "engine_id", "trace_id"), "event_date", "12 MONTHS"),
    "discover_events": (("team_id", "timestamp", "session_id"), "date", "12 MONTHS"),
    "gpt_usage": (("team_id", "gizmo_id", "author_user_id"), "event_date", "12 MONTHS"),
    "agent_traces": (("ingested_at",), "ingested_date", "7 DAYS"),
    "tool_requests": (("team_id", "agent_id", "tool_id", "timestamp"), "date", "90 DAYS"),
    "agent_requests": (("team_id", "agent_id", "timestamp"), "date", "90 DAYS"),
    "guardian_invocations": (("team_id", "agent_id", "timestamp"), "date", "90 DAYS"),
}

# Columns of discover_events that point lookups filter on.
DISCOVER_BLOOM = (
    "team_id", "application_id", "event_type", "action", "session_id", "sensitive_data_level", "category",
)

# Values that enumerated columns may take. Fixed values.
ENUMS = {
    "agents": {"risk_level": ("Low", "Medium", "High"), "status": ("Active", "Disabled", "Quarantined")},
    "tool_requests": {"status": ("success", "error", "blocked", "pending")},
    "agent_requests": {"status": ("success", "error", "timeout", "cancelled")},
    "agent_dependencies": {
        "target_type": ("agent", "tool"),
        "dependency_type": ("calls", "uses", "monitors", "processes"),
    },
    "guardian_invocations": {"result": ("allowed", "blocked", "flagged")},
}
