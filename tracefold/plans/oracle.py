"""DuckDB SQL giving the same rows as each named query.

Written from the meaning of each figure, not from the Spark plans: direct
distinct counts, windows and subqueries over the derived input.
"""

from __future__ import annotations

from tracefold.functions.enrich import FUNCTION_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS
from tracefold.plans import derive


def _derived(name: str, expressions: dict[str, str], source: str) -> str:
    columns = ",\n  ".join(f'{expr} as "{out}"' for out, expr in derive.render(expressions, derive.DUCKDB).items())
    return f"{name} as (select\n  {columns}\n from {source})"


_DATE = "date '1970-01-01' + cast({0} // 86400000 as int)"
_SECOND = "make_timestamp(({0} // 1000) * 1000000)"

APPS = _derived("apps", derive.APPS, "nation")
TP0 = _derived("tp0", derive.TRACES_PROCESSED, "events")
TP = TP0 + f", tp as (select *, {_DATE.format('START_TIMESTAMP')} as EVENT_DATE from tp0)"
MSG = TP + ", msg as (select * from tp where TASK = 'message')"
KNOWN = MSG + ", " + APPS + (
    ", known as (select msg.*, inputCost, outputCost,"
    " TOKENS_SPENT_PROMPT * inputCost + TOKENS_SPENT_RESPONSE * outputCost as COST"
    " from msg join apps on id = APP_ID)"
)


def _q(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"


# --- usage ----------------------------------------------------------------------

_FLAGS = {
    "sentiment_prompt_positive": "SENTIMENT_PROMPT_POSITIVE > 0.5",
    "sentiment_prompt_negative": "SENTIMENT_PROMPT_NEGATIVE > 0.5",
    "sentiment_response_positive": "SENTIMENT_RESPONSE_POSITIVE > 0.5",
    "sentiment_response_negative": "SENTIMENT_RESPONSE_NEGATIVE > 0.5",
    "feedback_positive": "FEEDBACK_TAG = 'positive'",
    "feedback_negative": "FEEDBACK_TAG = 'negative'",
}

_USAGE = "usage as (select APP_ID, EVENT_DATE, EVENT_DATE as day," + ", ".join([
    "count(distinct INTERACTION_ID) as messages_count",
    "count(distinct CONVERSATION_ID) as conversations_count",
    "min(START_TIMESTAMP) as min_start_timestamp",
    "max(END_TIMESTAMP) as max_end_timestamp",
    "avg(NUM_WORDS_PROMPT) as avg_prompt_words",
    "avg(NUM_WORDS_RESPONSE) as avg_response_words",
    "cast(sum(TOKENS_SPENT_PROMPT) as bigint) as prompt_tokens",
    "cast(sum(TOKENS_SPENT_RESPONSE) as bigint) as response_tokens",
    "avg(TOKENS_SPENT_PROMPT) as avg_prompt_tokens",
    "avg(TOKENS_SPENT_RESPONSE) as avg_response_tokens",
    "sum(TOKENS_SPENT_PROMPT * inputCost) as prompt_cost",
    "sum(TOKENS_SPENT_RESPONSE * outputCost) as response_cost",
    "sum(COST) as total_cost",
    "avg(LATENCY) as avg_latency",
    *[f"count(distinct INTERACTION_ID) filter (where {cond}) as {name}" for name, cond in _FLAGS.items()],
    "avg(READABILITY_RESPONSE) as readability",
]) + " from known group by all)"

_USERS = (
    "ranked as (select APP_ID, EVENT_DATE, USER_ID, SESSION_ID, LOCATION,"
    " START_TIMESTAMP = min(START_TIMESTAMP) over (partition by APP_ID, USER_ID) as is_first"
    " from msg where USER_ID <> ''),"
    " users as (select APP_ID, EVENT_DATE, EVENT_DATE as day, count(distinct USER_ID) as users_count,"
    " count(distinct case when is_first then USER_ID end) as new_users_count,"
    " count(distinct SESSION_ID) as sessions_count, count(distinct LOCATION) as countries_count"
    " from ranked group by all)"
)
_COUNTRY_LIST = (
    "per_country as (select APP_ID, EVENT_DATE, LOCATION, count(*) as n from ranked group by all),"
    " country_list as (select APP_ID, EVENT_DATE, EVENT_DATE as day, count(*) as countries_count,"
    " string_agg(LOCATION || ':' || n, ',' order by LOCATION) as countries from per_country group by all)"
)

_RATES = ", ".join(f"100e0 * {name} / messages_count as {name}_rate" for name in _FLAGS)
_DAILY = (
    "daily as (select u.* exclude (min_start_timestamp, max_end_timestamp),"
    " cast(messages_count as double) / conversations_count as dialogue_volume,"
    " coalesce(users_count, 0) as users_count, coalesce(new_users_count, 0) as new_users_count,"
    " coalesce(sessions_count, 0) as sessions_count,"
    " coalesce(cast(sessions_count as double) / users_count, 0e0) as sessions_per_user,"
    f" {_RATES}"
    " from usage u left join (select * exclude (day, countries_count) from users) using (APP_ID, EVENT_DATE))"
)
METRICS_CTES = ",\n".join([KNOWN, _USAGE, _USERS, _DAILY])

_TOTAL = {
    "total_messages": "sum:messages_count",
    "total_conversations": "sum:conversations_count",
    "avg_dialogue_volume": "avg:dialogue_volume",
    "avg_prompt_words": "avg:avg_prompt_words",
    "avg_response_words": "avg:avg_response_words",
    "total_prompt_tokens": "sum:prompt_tokens",
    "total_response_tokens": "sum:response_tokens",
    "avg_latency": "avg:avg_latency",
    "prompt_cost": "add:prompt_cost",
    "response_cost": "add:response_cost",
    "total_cost": "add:total_cost",
    "total_users": "sum:users_count",
    "total_new_users": "sum:new_users_count",
    "total_sessions": "sum:sessions_count",
    "avg_sessions_per_user": "avg:sessions_per_user",
    "sentiment_prompt_positive": "avg:sentiment_prompt_positive",
    "sentiment_prompt_negative": "avg:sentiment_prompt_negative",
    "sentiment_response_positive": "avg:sentiment_response_positive",
    "sentiment_response_negative": "avg:sentiment_response_negative",
    "readability": "avg:readability",
    "feedback_positive_rate": "avg:feedback_positive_rate",
    "feedback_negative_rate": "avg:feedback_negative_rate",
}
_FORMS = {"sum": "cast(sum({0}) as bigint)", "add": "round(sum({0}), 6)", "avg": "round(avg({0}), 6)"}
_TOTALS = ", ".join(
    _FORMS[spec.split(":")[0]].format(spec.split(":")[1]) + f" as {name}" for name, spec in _TOTAL.items()
)


def _counted(column: str, out: str, alias: str, count: str = "count(*)", where: str = "true") -> str:
    return _q(
        MSG,
        f"select APP_ID, EVENT_DATE, EVENT_DATE as day, {column} as {out}, {count} as {alias}"
        f" from msg where {where} group by all",
    )


_SESSIONS = "count(distinct SESSION_ID)"

# --- conversations --------------------------------------------------------------

_LAST = ("USER_ID", "SESSION_ID", "DEVICE", "OS", "BROWSER", "LOCALE", "LOCATION", "CHANNEL_ID")
_SPREAD = {
    "NUM_WORDS_PROMPT": ("NUM_WORDS_PROMPT", "TOTAL"),
    "NUM_WORDS_RESPONSE": ("NUM_WORDS_RESPONSE", "TOTAL"),
    "LATENCY": ("TIME_LATENCY", "SUM"),
    "TOKENS_SPENT_PROMPT": ("TOKENS_SPENT_PROMPT", "TOTAL"),
    "TOKENS_SPENT_RESPONSE": ("TOKENS_SPENT_RESPONSE", "TOTAL"),
    "COST": ("COST", "TOTAL"),
}


def _conversation_columns() -> str:
    newest = "order by START_TIMESTAMP desc, INTERACTION_ID desc"
    oldest = "order by START_TIMESTAMP, INTERACTION_ID"
    span = "(max(END_TIMESTAMP) - min(START_TIMESTAMP))"
    columns = [
        "min(START_TIMESTAMP) as FIRST_MESSAGE_TIMESTAMP",
        "max(END_TIMESTAMP) as LAST_MESSAGE_TIMESTAMP",
        *[f"first({c} {newest}) as {c}" for c in _LAST],
        "count(*) as DIALOGUE_VOLUME",
        "case when count(*) = 1 then 1 else 0 end as ONE_INTERACTION",
        f"cast({span} as double) / 1000 / 60 as TIME_TOTAL",
        f"case when count(*) > 1 then cast({span} as double) / 1000 / (count(*) - 1) else 0e0 end"
        " as TIME_BETWEEN_INTERACTIONS",
    ]
    for source, (out, total) in _SPREAD.items():
        whole = f"sum({source})" if source == "COST" else f"cast(sum({source}) as bigint)"
        columns += [
            f"{whole} as {out}_{total}", f"avg({source}) as {out}_AVG",
            f"min({source}) as {out}_MIN", f"max({source}) as {out}_MAX",
        ]
    for name in ("LANG_PROMPT", "LANG_RESPONSE", "SENTIMENT_PROMPT", "SENTIMENT_RESPONSE"):
        columns.append(f"string_agg(distinct {name}, ',' order by {name}) as {name}")
    for side in ("PROMPT", "RESPONSE"):
        for mood in ("POSITIVE", "NEGATIVE", "NEUTRAL"):
            columns.append(f"max(SENTIMENT_{side}_{mood}) as SENTIMENT_{side}_{mood}_MAX")
    columns += [
        "avg(READABILITY_RESPONSE) as READABILITY_RESPONSE",
        f"first(INPUT {oldest}) as FIRST_INPUT",
        f"first(OUTPUT {oldest}) as FIRST_OUTPUT",
        _SECOND.format("min(START_TIMESTAMP)") + " as FIRST_MESSAGE_TIME",
        _SECOND.format("max(END_TIMESTAMP)") + " as LAST_MESSAGE_TIME",
    ]
    return ", ".join(columns)


# --- topics ---------------------------------------------------------------------

LABELS = MSG + """,
 items as (select msg.*, unnest(cast(json_extract(OUTPUT_CLASSIFIERS, '$[*]') as json[])) as item
   from msg where OUTPUT_CLASSIFIERS <> ''),
 exploded as (select *, unnest(cast(json_extract(item, '$.LABEL[*]') as json[])) as label from items),
 labels as (select * exclude (item, label),
   cast(json_extract(item, '$.ID') as bigint) as CLASSIFIER_ID,
   json_extract_string(item, '$.CATEGORY') as CATEGORY_ID,
   json_extract_string(label, '$') as LABEL_ID,
   cast(json_extract(item, '$.SCORE') as bigint) as SCORE from exploded),
 timed as (select *, max(END_TIMESTAMP) over w - min(START_TIMESTAMP) over w as duration_ms
   from labels window w as (partition by APP_ID, CONVERSATION_ID))"""

_TOPIC_FLAGS = {
    "prompt_positive": "SENTIMENT_PROMPT_POSITIVE > 0",
    "prompt_negative": "SENTIMENT_PROMPT_NEGATIVE > 0",
    "response_positive": "SENTIMENT_RESPONSE_POSITIVE > 0",
    "response_negative": "SENTIMENT_RESPONSE_NEGATIVE > 0",
    "feedback_positive": "FEEDBACK_TAG = 'positive'",
    "feedback_negative": "FEEDBACK_TAG = 'negative'",
}


def _topic_sums(keys: str) -> str:
    flags = ", ".join(
        f"count(distinct INTERACTION_ID) filter (where {cond}) as {name}" for name, cond in _TOPIC_FLAGS.items()
    )
    sums = ", ".join(
        f"cast(sum({source}) as bigint) as {out}"
        for source, out in (
            ("NUM_WORDS_PROMPT", "words_prompt"), ("NUM_WORDS_RESPONSE", "words_response"),
            ("TOKENS_SPENT_PROMPT", "tokens_prompt"), ("TOKENS_SPENT_RESPONSE", "tokens_response"),
        )
    )
    return (
        f"sums as (select EVENT_DATE as day, {keys}, count(distinct CONVERSATION_ID) as conversations,"
        f" count(distinct INTERACTION_ID) as messages, {flags}, count(LANG_PROMPT) as lang_prompt,"
        f" count(LANG_RESPONSE) as lang_response, {sums}, avg(READABILITY_RESPONSE) as readability,"
        " avg(LATENCY) as latency, min(START_TIMESTAMP) as min_start, max(END_TIMESTAMP) as max_end,"
        " cast(sum(duration_ms) as double) / count(*) / 1000 / 60 as duration from timed group by all)"
    )


_LABEL_KEYS = "APP_ID, CLASSIFIER_ID, CATEGORY_ID, LABEL_ID"


def _topic_view(polarity: bool) -> str:
    shares, rates = [], []
    for side in ("prompt", "response"):
        whole = f"nullif({side}_positive + {side}_negative, 0)" if polarity else "messages"
        for mood in ("positive", "negative"):
            name = f"SENTIMENT_{side}_{mood}".upper()
            shares.append(f"coalesce(100e0 * {side}_{mood} / {whole}, 0e0) as {name}")
            rates.append(f"100e0 * {side}_{mood} / messages as {name}_RATE")
    body = (
        f"select day, {_LABEL_KEYS}, duration as TIME_TOTAL,"
        " tokens_prompt * coalesce(inputCost, 0) + tokens_response * coalesce(outputCost, 0) as COST,"
        " conversations as CONVERSATIONS, messages as MESSAGES,"
        " cast(messages as double) / conversations as DIALOGUE_VOLUME,"
        f" {', '.join(shares)}, {', '.join(rates)},"
        " lang_prompt as LANG_PROMPT, lang_response as LANG_RESPONSE, words_prompt as NUM_WORDS_PROMPT,"
        " words_response as NUM_WORDS_RESPONSE, tokens_prompt as TOKENS_SPENT_PROMPT,"
        " tokens_response as TOKENS_SPENT_RESPONSE, readability as READABILITY_RESPONSE, latency as TIME_LATENCY,"
        " feedback_positive as FEEDBACK_POSITIVE, feedback_negative as FEEDBACK_NEGATIVE,"
        " 100e0 * feedback_positive / messages as FEEDBACK_POSITIVE_RATE,"
        " 100e0 * feedback_negative / messages as FEEDBACK_NEGATIVE_RATE"
        " from sums left join apps on id = APP_ID"
    )
    return _q(f"{LABELS}, {APPS}, {_topic_sums(_LABEL_KEYS)}", body)


# --- agents ---------------------------------------------------------------------

_SPAN_COLUMNS = ", ".join(f'{expr} as "{name}"' for name, expr in derive.SPANS.items() if not name.endswith("_at"))
SPANS = (
    "spans as (select 'team' || (conv_id % 3) as team_id, 'lib' || (conv_id % 2) as framework,"
    " 't' || conv_id as trace_id, conv_id || '/' || (turn // 8) as doc_id,"
    f" make_timestamp(({derive.INGESTED_MS}) * 1000) as ingested_at, {_SPAN_COLUMNS},"
    f" cast({derive.SPANS['started_at']} as double) as started_at,"
    f" cast({derive.SPANS['ended_at']} as double) as ended_at from conversations)"
)
_UP = "p.id = c.parent_id and p.trace_id = c.trace_id and p.team_id = c.team_id"
_BLOCKED = "(contains(c.output, 'jailbreak') or contains(c.output, 'Error code: 403'))"

AGENTS = SPANS + """,
 wf as (select * from spans where kind = 'workflow' and agent_name <> ''),
 agents as (select team_id, agent_name as agent_id, agent_name,
   first(framework order by ingested_at desc, framework desc) as framework, 'Assistant' as policy_role,
   'Low' as risk_level, 'Active' as status, '{}' as metadata, max(ingested_at) as first_seen,
   max(ingested_at) as last_activity, max(ingested_at) as updated_at from wf group by team_id, agent_name)"""
PERMISSIONS = SPANS + f""",
 calls as (select c.*, p.agent_name as agent_id from spans c join spans p on {_UP}
   where c.kind = 'tool' and p.kind = 'workflow' and p.agent_name <> ''),
 permissions as (select team_id, agent_id, function_name as tool_id, function_name as tool_name,
   'API' as tool_category, 'execute' as tool_action, true as approved, max(ingested_at) as approved_at,
   max(ingested_at) as first_requested, max(ingested_at) as last_requested, max(ingested_at) as updated_at
   from calls where function_name <> '' group by all)"""
TOOL_REQUESTS = PERMISSIONS + f""",
 tool_requests as (select team_id, id as request_id, trace_id, id as span_id, agent_id, function_name as tool_id,
   function_name as tool_name, 'API' as tool_category, 'execute' as tool_action,
   case when status = 'ok' and not contains(output, 'error') then 'success'
        when {_BLOCKED.replace('c.', '')} then 'blocked' else 'error' end as status,
   not {_BLOCKED.replace('c.', '')} as approved, (ended_at - started_at) * 1000 as duration_ms,
   input as request_params, output as response_data,
   case when contains(output, 'error') then output else '' end as error_message,
   ingested_at as "timestamp", cast(ingested_at as date) as "date" from calls where function_name <> '')"""
GUARDIAN = """
 guardian as (select team_id, 'guard_' || id as invocation_id, trace_id, agent_id,
   'jailbreak_detection' as check_type, 'blocked' as result,
   cast(case when contains(output, 'score 0.97') then 0.97 when contains(output, 'score 0.95') then 0.95
     when contains(output, 'score 0.90') then 0.9 else 0.85 end as float) as risk_score,
   output as reason, '{"tool": "' || function_name || '"}' as metadata,
   ingested_at as "timestamp", cast(ingested_at as date) as "date" from calls c where """ + _BLOCKED + ")"
AGENT_REQUESTS = f"""
 last_llm as (select team_id, trace_id, parent_id, first(input order by started_at desc, input desc) as input_data,
   first(output order by started_at desc, input desc) as output_data
   from spans where kind = 'llm' and parent_id <> '' group by all),
 runs as (select * from spans where kind = 'workflow' and agent_name <> ''),
 agent_requests as (select c.team_id, c.id as request_id, c.trace_id, c.id as span_id, c.agent_name as agent_id,
   coalesce(p.agent_name, '') as parent_agent_id, c.parent_id as parent_span_id,
   case when c.status = 'error' then 'error' else 'success' end as status,
   case when c.ended_at > 0 and c.started_at > 0 then (c.ended_at - c.started_at) * 1000 else 0e0 end as duration_ms,
   coalesce(l.input_data, '') as input_data, coalesce(l.output_data, '') as output_data, c.agent_tools,
   c.agent_output_type, c.framework, '' as error_message, c.ingested_at as "timestamp",
   cast(c.ingested_at as date) as "date"
   from runs c left join runs p on {_UP}
   left join last_llm l on l.parent_id = c.id and l.trace_id = c.trace_id and l.team_id = c.team_id)"""
DEPENDENCIES = SPANS + f""",
 edges as (
   select c.team_id, p.agent_name as source_agent_id, 'agent' as target_type, c.agent_name as target_id,
     c.ingested_at, c.doc_id
   from spans c join spans p on {_UP}
   where c.kind = 'workflow' and p.kind = 'workflow' and c.agent_name <> p.agent_name
   union all
   select c.team_id, g.agent_name, 'agent', c.agent_name, c.ingested_at, c.doc_id
   from spans c join spans p on {_UP}
   join spans g on g.id = p.parent_id and g.trace_id = p.trace_id and g.team_id = p.team_id
   where c.kind = 'workflow' and p.kind = 'tool' and g.kind = 'workflow' and c.agent_name <> g.agent_name
   union all
   select c.team_id, p.agent_name, 'tool', c.function_name, c.ingested_at, c.doc_id
   from spans c join spans p on {_UP}
   where c.kind = 'tool' and p.kind = 'workflow'),
 dependencies as (select team_id, source_agent_id, target_type, target_id, target_id as target_name,
   case target_type when 'agent' then 'calls' else 'uses' end as dependency_type,
   count(distinct doc_id) as connection_count, min(ingested_at) as first_seen, max(ingested_at) as last_seen,
   max(ingested_at) as updated_at
   from edges where source_agent_id <> '' and target_id <> '' group by all)"""

_NOW = f"timestamp '{derive.AS_OF}'"

# --- events and tables ------------------------------------------------------------

_DISCOVER = _derived("d", derive.DISCOVER_EVENTS, "events")
_METRICS = _derived("m", derive.METRICS, "events")
_GPT = _derived("g", derive.GPT_USAGE, "orders")
_TRACES = _derived("t", {c.lower(): derive.TRACES_PROCESSED[c] for c in derive.TRACE_COLUMNS}, "events")
_TESTS = _derived("t", {**derive.TESTS, "status": "o_orderstatus"}, "orders")
_SURVIVING = (
    "select id, scenarioId, targetId, type, \"at\", 1 as sign, case when status = 'P' then 2 else 1 end as ver"
    " from t where status <> 'F'"
)


def _times(prefix: str) -> str:
    start, end = f"{prefix}start_timestamp", f"{prefix}end_timestamp"
    return (
        f"{_SECOND.format(start)} as start_time, {_SECOND.format(end)} as end_time,"
        f" {_DATE.format(start)} as event_date,"
        f" make_timestamp(({start} // 3600000) * 3600000000) as event_hour"
    )


_DISCOVER_COLUMNS = (
    f"select *, {_DATE.format('timestamp')} as \"date\", {_SECOND.format('timestamp')} as \"hour\","
    " case when sensitive_data_count > 0 then 1 else 0 end as has_sensitive_data,"
    " case when action = 'block' then 1 else 0 end as is_blocked,"
    " case when action = 'warn' then 1 else 0 end as is_warned,"
    " case when event_type in ('navigation', 'widget_detected') then 'old' else 'new' end as event_format from d"
)
_GPT_TIMES = (
    "select g.*, make_timestamp((detected_at // 1000) * 1000000) as detected_time,"
    " case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end as event_date,"
    " case when o_orderkey % 4 < 3 then date_trunc('hour', o_orderdate) end as event_hour"
    " from g join orders using (o_orderkey)"
)
_GPT_LATEST = "first({0} order by detected_at desc, o_orderkey desc) as {0}"


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^ \\t\\n\\x0B\\f\\r]+'))"


def _matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_ENRICHED = (
    "doc as (select 't' || doc_id as TRACE_ID, concat_ws(' ', source, lang) as i, coalesce(\"text\", '') as o from documents),"
    f" n as (select *, {_words('i')} as wi, {_words('o')} as wo, greatest({_matches('o', '[.!?]+')}, 1) as sentences,"
    f" {_matches('o', '(?i)[aeiouy]+')} as syllables from doc)"
)

_WORD_COLUMNS = (
    "cast(wi as int) as NUM_WORDS_PROMPT, cast(wo as int) as NUM_WORDS_RESPONSE,"
    " cast(ceil(length(i) / 4e0) as int) as TOKENS_SPENT_PROMPT,"
    " cast(ceil(length(o) / 4e0) as int) as TOKENS_SPENT_RESPONSE,"
    " case when wo = 0 then 0e0 else round(206.835e0 - 1.015e0 * (cast(wo as double) / sentences)"
    " - 84.6e0 * (cast(syllables as double) / wo), 6) end as READABILITY_RESPONSE"
)


def _any_of(words) -> str:
    return "(" + ", ".join(f"'{word}'" for word in words) + ")"


def _hits(text: str) -> str:
    """The words of a text that are on any list."""
    breaks = "'.,;:!?()[]{}<>\"''/\\|' || chr(9) || chr(10) || chr(13)"
    listed = {w for words in (*FUNCTION_WORDS.values(), POSITIVE_WORDS, NEGATIVE_WORDS) for w in words}
    spaced = f"translate(lower({text}), {breaks}, repeat(' ', length({breaks})))"
    return f"list_filter(string_split({spaced}, ' '), lambda w: w in {_any_of(sorted(listed))})"


def _side(side: str, hits: str) -> str:
    """Language and sentiment columns from the listed words."""
    count = lambda words: f"len(list_filter({hits}, lambda w: w in {_any_of(words)}))"
    votes = ", ".join(f"{{'n': {count(words)}, 'code': '{code}'}}" for code, words in FUNCTION_WORDS.items())
    good, bad = count(POSITIVE_WORDS), count(NEGATIVE_WORDS)
    share = lambda part: f"case when {good} + {bad} = 0 then 0e0 else cast({part} as double) / ({good} + {bad}) end"
    return (
        f"case when list_max([{votes}]).n > 0 then list_max([{votes}]).code else '' end as LANG_{side},"
        f" case when {good} > {bad} then 'positive' when {bad} > {good} then 'negative' else 'neutral' end"
        f" as SENTIMENT_{side}, {share(good)} as SENTIMENT_{side}_POSITIVE, {share(bad)} as SENTIMENT_{side}_NEGATIVE,"
        f" case when {good} + {bad} = 0 then 1e0 else 0e0 end as SENTIMENT_{side}_NEUTRAL"
    )


_CONVERSATION_VIEW = _q(
    KNOWN, f"select APP_ID, CONVERSATION_ID, {_conversation_columns()} from known group by APP_ID, CONVERSATION_ID"
)
_CLASSIFIERS = _q(
    KNOWN,
    "select APP_ID, CONVERSATION_ID, EVENT_DATE, START_TIMESTAMP, INTERACTION_ID, OUTPUT_CLASSIFIERS from known",
)
_INGESTED_TRACES = _q(_TRACES, f"select t.*, {_times('')} from t")
_DAILY_METRICS = _q(METRICS_CTES, "select * from daily")
_GRAPH = _q(
    DEPENDENCIES,
    "select team_id, source_agent_id, target_type, target_id, target_name, dependency_type,"
    f" connection_count, last_seen from dependencies where last_seen >= {_NOW} - interval 7 day",
)
_KPI_1D = _q(
    f"{LABELS}, {_topic_sums(_LABEL_KEYS + ', SCORE')}",
    f"select day, {_LABEL_KEYS}, SCORE, conversations as conversations_count, messages as messages_count,"
    " prompt_positive as sentiment_prompt_positive, prompt_negative as sentiment_prompt_negative,"
    " response_positive as sentiment_response_positive, response_negative as sentiment_response_negative,"
    " lang_prompt as lang_prompt_count, lang_response as lang_response_count, words_prompt as num_words_prompt,"
    " words_response as num_words_response, tokens_prompt as tokens_spent_prompt,"
    " tokens_response as tokens_spent_response, readability as readability_response, latency as time_latency,"
    f" {_SECOND.format('min_start')} as min_start_time, max_end as max_end_time,"
    " feedback_positive as feedback_positive_count, feedback_negative as feedback_negative_count,"
    " duration as conversation_duration from sums",
)

ORACLE: dict[str, str] = {
    # ingest
    "ingest_traces": _INGESTED_TRACES,
    "ingest_stream": _INGESTED_TRACES,
    "ingest_stream_monthly": _INGESTED_TRACES,
    "ingest_traces_processed": _q(
        TP0,
        f"select tp0.*, {_SECOND.format('START_TIMESTAMP')} as START_TIME, {_SECOND.format('END_TIMESTAMP')} as END_TIME,"
        f" {_DATE.format('START_TIMESTAMP')} as EVENT_DATE,"
        " make_timestamp((START_TIMESTAMP // 3600000) * 3600000000) as EVENT_HOUR from tp0",
    ),
    "ingest_metrics": _q(_METRICS, f"select m.*, {_times('')} from m"),
    "ingest_discover_events": _q(_DISCOVER, _DISCOVER_COLUMNS),
    "ingest_agent_traces": (
        "select cast(json_object('doc_id', doc_id, 'text', \"text\", 'lang', lang, 'source', source, 'n_chars', n_chars)"
        f" as varchar) as raw_json, {_NOW} as ingested_at, cast({_NOW} as date) as ingested_date from documents"
    ),
    "ingest_gpt_usage": _q(
        _GPT,
        "select team_id, gizmo_id, author_user_id, first(name order by detected_at desc, name desc) as name,"
        " first(num_interactions order by detected_at desc, name desc) as num_interactions,"
        " max(detected_at) as detected_at, make_timestamp((max(detected_at) // 1000) * 1000000) as detected_time"
        " from g where team_id <> 'team0' group by team_id, gizmo_id, author_user_id",
    ),
    "flatten_record": (
        "select event_id, user_id, event_type as user_last_name, value as score_value from events"
    ),
    "hoist_field": (
        "select cast(json_object('conv_id', conv_id, 'turn', turn, 'role', role, 'text', \"text\") as varchar) as raw_json"
        " from conversations"
    ),
    "quarantine_bad_records": (
        "select case event_type when 'error' then 'not JSON' else 'not an object' end as error, count(*) as records"
        " from events where event_type in ('error', 'click') group by 1"
    ),
    "quarantine_unfit_values": (
        "select case event_type when 'error' then 'unfit: input OBJECT, start_timestamp STRING'"
        " when 'click' then 'unfit: app_id ARRAY, latency DECIMAL'"
        " when 'view' then 'unfit: latency BIGINT, user_id OBJECT' else '' end as error,"
        " case when event_type in ('error', 'click', 'view', 'purchase') then '' else 't' end || event_id as trace_id,"
        " case when event_type in ('error', 'click', 'view') then null when event_type = 'purchase' then 0"
        " else user_id end as latency from events"
    ),
    "dedupe_redelivery": _q(_TRACES, "select trace_id, app_id, start_timestamp, input from t"),
    "monthly_layout_write": _q(
        _GPT,
        "select cast(strftime(make_timestamp(detected_at * 1000), '%Y%m') as int) as yyyymm, team_id,"
        " count(*) as n, max(detected_at) as newest from g group by 1, 2",
    ),
    "apply_retention": _q(
        TP,
        "select TRACE_ID, EVENT_DATE, cast(strftime(EVENT_DATE, '%Y%m') as int) as yyyymm from tp"
        " where EVENT_DATE + interval 12 month > timestamp '2025-01-20 00:00:00'",
    ),
    "skip_index_layout": _q(
        _DISCOVER,
        "select application_id, action, cast(strftime(make_timestamp(timestamp * 1000), '%Y%m') as int) as yyyymm,"
        " count(*) as n from d group by all",
    ),
    "snapshot_export": " union all ".join(
        f"select '{name}' as table_name, count(*) as n, count(distinct {key}) as keys,"
        f" cast(sum({key}) as bigint) as key_sum,"
        f" cast(sum({f'length({text})' if text else 0}) as bigint) as chars from {name}"
        for name, (key, text) in derive.TABLE_KEYS.items()
    ),
    "enrich_traces": _q(
        f"{_ENRICHED}, hits as (select *, {_hits('i')} as hi, {_hits('o')} as ho from n)",
        f"select TRACE_ID, '' as OUTPUT_CLASSIFIERS, {_WORD_COLUMNS},"
        f" {_side('PROMPT', 'hi')}, {_side('RESPONSE', 'ho')} from hits",
    ),
    "enrich_traces_words": _q(
        _ENRICHED,
        f"select TRACE_ID, {_WORD_COLUMNS} from n",
    ),
    "load_dimensions": (
        "select 'app' || n_nationkey as id, n_name || ' v3' as name, make_timestamp(1700000003000000) as updatedAt"
        " from nation"
    ),
    # reconciliation
    "latest_by_version": (
        "select * exclude (rn) from (select *, row_number() over"
        " (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1"
    ),
    "collapse_by_sign": _q(_TESTS, _SURVIVING),
    "current_tests": _q(_TESTS, _SURVIVING),
    "current_test_runs": _q(_TESTS, _SURVIVING),
    "gpt_usage_current": _q(
        _GPT,
        "select team_id, gizmo_id, author_user_id, "
        + ", ".join(_GPT_LATEST.format(c) for c in ("o_orderkey", "name", "num_interactions", "detected_at"))
        + " from g group by team_id, gizmo_id, author_user_id",
    ),
    "merge_states": _q(
        MSG,
        "select APP_ID, count(*) as n, min(START_TIMESTAMP) as min_start, max(END_TIMESTAMP) as max_end, "
        + ", ".join(
            f"cast(sum({source}) as bigint) as {out}"
            for source, out in (
                ("NUM_WORDS_PROMPT", "words_prompt"), ("NUM_WORDS_RESPONSE", "words_response"),
                ("TOKENS_SPENT_PROMPT", "tokens_prompt"), ("TOKENS_SPENT_RESPONSE", "tokens_response"),
                ("LATENCY", "latency"),
            )
        )
        + ", sum(READABILITY_RESPONSE) as readability from msg group by APP_ID",
    ),
    "sum_counters": _q(
        MSG, "select APP_ID, LANG_PROMPT, count(*) as language_count from msg group by all"
    ),
    # usage
    "traces_usage_metrics": _q(f"{KNOWN},\n{_USAGE}", "select * from usage"),
    "traces_user_metrics": _q(f"{MSG},\n{_USERS}", "select * from users"),
    "traces_metrics": _DAILY_METRICS,
    "traces_metrics_total": _q(METRICS_CTES, f"select APP_ID, {_TOTALS} from daily group by APP_ID"),
    "traces_language_metrics": _counted("LANG_PROMPT", "LANG_PROMPT", "language_count"),
    "traces_language_daily": _counted("LANG_PROMPT", "language", '"count"'),
    "conversation_message_counts": _counted("CONVERSATION_ID", "CONVERSATION_ID", "message_count"),
    "single_message_rate": _q(
        MSG,
        "select APP_ID, EVENT_DATE, EVENT_DATE as day, count(*) filter (where n = 1) as single_message_conversations,"
        " count(*) as total_conversations, 100e0 * count(*) filter (where n = 1) / count(*) as single_message_rate"
        " from (select APP_ID, EVENT_DATE, CONVERSATION_ID, count(*) as n from msg group by all)"
        " group by APP_ID, EVENT_DATE",
    ),
    "traces_country_metrics": _counted("LOCATION", "country", '"count"', where="LOCATION <> ''"),
    "traces_device_metrics": _counted("DEVICE", "DEVICE", '"count"', _SESSIONS, "DEVICE <> ''"),
    "traces_browser_metrics": _counted("BROWSER", "BROWSER", '"count"', _SESSIONS, "BROWSER <> ''"),
    "traces_os_metrics": _counted("OS", "OS", '"count"', _SESSIONS, "OS <> ''"),
    "traces_channel_metrics": _counted("CHANNEL_ID", "channel", '"count"', _SESSIONS, "CHANNEL_ID is not null"),
    "traces_user_engagement": _counted("USER_ID", "USER_ID", "interaction_count", where="USER_ID <> ''"),
    "traces_engagement_metrics": _q(
        MSG,
        "select APP_ID, EVENT_DATE, EVENT_DATE as day, count(*) as active_users,"
        " cast(sum(n) as double) / count(*) as avg_calls_per_user, max(n) as max_calls_per_user"
        " from (select APP_ID, EVENT_DATE, USER_ID, count(*) as n from msg where USER_ID <> '' group by all)"
        " group by APP_ID, EVENT_DATE",
    ),
    "traces_top_users": _counted("USER_ID", "USER_ID", "request_count", where="USER_ID <> ''"),
    "top_users": _q(
        MSG,
        "select *, EVENT_DATE as day from (select APP_ID, EVENT_DATE, USER_ID, count(*) as request_count,"
        " cast(row_number() over (partition by APP_ID, EVENT_DATE order by count(*) desc, USER_ID) as int) as rank"
        " from msg where USER_ID <> '' group by APP_ID, EVENT_DATE, USER_ID) where rank <= 5",
    ),
    "users_countries_daily": _q(f"{MSG},\n{_USERS},\n{_COUNTRY_LIST}", "select * from country_list"),
    "approx_usage": _q(
        MSG,
        "select APP_ID, EVENT_DATE, EVENT_DATE as day, count(distinct INTERACTION_ID) as messages,"
        " count(distinct CONVERSATION_ID) as conversations, count(distinct nullif(USER_ID, '')) as users,"
        " count(distinct SESSION_ID) as sessions, true as messages_within, true as conversations_within,"
        " true as users_within, true as sessions_within from msg group by all",
    ),
    # conversations
    "traces_conversations": _q(
        KNOWN,
        f"select APP_ID, CONVERSATION_ID, EVENT_DATE, EVENT_DATE as day, {_conversation_columns()} from known"
        " group by APP_ID, CONVERSATION_ID, EVENT_DATE",
    ),
    "traces_conversations_view": _CONVERSATION_VIEW,
    "incremental_conversations": _CONVERSATION_VIEW,
    "conversation_classifiers": _CLASSIFIERS,
    "incremental_classifiers": _CLASSIFIERS,
    # topics
    "classifier_labels": _q(
        LABELS, "select TRACE_ID, APP_ID, CLASSIFIER_ID, CATEGORY_ID, LABEL_ID, SCORE from labels"
    ),
    "conversation_duration": _q(
        LABELS,
        f"select EVENT_DATE as day, {_LABEL_KEYS}, SCORE, CONVERSATION_ID, count(*) as n,"
        " any_value(duration_ms) as duration_ms from timed"
        f" group by EVENT_DATE, {_LABEL_KEYS}, SCORE, CONVERSATION_ID",
    ),
    "kpi_topics_1d": _KPI_1D,
    "kpi_topics_1d_view": _topic_view(polarity=False),
    "kpi_topics_1d_view_polarity": _topic_view(polarity=True),
    "incremental_topics": _topic_view(polarity=False),
    # agents
    "explode_spans": _q(
        SPANS,
        "select ingested_at, team_id, framework, trace_id, id as span_id, parent_id, kind, name, status, started_at,"
        " ended_at, agent_name, function_name, input, output, agent_tools, agent_output_type from spans",
    ),
    "agents": _q(AGENTS, "select * from agents"),
    "tools": _q(
        SPANS,
        "select team_id, function_name as tool_id, function_name as tool_name, 'API' as tool_category,"
        " 'execute' as tool_action, '' as description, max(ingested_at) as first_seen, max(ingested_at) as updated_at"
        " from spans where kind = 'tool' and function_name <> '' group by team_id, function_name",
    ),
    "agent_tool_permissions": _q(PERMISSIONS, "select * from permissions"),
    "tool_requests": _q(TOOL_REQUESTS, "select * from tool_requests"),
    "agent_dependencies": _q(DEPENDENCIES, "select * from dependencies"),
    "guardian_invocations": _q(f"{PERMISSIONS},{GUARDIAN}", "select * from guardian"),
    "agent_requests": _q(f"{SPANS},{AGENT_REQUESTS}", "select * from agent_requests"),
    "v_agents_with_metrics": _q(
        f"{PERMISSIONS},{GUARDIAN},{AGENT_REQUESTS},{AGENTS[len(SPANS) + 1:]}",
        "select team_id, agent_id, agent_name, framework, policy_role, risk_level, status, last_activity,"
        f" (select count(*) from guardian x where x.team_id = a.team_id and x.agent_id = a.agent_id"
        f"   and x.\"timestamp\" >= {_NOW} - interval 24 hour) as guardian_invocations_24h,"
        f" (select count(*) from agent_requests x where x.team_id = a.team_id and x.agent_id = a.agent_id"
        f"   and x.\"timestamp\" >= {_NOW} - interval 24 hour) as requests_24h,"
        " (select count(*) from agent_requests x where x.team_id = a.team_id and x.agent_id = a.agent_id)"
        "   as requests_total,"
        " coalesce((select string_agg(distinct tool_name, ',' order by tool_name) from permissions x"
        "   where x.team_id = a.team_id and x.agent_id = a.agent_id), '') as allowed_tools from agents a",
    ),
    "v_agent_permissions_with_metrics": _q(
        TOOL_REQUESTS,
        "select team_id, agent_id, tool_id, tool_name, tool_category, tool_action, approved, last_requested,"
        " (select count(*) from tool_requests x where x.team_id = a.team_id and x.agent_id = a.agent_id"
        f"   and x.tool_id = a.tool_id and x.\"timestamp\" >= {_NOW} - interval 24 hour) as requests_24h,"
        " (select count(*) from tool_requests x where x.team_id = a.team_id and x.agent_id = a.agent_id"
        f"   and x.tool_id = a.tool_id and x.\"timestamp\" >= {_NOW} - interval 30 day) as requests_1m"
        " from permissions a",
    ),
    "v_agent_dependency_graph": _GRAPH,
    "incremental_agent_tables": _GRAPH,
    "incremental_tool_requests": _q(TOOL_REQUESTS, "select * from tool_requests"),
    # events
    "discover_events_enriched": _q(_DISCOVER, _DISCOVER_COLUMNS),
    "metrics_enriched": _q(_METRICS, f"select m.*, {_times('')} from m"),
    "gpt_usage_enriched": _q(_GPT, _GPT_TIMES),
    # streaming
    "incremental_rollup": _DAILY_METRICS,
    "streaming_daily_counts": _q(
        MSG, "select APP_ID, EVENT_DATE, LANG_PROMPT, count(*) as \"count\" from msg group by all"
    ),
}

ORACLE["incremental_user_metrics"] = _q(
    f"{MSG},\n{_USERS}", "select * from users where EVENT_DATE between '{}' and '{}'".format(*derive.USER_RANGE)
)
ORACLE["incremental_agent_requests"] = ORACLE["agent_requests"]
# Documents delivered twice give what they give once.
ORACLE |= {
    f"{name}_redelivered": ORACLE[name]
    for name in ("tool_requests", "guardian_invocations", "agent_dependencies", "agent_requests")
}
