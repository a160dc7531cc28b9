"""Test input derived from the driver's tables.

Every row of a source table gives rows here. Expressions are one text for both
engines: `{ms}`, `{k}` and `{idiv}` stand for the three spots where Spark and
DuckDB spell differently. Costs and scores are dyadic fractions, so sums do not
depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.timeparts import date_of, hour_of, second_of

AS_OF = "2024-01-13 12:00:00"

# Days asked for of a stored state.
USER_RANGE = ("2024-01-06", "2024-01-21")

# Every given table: a number column and a text column to compare copies by.
TABLE_KEYS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name"),
    "customer": ("c_custkey", "c_name"),
    "supplier": ("s_suppkey", "s_name"),
    "part": ("p_partkey", "p_name"),
    "orders": ("o_orderkey", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_linestatus"),
    "events": ("event_id", "props"),
    "documents": ("doc_id", "text"),
    "embeddings": ("vec_id", None),
    "pages": ("page_id", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", None),
    "conversations": ("conv_id", "text"),
}

SPARK = {
    "ms": lambda t: f"(unix_micros(cast({t} as timestamp)) div 1000)",
    "k": "cast(get_json_object(props, '$.k') as int)",
    "idiv": "div",
    "int8": "bigint",
}
DUCKDB = {
    "ms": lambda t: f"(epoch_us({t}) // 1000)",
    "k": "cast(json_extract_string(props, '$.k') as int)",
    "idiv": "//",
    "int8": "bigint",
}

APPS = {
    "id": "'app' || n_nationkey",
    "name": "n_name",
    "teamId": "'team' || (n_nationkey % 3)",
    "inputCost": "(n_nationkey + 1) / 1024e0",
    "outputCost": "(n_nationkey + 1) / 512e0",
}

# Two of the 27 apps in the traces are not among the 25 known ones.
TRACES_PROCESSED = {
    "APP_ID": "'app' || ((user_id + 20) % 27)",
    "TEAM_ID": "'team' || ((user_id + 20) % 27 % 3)",
    "TRACE_ID": "'t' || event_id",
    "PARENT_ID": "''",
    "INTERACTION_ID": "'i' || (event_id - case when event_id % 10 = 9 then 1 else 0 end)",
    "CONVERSATION_ID": "'c' || user_id || '_' || ({ms_ts} {idiv} 172800000)",
    "SESSION_ID": "'s' || user_id || '_' || ({ms_ts} {idiv} 21600000)",
    "START_TIMESTAMP": "{ms_ts}",
    "END_TIMESTAMP": "{ms_ts} + cast(round(value * 100) as int)",
    "LATENCY": "cast(round(value * 100) as int)",
    "INPUT": "'q' || event_id",
    "OUTPUT": "'a' || event_id",
    "FEEDBACK_TAG": "case event_id % 5 when 0 then 'positive' when 1 then 'negative' else '' end",
    "FEEDBACK_TEXT": "''",
    "CHANNEL_ID": "case when event_id % 4 = 0 then '' else 'ch' || (event_id % 4) end",
    "USER_ID": "case when user_id % 11 = 0 then '' else 'u' || user_id end",
    "USER_IP": "''",
    "USER_EMAIL": "''",
    "USER_PHONE": "''",
    "LOCATION": "case user_id % 5 when 0 then '' when 1 then 'ES' when 2 then 'US' when 3 then 'FR' else 'DE' end",
    "LOCALE": "case user_id % 2 when 0 then 'en-US' else 'es-ES' end",
    "DEVICE": "case event_id % 3 when 0 then '' when 1 then 'mobile' else 'desktop' end",
    "OS": "case event_id % 4 when 0 then '' when 1 then 'linux' when 2 then 'ios' else 'windows' end",
    "BROWSER": "case event_id % 6 when 0 then '' when 1 then 'safari' else 'chrome' end",
    "TASK": "case when event_type = 'error' then 'system' else 'message' end",
    "CUSTOM": "'{{}}'",
    "OUTPUT_CLASSIFIERS": (
        "case event_id % 4 when 0 then '' when 1 then '[]' "
        "when 2 then '[{{\"ID\":' || (event_id % 3) || ',\"CATEGORY\":\"cat' || (event_id % 2) || "
        "'\",\"LABEL\":[\"l' || (event_id % 5) || '\",\"all\"],\"SCORE\":' || (event_id % 4) || '}}]' "
        "else '[{{\"ID\":1,\"CATEGORY\":\"cat0\",\"LABEL\":[],\"SCORE\":1}},"
        "{{\"ID\":2,\"CATEGORY\":\"cat1\",\"LABEL\":[\"x\"],\"SCORE\":0}}]' end"
    ),
    "TOKENS_SPENT_PROMPT": "{k} * 2",
    "TOKENS_SPENT_RESPONSE": "{k} * 5",
    "READABILITY_RESPONSE": "({k} % 64) / 64e0",
    "NUM_WORDS_PROMPT": "{k}",
    "NUM_WORDS_RESPONSE": "{k} * 3 + cast(event_id % 17 as int)",
    "LANG_PROMPT": "case event_id % 3 when 0 then 'en' when 1 then 'es' else 'fr' end",
    "LANG_RESPONSE": "case event_id % 2 when 0 then 'en' else 'es' end",
    "SENTIMENT_PROMPT": "case event_id % 3 when 0 then 'positive' when 1 then 'negative' else 'neutral' end",
    "SENTIMENT_PROMPT_POSITIVE": "(event_id * 37 % 128) / 128e0",
    "SENTIMENT_PROMPT_NEGATIVE": "(event_id * 53 % 128) / 128e0",
    "SENTIMENT_PROMPT_NEUTRAL": "(event_id * 11 % 128) / 128e0",
    "SENTIMENT_RESPONSE": "case event_id % 5 when 0 then 'negative' else 'neutral' end",
    "SENTIMENT_RESPONSE_POSITIVE": "(event_id * 29 % 128) / 128e0",
    "SENTIMENT_RESPONSE_NEGATIVE": "(event_id * 61 % 128) / 128e0",
    "SENTIMENT_RESPONSE_NEUTRAL": "(event_id * 13 % 128) / 128e0",
}
# Columns the first loading step already has.
TRACE_COLUMNS = tuple(
    c for c in TRACES_PROCESSED
    if not c.startswith(("OUTPUT_", "TOKENS_", "READABILITY_", "NUM_", "LANG_", "SENTIMENT_"))
)

DISCOVER_EVENTS = {
    "timestamp": "{ms_ts}",
    "submission_timestamp": "{ms_ts} + 250",
    "event_type": (
        "case event_type when 'view' then 'navigation' when 'signup' then 'widget_detected' "
        "when 'purchase' then 'prompt_submitted' else event_type end"
    ),
    "user_id": "'u' || user_id",
    "action": "case {k} % 4 when 0 then 'block' when 1 then 'warn' else 'allow' end",
    "application_id": "'a' || (event_id % 12)",
    "team_id": "'team' || (user_id % 3)",
    "session_id": "'s' || user_id || '_' || ({ms_ts} {idiv} 21600000)",
    "sensitive_data_count": "cast(event_id % 4 as {int8})",
    "sensitive_data_level": "case event_id % 4 when 1 then 'low' when 2 then 'medium' when 3 then 'high' end",
    "category": "case when event_id % 6 = 0 then null else 'cat' || (event_id % 6) end",
}

METRICS = {
    "gateway_id": "'g' || (user_id % 9)",
    "engine_id": "'e' || (event_id % 5)",
    "trace_id": "'t' || event_id",
    "path": "'/' || event_type",
    "start_timestamp": "{ms_ts}",
    "end_timestamp": "{ms_ts} + cast(round(value * 100) as int)",
    "latency": "cast(round(value * 100) as int)",
    "status_code": "case event_type when 'error' then 500 else 200 end",
}

GPT_USAGE = {
    "o_orderkey": "o_orderkey",
    "team_id": "'team' || (o_custkey % 3)",
    "gizmo_id": "'g' || (o_custkey % 50)",
    "author_user_id": "'u' || (o_custkey % 20)",
    "name": "'n' || o_orderkey",
    "num_interactions": "o_orderkey % 100",
    "detected_at": "{ms_order}",
}

TESTS = {
    "id": "'x' || o_orderkey",
    "scenarioId": "'sc' || (o_custkey % 20)",
    "targetId": "'tg' || (o_custkey % 5)",
    "type": "o_orderpriority",
    "at": "{ms_order}",
}


def render(expressions: dict[str, str], engine: dict) -> dict[str, str]:
    words = {
        "ms_ts": engine["ms"]("ts"),
        "ms_order": engine["ms"]("o_orderdate"),
        "k": engine["k"],
        "idiv": engine["idiv"],
        "int8": engine["int8"],
    }
    return {name: expr.format(**words) for name, expr in expressions.items()}


def select(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} as `{name}`" for name, expr in render(expressions, SPARK).items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The same table as a file stream; the pattern also matches a folder."""
    schema = read(spark, sf_dir, table).schema
    pattern = f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet"
    return spark.readStream.schema(schema).parquet(pattern)


def apps(nation: DataFrame) -> DataFrame:
    return select(nation, APPS)


def traces_processed(events: DataFrame) -> DataFrame:
    rows = select(events, TRACES_PROCESSED)
    return rows.withColumns({
        "START_TIME": second_of("START_TIMESTAMP"),
        "END_TIME": second_of("END_TIMESTAMP"),
        "EVENT_DATE": date_of("START_TIMESTAMP"),
        "EVENT_HOUR": hour_of("START_TIMESTAMP"),
    })


def traces(events: DataFrame) -> DataFrame:
    rows = select(events, {name: TRACES_PROCESSED[name] for name in TRACE_COLUMNS})
    return rows.withColumnsRenamed({name: name.lower() for name in TRACE_COLUMNS})


def discover_events(events: DataFrame) -> DataFrame:
    return select(events, DISCOVER_EVENTS)


def metrics(events: DataFrame) -> DataFrame:
    return select(events, METRICS)


def gpt_usage(orders: DataFrame) -> DataFrame:
    """The free-form time has three spellings and one that is no time."""
    at = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(at, "dd/MM/yyyy HH:mm:ss"))
        .otherwise("n/a")
    )
    columns = [f"{expr} as `{name}`" for name, expr in render(GPT_USAGE, SPARK).items()]
    return orders.withColumn("timestamp", text).selectExpr(*columns, "`timestamp`")


def tests(orders: DataFrame) -> DataFrame:
    """Signed rows: F orders are cancelled, P orders cancelled and written anew."""
    rows = select(orders, {**TESTS, "status": "o_orderstatus"})
    signs = F.when(F.col("status") == "F", F.expr("array((1, 1), (-1, 1))")).when(
        F.col("status") == "P", F.expr("array((1, 1), (-1, 1), (1, 2))")
    ).otherwise(F.expr("array((1, 1))"))
    signed = rows.withColumn("s", F.explode(signs))
    return signed.select("id", "scenarioId", "targetId", "type", "at", F.col("s.col1").alias("sign"), F.col("s.col2").alias("ver"))


# --- agent documents -------------------------------------------------------------

# Eight turns make one document. Parent turn and kind by turn number. Fixed values.
PARENT_TURN = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 1}
KINDS = {"workflow": (0, 1, 5), "tool": (2, 4, 6), "llm": (3, 7)}

_T = "(turn % 8)"
_BASE = "(turn - turn % 8)"
SPANS = {
    "id": "'s' || conv_id || '_' || turn",
    "parent_id": f"case when {_T} = 0 then '' else 's' || conv_id || '_' || ({_BASE} + case {_T} "
    + " ".join(f"when {t} then {p}" for t, p in PARENT_TURN.items()) + " end) end",
    "kind": f"case {_T} " + " ".join(f"when {t} then '{kind}'" for kind, ts in KINDS.items() for t in ts) + " end",
    "name": "'sp' || turn",
    "status": "case when conv_id % 7 = 0 then 'error' else 'ok' end",
    "started_at": "(1700000000 + conv_id * 100 + turn) || '.5'",
    "ended_at": "(1700000000 + conv_id * 100 + turn * 2 + 1) || '.75'",
    "agent_name": "'agent' || ((conv_id + turn * 2) % 7)",
    "function_name": "case when conv_id % 13 = 0 then '' else 'fn' || ((conv_id + turn) % 4) end",
    "input": "'q' || turn",
    "output": "case when conv_id % 9 = 0 then 'Error code: 403 jailbreak score 0.97' "
    "when conv_id % 7 = 0 then 'an error' else 'fine' end",
    "agent_tools": "'[]'",
    "agent_output_type": "'str'",
}
INGESTED_MS = "1704067200000 + (conv_id % 100) * 10800000"


def agent_documents(conversations: DataFrame, turns: int = 8) -> DataFrame:
    """One JSON document per conversation and block of `turns` turns. Parents are
    found in blocks of eight: fewer turns split traces over documents."""
    attributes = ["agent_name", "function_name", "input", "output", "agent_tools", "agent_output_type"]
    rows = conversations.selectExpr(
        "conv_id", "turn", f"turn div {turns} as block", *[f"{expr} as `{name}`" for name, expr in SPANS.items()]
    )
    number = lambda name: F.col(name).cast("double").alias(name)
    span = F.struct(
        "turn", "id", "parent_id", "kind", "name", "status", number("started_at"), number("ended_at"),
        F.struct(*attributes).alias("attributes"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    spans = F.transform("spans", lambda s: s.dropFields("turn"))
    document = F.struct(
        F.concat(F.lit("team"), F.col("conv_id") % 3).alias("team_id"),
        F.struct(F.concat(F.lit("lib"), F.col("conv_id") % 2).alias("library_name")).alias("resource"),
        F.array(F.struct(F.concat(F.lit("t"), "conv_id").alias("trace_id"), spans.alias("spans"))).alias("traces"),
    )
    return blocks.select(
        F.to_json(document).alias("raw_json"), F.expr(f"timestamp_millis({INGESTED_MS})").alias("ingested_at")
    )


# --- topic records -----------------------------------------------------------------


def records(rows: DataFrame, nested: tuple[str, ...] = ()) -> DataFrame:
    """Rows as JSON records; columns `<nested>_<x>` become object `<nested>`."""
    inner = {n: [c for c in rows.columns if c.startswith(f"{n}_")] for n in nested}
    moved = {c for columns in inner.values() for c in columns}
    objects = [
        F.struct(*[F.col(c).alias(c[len(n) + 1:]) for c in columns]).alias(n) for n, columns in inner.items()
    ]
    plain = [F.col(f"`{c}`") for c in rows.columns if c not in moved]
    return rows.select(F.to_json(F.struct(*plain, *objects)).alias("value"))


def damaged_records(events: DataFrame) -> DataFrame:
    """Trace records of which some are cut short and some are not objects."""
    value = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    return events.select(
        F.when(F.col("event_type") == "error", F.substring_index(value, ",", 2))
        .when(F.col("event_type") == "click", F.concat(F.lit("["), value, F.lit("]")))
        .otherwise(value)
        .alias("value")
    )


def mistyped_records(events: DataFrame) -> DataFrame:
    """Trace records of which some hold values of the wrong type, by kind of event."""
    odd = {
        "error": "'start_timestamp', 'soon', 'input', map('a', '1')",
        "click": "'app_id', array('z'), 'latency', 1.5D",
        "view": "'latency', 3000000000L, 'user', named_struct('id', map('x', 'y'))",
        "purchase": "'output', 5, 'end_timestamp', cast(null as bigint)",
    }
    value = F.lit(None).cast("string")
    for kind, fields in odd.items():
        record = F.expr(f"to_json(named_struct('trace_id', event_id, 'interaction_id', user_id, {fields}), map('ignoreNullFields', 'false'))")
        value = F.when(F.col("event_type") == kind, record).otherwise(value)
    plain = F.expr("to_json(named_struct('trace_id', 't' || event_id, 'latency', user_id, 'user', named_struct('id', 'u' || user_id)))")
    return events.select(F.coalesce(value, plain).alias("value"))


def document_traces(documents: DataFrame) -> DataFrame:
    """Traces that carry whole documents as their response."""
    return documents.select(
        F.concat(F.lit("t"), "doc_id").alias("trace_id"),
        F.concat_ws(" ", "source", "lang").alias("input"),
        F.coalesce("text", F.lit("")).alias("output"),
    )


def app_versions(nation: DataFrame) -> DataFrame:
    """Three versions of every app row, with a credential column."""
    versions = nation.withColumn("v", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))))
    return versions.selectExpr(
        "'app' || n_nationkey as id",
        "n_name || ' v' || v as name",
        "'secret' as modelApiKey",
        "timestamp_millis(1700000000000 + v * 1000) as updatedAt",
    )
