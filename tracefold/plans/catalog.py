"""Named queries: every operator over input derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold import schemas
from tracefold.functions import enrich
from tracefold.functions.timeparts import date_of, month_of
from tracefold.operators import agent_views, agents, conversations, events, merge, spans, topics, usage
from tracefold.operators.rollup import merge_states, sum_counters
from tracefold.plans import derive
from tracefold.session import prepare, work_dir
from tracefold.sources import dimensions, records, tables
from tracefold.streaming.agents import IncrementalAgentTables
from tracefold.streaming.counts import read_daily_counts, start_daily_counts
from tracefold.streaming.ingest import MonthlyTopic, TopicTable
from tracefold.streaming.rollup import IncrementalRollups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query, name: str | None = None) -> Query:
    """Register under the function's name, in a session with our settings."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    QUERIES[name or build.__name__] = run
    return run


def _tp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.traces_processed(derive.read(spark, sf_dir, "events"))


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.apps(derive.read(spark, sf_dir, "nation"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.agent_documents(derive.read(spark, sf_dir, "conversations"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.explode_spans(_documents(spark, sf_dir))


def _spans_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that were all delivered twice."""
    documents = _documents(spark, sf_dir)
    return spans.explode_spans(documents.unionByName(documents))


def _stored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as a written table, for operators that read them several times."""
    return spans.write_spans(_documents(spark, sf_dir), work_dir(spark, "spans"))


def _finish(stream_query) -> None:
    stream_query.awaitTermination()


# --- ingest ------------------------------------------------------------------------


def _topic(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """Records as a topic archive on disk, one per line, as a load job reads it."""
    path = work_dir(spark, f"{name}-topic")
    rows.write.text(path)
    return records.read_records(spark, "text", path)


@query
def ingest_traces(spark, sf_dir):
    rows = derive.traces(derive.read(spark, sf_dir, "events"))
    return records.ingest_traces(_topic(spark, "traces", derive.records(rows, ("user", "feedback"))))


@query
def ingest_traces_processed(spark, sf_dir):
    rows = derive.select(derive.read(spark, sf_dir, "events"), derive.TRACES_PROCESSED)
    topic = _topic(spark, "traces_processed", derive.records(rows, ("USER", "FEEDBACK", "NUM", "TOKENS")))
    return records.ingest_traces_processed(topic)


@query
def ingest_metrics(spark, sf_dir):
    rows = derive.metrics(derive.read(spark, sf_dir, "events"))
    loaded = records.ingest_metrics(_topic(spark, "metrics", derive.records(rows)))
    return loaded.select(*rows.columns, "start_time", "end_time", "event_date", "event_hour")


_DISCOVER_DERIVED = ("date", "hour", "has_sensitive_data", "is_blocked", "is_warned", "event_format")


@query
def ingest_discover_events(spark, sf_dir):
    rows = derive.discover_events(derive.read(spark, sf_dir, "events"))
    topic = _topic(spark, "discover_events", derive.records(rows, ("sensitive", "application")))
    loaded = records.ingest_discover_events(topic)
    return loaded.select(*rows.columns, *_DISCOVER_DERIVED)


@query
def ingest_agent_traces(spark, sf_dir):
    rows = derive.read(spark, sf_dir, "documents")
    return records.ingest_agent_traces(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), derive.AS_OF)


@query
def ingest_gpt_usage(spark, sf_dir):
    """Upserts with a deletion of every key that starts with team0."""
    rows = derive.gpt_usage(derive.read(spark, sf_dir, "orders"))
    upserts = derive.records(rows).select(
        "value", F.lit(None).cast("string").alias("key"), F.lit(None).cast("timestamp").alias("timestamp")
    )
    keys = rows.filter("team_id = 'team0'").select(*merge.GPT_USAGE_KEYS).distinct()
    deletes = keys.select(
        F.lit(None).cast("string").alias("value"),
        F.to_json(F.struct(*keys.columns)).alias("key"),
        F.lit("2100-01-01").cast("timestamp").alias("timestamp"),
    )
    loaded = records.ingest_gpt_usage(upserts.unionByName(deletes))
    current = merge.gpt_usage_current(loaded, ("name",))
    return current.select(*merge.GPT_USAGE_KEYS, "name", "num_interactions", "detected_at", "detected_time")


@query
def flatten_record(spark, sf_dir):
    nested = derive.read(spark, sf_dir, "events").select(
        "event_id",
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("name")).alias("last")).alias("user"),
        F.struct("value").alias("score"),
    )
    return records.flatten_record(nested)


@query
def hoist_field(spark, sf_dir):
    rows = derive.read(spark, sf_dir, "conversations")
    return records.hoist_field(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")))


@query
def quarantine_bad_records(spark, sf_dir):
    bad = records.quarantine_bad_records(derive.damaged_records(derive.read(spark, sf_dir, "events")))
    return bad.groupBy("error").agg(F.count("*").alias("records"))


@query
def quarantine_unfit_values(spark, sf_dir):
    """Trace records with values of the wrong type, through the streaming sink: rows loaded and records set aside."""
    base = work_dir(spark, "quarantine_unfit_values")
    stream = derive.mistyped_records(derive.read_stream(spark, sf_dir, "events"))
    topic = TopicTable(base, records.ingest_traces, schema=schemas.TRACES)
    _finish(topic.start(stream))
    loaded = topic.rows(spark).select(F.lit("").alias("error"), "trace_id", F.col("latency").cast("bigint").alias("latency"))
    ids = F.get_json_object("value", "$.trace_id")
    aside = topic.bad(spark).select("error", ids.alias("trace_id"), F.lit(None).cast("bigint").alias("latency"))
    return loaded.unionByName(aside)


@query
def dedupe_redelivery(spark, sf_dir):
    """Every record delivered twice comes out once."""
    rows = derive.traces(derive.read(spark, sf_dir, "events")).select("trace_id", "app_id", "start_timestamp", "input")
    return records.dedupe_redelivery(rows.unionByName(rows), ["trace_id"])


@query
def ingest_stream(spark, sf_dir):
    """The trace topic through the streaming sink."""
    stream = derive.read_stream(spark, sf_dir, "events")
    topic = TopicTable(work_dir(spark, "ingest_stream"), records.ingest_traces)
    _finish(topic.start(derive.records(derive.traces(stream), ("user", "feedback"))))
    return topic.rows(spark)


@query
def ingest_stream_monthly(spark, sf_dir):
    """The trace topic, every record delivered twice in batches far apart, through the laid-out sink.

    One month is folded halfway; the last third of the deliveries comes after that.
    """
    base = work_dir(spark, "ingest_stream_monthly")
    events = derive.read(spark, sf_dir, "events").withColumn("part", F.expr("pmod(xxhash64(event_id), 3)"))
    again = events.withColumn("part", (F.col("part") + 1) % 3)
    topic = MonthlyTopic(f"{base}/table", "traces", records.ingest_traces, ("trace_id",))
    for number in range(3):
        part = events.filter(F.col("part") == number).unionByName(again.filter(F.col("part") == number)).drop("part")
        stream = _in_batches(spark, part.repartition(2), f"{base}/events", mode="append")
        _finish(topic.start(derive.records(derive.traces(stream), ("user", "feedback"))))
        if number == 1:
            topic.merge(spark, topic.months(spark)[0])
    return topic.rows(spark)


@query
def monthly_layout_write(spark, sf_dir):
    """Monthly partitions of a table that spans years, read back."""
    rows = derive.gpt_usage(derive.read(spark, sf_dir, "orders")).withColumn("event_date", date_of("detected_at"))
    path = work_dir(spark, "monthly_layout_write")
    tables.write_table(rows.drop("timestamp"), path, "gpt_usage")
    back = spark.read.parquet(path)
    return back.groupBy("yyyymm", "team_id").agg(F.count("*").alias("n"), F.max("detected_at").alias("newest"))


@query
def apply_retention(spark, sf_dir):
    rows = _tp(spark, sf_dir).withColumn("yyyymm", month_of("EVENT_DATE"))
    kept = tables.apply_retention(rows, "EVENT_DATE", "12 MONTHS", "2025-01-20 00:00:00")
    return kept.select("TRACE_ID", "EVENT_DATE", "yyyymm")


@query
def skip_index_layout(spark, sf_dir):
    """Browser events written with lookup indexes, read back."""
    rows = events.discover_events_enriched(derive.discover_events(derive.read(spark, sf_dir, "events")))
    path = work_dir(spark, "skip_index_layout")
    tables.write_table(rows, path, "discover_events")
    return spark.read.parquet(path).groupBy("application_id", "action", "yyyymm").agg(F.count("*").alias("n"))


@query
def snapshot_export(spark, sf_dir):
    """Rows, values and characters of every copied table."""
    paths = tables.snapshot_export(
        {name: derive.read(spark, sf_dir, name) for name in derive.TABLE_KEYS}, work_dir(spark, "snapshot_export"), "stamp"
    )
    counted = []
    for name, path in paths.items():
        key, text = derive.TABLE_KEYS[name]
        counted.append(spark.read.parquet(path).agg(
            F.count("*").alias("n"),
            F.count_distinct(key).alias("keys"),
            F.sum(key).cast("bigint").alias("key_sum"),
            F.sum(F.char_length(text) if text else F.lit(0)).cast("bigint").alias("chars"),
        ).select(F.lit(name).alias("table_name"), "n", "keys", "key_sum", "chars"))
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


@query
def enrich_traces_words(spark, sf_dir):
    """Word, token and readability figures of whole documents."""
    rows = enrich.enrich_traces(derive.document_traces(derive.read(spark, sf_dir, "documents")))
    return rows.select(
        "TRACE_ID", "NUM_WORDS_PROMPT", "NUM_WORDS_RESPONSE", "TOKENS_SPENT_PROMPT", "TOKENS_SPENT_RESPONSE",
        F.round("READABILITY_RESPONSE", 6).alias("READABILITY_RESPONSE"),
    )


@query
def enrich_traces(spark, sf_dir):
    """All KPI columns; languages and sentiments are this library's defaults."""
    rows = enrich.enrich_traces(derive.document_traces(derive.read(spark, sf_dir, "documents")))
    return rows.withColumn("READABILITY_RESPONSE", F.round("READABILITY_RESPONSE", 6)).drop("INPUT", "OUTPUT")


@query
def load_dimensions(spark, sf_dir):
    return dimensions.load_dimensions({"apps": derive.app_versions(derive.read(spark, sf_dir, "nation"))})["apps"]


# --- reconciliation ------------------------------------------------------------------


@query
def latest_by_version(spark, sf_dir):
    """Newest order of every customer."""
    orders = derive.read(spark, sf_dir, "orders")
    return merge.latest_by_version(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query
def collapse_by_sign(spark, sf_dir):
    rows = derive.tests(derive.read(spark, sf_dir, "orders"))
    return merge.collapse_by_sign(rows, ["id"], "sign", ["ver"])


@query
def current_tests(spark, sf_dir):
    return merge.current_tests(derive.tests(derive.read(spark, sf_dir, "orders")), ("ver",))


@query
def current_test_runs(spark, sf_dir):
    return merge.current_test_runs(derive.tests(derive.read(spark, sf_dir, "orders")), ("ver",))


@query
def gpt_usage_current(spark, sf_dir):
    rows = derive.gpt_usage(derive.read(spark, sf_dir, "orders")).drop("timestamp")
    return merge.gpt_usage_current(rows, ("o_orderkey",))


@partial(query, name="merge_states")
def _merge_states(spark, sf_dir):
    """States per app, day and language merged to one row per app."""
    state = usage.USAGE_DAYS.partial(_tp(spark, sf_dir), keys=("APP_ID", "EVENT_DATE", "LANG_PROMPT"))
    spec = {name: kind for name, (kind, _) in usage.USAGE_DAYS.measures.items()}
    return merge_states(state, ["APP_ID"], spec)


@partial(query, name="sum_counters")
def _sum_counters(spark, sf_dir):
    counters = usage.traces_language_metrics(_tp(spark, sf_dir))
    return sum_counters(counters, ["APP_ID", "LANG_PROMPT"], ["language_count"])


# --- usage ---------------------------------------------------------------------------


@query
def traces_usage_metrics(spark, sf_dir):
    return usage.traces_usage_metrics(_tp(spark, sf_dir), _apps(spark, sf_dir))


@query
def traces_user_metrics(spark, sf_dir):
    return usage.traces_user_metrics(_tp(spark, sf_dir)).drop("countries")


@query
def traces_metrics(spark, sf_dir):
    return usage.traces_metrics(_tp(spark, sf_dir), _apps(spark, sf_dir))


_ROUNDED = ("avg_", "sentiment_", "readability", "feedback_", "prompt_cost", "response_cost", "total_cost")


@query
def traces_metrics_total(spark, sf_dir):
    """Averages of ratios are rounded: their last digit depends on the order
    of addition, which no engine promises."""
    totals = usage.traces_metrics_total(traces_metrics(spark, sf_dir))
    return totals.select(*[
        F.round(c, 6).alias(c) if c.startswith(_ROUNDED) else F.col(c) for c in totals.columns
    ])


@query
def traces_language_metrics(spark, sf_dir):
    return usage.traces_language_metrics(_tp(spark, sf_dir))


@query
def traces_language_daily(spark, sf_dir):
    return usage.traces_language_daily(usage.traces_language_metrics(_tp(spark, sf_dir)))


@query
def conversation_message_counts(spark, sf_dir):
    return usage.conversation_message_counts(_tp(spark, sf_dir))


@query
def single_message_rate(spark, sf_dir):
    return usage.single_message_rate(usage.conversation_message_counts(_tp(spark, sf_dir)))


@query
def traces_country_metrics(spark, sf_dir):
    return usage.traces_country_metrics(_tp(spark, sf_dir))


@query
def traces_device_metrics(spark, sf_dir):
    return usage.traces_device_metrics(_tp(spark, sf_dir))


@query
def traces_browser_metrics(spark, sf_dir):
    return usage.traces_browser_metrics(_tp(spark, sf_dir))


@query
def traces_os_metrics(spark, sf_dir):
    return usage.traces_os_metrics(_tp(spark, sf_dir))


@query
def traces_channel_metrics(spark, sf_dir):
    return usage.traces_channel_metrics(_tp(spark, sf_dir))


@query
def traces_user_engagement(spark, sf_dir):
    return usage.traces_user_engagement(_tp(spark, sf_dir))


@query
def traces_engagement_metrics(spark, sf_dir):
    return usage.traces_engagement_metrics(usage.traces_user_engagement(_tp(spark, sf_dir)))


@query
def traces_top_users(spark, sf_dir):
    return usage.traces_top_users(_tp(spark, sf_dir))


@query
def top_users(spark, sf_dir):
    return usage.top_users(usage.traces_top_users(_tp(spark, sf_dir)), 5)


@query
def users_countries_daily(spark, sf_dir):
    """Country list as text: name and count."""
    rows = usage.users_countries_daily(_tp(spark, sf_dir))
    text = F.transform("countries", lambda c: F.concat_ws(":", c["country"], c["n"].cast("string")))
    return rows.withColumn("countries", F.array_join(text, ","))


@query
def approx_usage(spark, sf_dir):
    """Exact counts next to whether the estimates are within their bound."""
    tp = _tp(spark, sf_dir)
    return usage.approx_usage_checked(usage.APPROX_DAYS.partial(tp), tp)


# --- conversations ---------------------------------------------------------------------

_LISTS = ("LANG_PROMPT", "LANG_RESPONSE", "SENTIMENT_PROMPT", "SENTIMENT_RESPONSE")


def _lists_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.array_join(name, ",") for name in _LISTS})


@query
def traces_conversations(spark, sf_dir):
    return _lists_as_text(conversations.traces_conversations(_tp(spark, sf_dir), _apps(spark, sf_dir)))


@query
def traces_conversations_view(spark, sf_dir):
    tp, apps = _tp(spark, sf_dir), _apps(spark, sf_dir)
    # Whole conversations at once: per-day states would be shuffled a second time.
    state = conversations.CONVERSATIONS.partial(tp, apps, keys=conversations.CONVERSATION)
    return _lists_as_text(conversations.traces_conversations_view(state))


@query
def conversation_classifiers(spark, sf_dir):
    return conversations.conversation_classifiers(_tp(spark, sf_dir), _apps(spark, sf_dir))


# --- topics ------------------------------------------------------------------------------


@query
def classifier_labels(spark, sf_dir):
    labels = topics.classifier_labels(_tp(spark, sf_dir))
    return labels.select("TRACE_ID", "APP_ID", "CLASSIFIER_ID", "CATEGORY_ID", "LABEL_ID", "SCORE")


@query
def conversation_duration(spark, sf_dir):
    state = topics.TOPIC_CONVERSATIONS.partial(_tp(spark, sf_dir))
    return topics.conversation_duration(state).select(
        F.col("EVENT_DATE").alias("day"), *topics.TOPIC[1:], "CONVERSATION_ID", "n", "duration_ms"
    )


@query
def kpi_topics_1d(spark, sf_dir):
    return topics.kpi_topics_1d(_tp(spark, sf_dir))


def _topic_view(spark, sf_dir, denominator: str) -> DataFrame:
    tp = _tp(spark, sf_dir)
    # States without SCORE from the start, so that merging them needs no shuffle.
    states = [
        rollup.partial(tp, keys=[key for key in rollup.keys if key != "SCORE"]) for rollup in topics.TOPIC_ROLLUPS
    ]
    return topics.kpi_topics_1d_view(*states, _apps(spark, sf_dir), denominator=denominator)


@query
def kpi_topics_1d_view(spark, sf_dir):
    return _topic_view(spark, sf_dir, "messages")


@query
def kpi_topics_1d_view_polarity(spark, sf_dir):
    return _topic_view(spark, sf_dir, "polarity")


# --- agents --------------------------------------------------------------------------------


@query
def explode_spans(spark, sf_dir):
    return _spans(spark, sf_dir).drop("doc_id", "position", "called_name")


def _agent_query(operator, source, suffix: str = "") -> None:
    def build(spark, sf_dir):
        return operator(source(spark, sf_dir))

    query(build, operator.__name__ + suffix)


for _operator in (
    agents.agents,
    agents.tools,
    agents.agent_tool_permissions,
    agents.tool_requests,
    agents.guardian_invocations,
):
    _agent_query(_operator, _spans)
for _operator in (agents.agent_dependencies, agents.agent_requests):
    _agent_query(_operator, _stored_spans)
for _operator in (
    agents.tool_requests, agents.guardian_invocations, agents.agent_dependencies, agents.agent_requests
):
    _agent_query(_operator, _spans_twice, "_redelivered")


@query
def v_agents_with_metrics(spark, sf_dir):
    rows = _stored_spans(spark, sf_dir)
    view = agent_views.v_agents_with_metrics(
        agents.agents(rows),
        agents.guardian_invocations(rows),
        agents.agent_requests(rows),
        agents.agent_tool_permissions(rows),
        derive.AS_OF,
    )
    return view.withColumn("allowed_tools", F.array_join("allowed_tools", ","))


@query
def v_agent_permissions_with_metrics(spark, sf_dir):
    rows = _stored_spans(spark, sf_dir)
    return agent_views.v_agent_permissions_with_metrics(
        agents.agent_tool_permissions(rows), agents.tool_requests(rows), derive.AS_OF
    )


@query
def v_agent_dependency_graph(spark, sf_dir):
    return agent_views.v_agent_dependency_graph(agents.agent_dependencies(_stored_spans(spark, sf_dir)), derive.AS_OF)


# --- events ----------------------------------------------------------------------------------


@query
def discover_events_enriched(spark, sf_dir):
    rows = events.discover_events_enriched(derive.discover_events(derive.read(spark, sf_dir, "events")))
    return rows.drop("sensitive_data_types", "sensitive_data_categories")


@query
def metrics_enriched(spark, sf_dir):
    return events.metrics_enriched(derive.metrics(derive.read(spark, sf_dir, "events")))


@query
def gpt_usage_enriched(spark, sf_dir):
    return events.gpt_usage_enriched(derive.gpt_usage(derive.read(spark, sf_dir, "orders"))).drop("timestamp")


# --- streaming ---------------------------------------------------------------------------------


def _in_batches(spark: SparkSession, rows: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Rows as a stream of several micro-batches, by way of stored files.

    A micro-batch is one file; its row groups are small, so that several tasks read it.
    """
    rows.write.mode(mode).option("parquet.block.size", 2 << 20).parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _late_events(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """The event table cut by time, newest part first."""
    rows = derive.read(spark, sf_dir, "events").repartitionByRange(3, F.desc("ts"))
    return _in_batches(spark, rows, f"{base}/events")


def _rollups(spark, sf_dir, name, rollups, sides=None) -> IncrementalRollups:
    """Run the whole event table through the roll-ups as a stream."""
    base = work_dir(spark, name)
    tables_ = IncrementalRollups(f"{base}/tables", rollups, sides or {})
    _finish(tables_.start(derive.traces_processed(_late_events(spark, sf_dir, base))))
    return tables_


@query
def incremental_rollup(spark, sf_dir):
    """Daily metrics from streamed, compacted states."""
    needed = (usage.USAGE_DAYS, usage.MESSAGE_DAYS, usage.CONVERSATION_DAYS, usage.USER_DAYS, usage.SESSION_DAYS)
    stored = _rollups(spark, sf_dir, "incremental_rollup", needed)
    stored.compact(spark)
    days, messages, convs, users, sessions = [stored.state(spark, r) for r in needed]
    return usage.finish_metrics(
        usage.finish_usage(days, messages, convs, _apps(spark, sf_dir)),
        usage.finish_users(users, sessions),
    )


@query
def incremental_conversations(spark, sf_dir):
    """Whole conversations from streamed states."""
    apps = _apps(spark, sf_dir)
    rollup = conversations.CONVERSATIONS
    stored = _rollups(spark, sf_dir, "incremental_conversations", (rollup,), {rollup.name: (apps,)})
    return _lists_as_text(conversations.traces_conversations_view(stored.partials(spark, rollup)))


@query
def incremental_classifiers(spark, sf_dir):
    """Classifier lists of conversations from streamed, folded rows."""
    kept = conversations.CLASSIFIERS
    stored = _rollups(spark, sf_dir, "incremental_classifiers", (kept,), {kept.name: (_apps(spark, sf_dir),)})
    stored.compact(spark)
    return stored.state(spark, kept)


@query
def incremental_topics(spark, sf_dir):
    """Topic figures from streamed states."""
    stored = _rollups(spark, sf_dir, "incremental_topics", topics.TOPIC_ROLLUPS)
    states = [stored.partials(spark, rollup) for rollup in topics.TOPIC_ROLLUPS]
    return topics.kpi_topics_1d_view(*states, _apps(spark, sf_dir))


@query
def incremental_user_metrics(spark, sf_dir):
    """User figures of a range of days from states folded after every batch, with the first days of users kept.

    The newest events come first, so that every batch moves first days.
    """
    needed = (usage.USER_DAYS, usage.SESSION_DAYS, usage.LOCATION_DAYS, usage.FIRST_SEEN)
    base = work_dir(spark, "incremental_user_metrics")
    stored = IncrementalRollups(f"{base}/tables", needed, fanout=2)
    rows = derive.read(spark, sf_dir, "events")
    cut = rows.agg(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.6))).alias("at")).first()["at"]
    age = F.when(F.col("ts") > cut[1], 0).when(F.col("ts") > cut[0], 1).otherwise(2)
    for part in range(3):
        stream = _in_batches(spark, rows.filter(age == part).repartition(2), f"{base}/events", mode="append")
        _finish(stored.start(derive.traces_processed(stream)))
        stored.compact(spark)
    days, sessions, places = [stored.state(spark, r, *derive.USER_RANGE) for r in needed[:3]]
    return usage.finish_users(days, sessions, places, stored.state(spark, usage.FIRST_SEEN)).drop("countries")


@query
def incremental_agent_tables(spark, sf_dir):
    """Dependency graph from streamed agent tables."""
    stored = _stream_documents(spark, "incremental_agent_tables", _documents(spark, sf_dir))
    return agent_views.v_agent_dependency_graph(stored.table(spark, "agent_dependencies"), derive.AS_OF)


@query
def incremental_tool_requests(spark, sf_dir):
    """Tool requests when traces are split over documents and micro-batches."""
    parts = derive.agent_documents(derive.read(spark, sf_dir, "conversations"), turns=4)
    return _stream_documents(spark, "incremental_tool_requests", parts).table(spark, "tool_requests")


@query
def incremental_agent_requests(spark, sf_dir):
    """Agent requests when traces are split over micro-batches that are folded in between."""
    parts = derive.agent_documents(derive.read(spark, sf_dir, "conversations"), turns=4)
    base = work_dir(spark, "incremental_agent_requests")
    stored = IncrementalAgentTables(f"{base}/tables", buckets=8)
    for half in (parts.filter("xxhash64(raw_json) % 2 = 0"), parts):  # the second brings the first again
        _finish(stored.start(_in_batches(spark, half.repartition(2), f"{base}/documents", mode="append")))
        stored.compact(spark)
    return stored.table(spark, "agent_requests")


def _stream_documents(spark: SparkSession, name: str, documents: DataFrame) -> IncrementalAgentTables:
    """Every document streamed twice, in three micro-batches of random order."""
    base = work_dir(spark, name)
    stored = IncrementalAgentTables(f"{base}/tables")
    shuffled = documents.unionByName(documents).repartition(3)
    _finish(stored.start(_in_batches(spark, shuffled, f"{base}/documents")))
    return stored


@query
def streaming_daily_counts(spark, sf_dir):
    """Messages per language from a stream whose newest rows come first."""
    base = work_dir(spark, "streaming_daily_counts")
    stream = derive.traces_processed(_late_events(spark, sf_dir, base))
    _finish(start_daily_counts(stream, f"{base}/counts", ["LANG_PROMPT"]))
    return read_daily_counts(spark, f"{base}/counts", ["LANG_PROMPT"])
