"""Plans and hot keys: what has to hold when the tables are large."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.helpers import plan, same
from tracefold.operators import agents, conversations, events, spans, topics, usage
from tracefold.plans import derive
from tracefold.sources import tables

# Queries that run a stream or write a table as they are built.
EAGER = {
    "ingest_traces", "ingest_traces_processed", "ingest_metrics", "ingest_discover_events", "ingest_stream",
    "monthly_layout_write", "skip_index_layout", "snapshot_export", "incremental_rollup",
    "incremental_conversations", "incremental_classifiers", "incremental_topics", "incremental_agent_tables",
    "incremental_tool_requests", "streaming_daily_counts", "incremental_agent_requests", "ingest_stream_monthly",
}
LAZY = sorted(set(contract.queries()) - EAGER)


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_or_python(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "ExistingRDD"):
        assert operator not in text, operator
    # One task for everything is never asked for, except for a total over nothing.
    assert "SinglePartition" not in text


@pytest.fixture(scope="module")
def table(spark, sf_dir, tmp_path_factory):
    """Processed traces as the library writes them."""
    path = str(tmp_path_factory.mktemp("tp") / "t")
    tables.write_table(derive.traces_processed(derive.read(spark, sf_dir, "events")), path, "traces_processed", clustered=True)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def apps(spark, sf_dir):
    return derive.apps(derive.read(spark, sf_dir, "nation"))


def _read_columns(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<(.*?)>\n", text)]


def test_usage_reads_no_text(table, apps):
    text = plan(usage.traces_metrics(table, apps))
    scans = [c for c in _read_columns(text) if "START_TIMESTAMP" in c or "APP_ID" in c]
    assert len(scans) == 5
    for columns in scans:
        assert not columns & {"INPUT", "OUTPUT", "OUTPUT_CLASSIFIERS", "CUSTOM", "TRACE_ID"}
    assert text.count("EqualTo(TASK,message)") == 5


def test_topics_push_their_filters(table):
    text = plan(topics.kpi_topics_1d(table))
    assert "EqualTo(TASK,message)" in text and "Not(EqualTo(OUTPUT_CLASSIFIERS,))" in text
    assert all("INPUT" not in columns for columns in _read_columns(text))


def test_date_ranges_prune_months(table):
    text = plan(tables.between_dates(table, "EVENT_DATE", "2024-01-03", "2024-01-05"))
    assert re.search(r"PartitionFilters: \[.*yyyymm.* >= 202401.*yyyymm.* <= 202401", text)
    assert "GreaterThanOrEqual(EVENT_DATE" in text


def test_layouts_hold_the_same_rows(spark, sf_dir, tmp_path):
    rows = derive.discover_events(derive.read(spark, sf_dir, "events"))
    rows = events.discover_events_enriched(rows)
    for clustered in (False, True):
        path = str(tmp_path / str(clustered))
        tables.write_table(rows, path, "discover_events", clustered=clustered)
        same(spark.read.parquet(path).drop("yyyymm").select(*rows.columns), rows)
    text = plan(tables.with_month(rows, "date").hint("rebalance", "yyyymm", "team_id"))
    assert "REBALANCE_PARTITIONS_BY_COL" in text


def test_retention_prunes_months(table):
    text = plan(tables.apply_retention(table, "EVENT_DATE", "12 MONTHS", "2025-01-20 00:00:00"))
    assert re.search(r"PartitionFilters: \[.*yyyymm.* >= 202401", text)


def test_partial_aggregation_before_every_shuffle_of_rows(table, apps):
    """Each aggregate over the table combines on the map side."""
    text = plan(usage.traces_metrics(table, apps))
    assert text.count("partial_") > 0
    first_shuffles = text.split("Exchange")[0]
    assert "HashAggregate" in first_shuffles


def test_costs_join_after_aggregation(table, apps):
    text = plan(usage.traces_usage_metrics(table, apps))
    tree = text.split("\n\n")[0]
    app_join = tree.index("Join")
    assert app_join < tree.index("HashAggregate")


def test_ranking_is_limited_before_the_shuffle(table):
    assert "WindowGroupLimit" in plan(usage.top_users(usage.traces_top_users(table), 3))


# --- hot keys -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hot(spark, sf_dir):
    """A third of all messages in one app, conversation, session, user and id."""
    tp = derive.traces_processed(derive.read(spark, sf_dir, "events"))
    is_hot = F.pmod(F.hash("TRACE_ID"), F.lit(3)) == 0
    fixed = {"APP_ID": "app1", "CONVERSATION_ID": "hot", "SESSION_ID": "hot", "USER_ID": "hot", "INTERACTION_ID": "hot"}
    rows = tp.withColumns({c: F.when(is_hot, v).otherwise(F.col(c)) for c, v in fixed.items()}).persist()
    yield rows
    rows.unpersist()


def test_hot_usage(hot, apps):
    got = usage.traces_metrics(hot, apps).select("APP_ID", "EVENT_DATE", "messages_count", "conversations_count",
                                                 "users_count", "sessions_count", "sentiment_prompt_positive")
    rows = hot.filter("TASK = 'message'").join(apps.select(F.col("id").alias("APP_ID")), "APP_ID")
    named = F.when(F.col("USER_ID") != "", F.col("USER_ID"))
    expected = rows.groupBy("APP_ID", "EVENT_DATE").agg(
        F.count_distinct("INTERACTION_ID").alias("messages_count"),
        F.count_distinct("CONVERSATION_ID").alias("conversations_count"),
        F.count_distinct(named).alias("users_count"),
        F.count_distinct(F.when(named.isNotNull(), F.col("SESSION_ID"))).alias("sessions_count"),
        F.count_distinct(F.when(F.col("SENTIMENT_PROMPT_POSITIVE") > 0.5, F.col("INTERACTION_ID")))
        .alias("sentiment_prompt_positive"),
    )
    same(got, expected)


def test_hot_conversation(hot, apps):
    state = conversations.CONVERSATIONS.partial(hot, apps)
    texts = conversations.conversation_classifiers(hot, apps)
    view = conversations.traces_conversations_view(state)
    row = view.filter("CONVERSATION_ID = 'hot'").first()
    rows = hot.filter("CONVERSATION_ID = 'hot' and TASK = 'message'")
    assert row.DIALOGUE_VOLUME == rows.count() > 100
    assert texts.filter("CONVERSATION_ID = 'hot'").count() == rows.count()


def test_hot_topic_durations(hot):
    timed = topics.conversation_duration(topics.TOPIC_CONVERSATIONS.partial(hot))
    labels = topics.classifier_labels(hot).filter("CONVERSATION_ID = 'hot'")
    low, high = labels.agg(F.min("START_TIMESTAMP"), F.max("END_TIMESTAMP")).first()
    durations = timed.filter("CONVERSATION_ID = 'hot'").select("duration_ms").distinct().collect()
    assert [r.duration_ms for r in durations] == [high - low]
    assert "Window" not in plan(timed)
    assert timed.filter("CONVERSATION_ID = 'hot'").count() < labels.count()


def test_durations_are_not_sent_to_the_driver(spark, hot):
    """Small or not, the lengths of all conversations are joined by sorting; a key may be NULL."""
    blank = F.when(F.col("CONVERSATION_ID") != "hot", F.col("CONVERSATION_ID"))
    state = topics.TOPIC_CONVERSATIONS.partial(hot.withColumn("CONVERSATION_ID", blank))
    timed = topics.conversation_duration(state)
    text = plan(timed)
    assert "SortMergeJoin" in text and "Broadcast" not in text
    assert timed.count() == state.count()
    low, high = state.filter("CONVERSATION_ID is null").groupBy("APP_ID").agg(F.min("min_start"), F.max("max_end")).first()[1:]
    assert {r.duration_ms for r in timed.filter("CONVERSATION_ID is null").collect()} == {high - low}


def test_stored_spans_are_read_by_kind(spark, sf_dir, tmp_path):
    documents = derive.agent_documents(derive.read(spark, sf_dir, "conversations"))
    text = plan(agents.tool_requests(spans.write_spans(documents, str(tmp_path / "s"))))
    assert "EqualTo(kind,tool)" in text and "EqualTo(kind,workflow)" in text
    parent = min(_read_columns(text), key=len)
    assert parent == {"team_id", "trace_id", "span_id", "kind", "agent_name", "ingested_at"}


def test_hot_parent_span(spark):
    """One agent that makes a third of all calls."""
    calls = spark.range(3000).select(
        F.struct(
            F.concat(F.lit("c"), "id").alias("id"),
            F.when(F.col("id") % 3 == 0, "p0").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("parent_id"),
            F.lit("tool").alias("kind"), F.lit("ok").alias("status"),
            F.struct(F.concat(F.lit("f"), F.col("id") % 7).alias("function_name"), F.lit("fine").alias("output"))
            .alias("attributes"),
        ).alias("call"),
        F.struct(F.concat(F.lit("p"), "id").alias("id"), F.lit("workflow").alias("kind"),
                 F.struct(F.concat(F.lit("a"), F.col("id") % 11).alias("agent_name")).alias("attributes")).alias("agent"),
    )
    spans_json = F.concat(F.lit("["), F.to_json("agent"), F.lit(","), F.to_json("call"), F.lit("]"))
    documents = calls.select(
        F.concat(F.lit('{"team_id":"t","traces":[{"trace_id":"x","spans":'), spans_json, F.lit("}]}")).alias("raw_json"),
        F.lit("2024-01-01").cast("timestamp").alias("ingested_at"),
    )
    rows = spans.explode_spans(documents)
    assert agents.tool_requests(rows).count() == 3000
    assert agents.agent_tool_permissions(rows).count() == 77
    edges = agents.agent_dependencies(rows)
    assert edges.agg(F.sum("connection_count")).first()[0] == 3000
