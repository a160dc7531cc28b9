"""One small case for every rule that is easy to get wrong."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import collected
from tracefold.functions.json import json_float, json_int, json_str, parse
from tracefold.functions.numbers import percent, ratio
from tracefold.functions.timeparts import date_of, parse_any_timestamp, second_of
from tracefold.operators import agent_views, agents, conversations, events, merge, spans, topics, usage
from tracefold.plans import derive
from tracefold.sources import dimensions, records, tables
from tracefold import schemas

NOW = "2024-01-13 12:00:00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


# --- scalar rules -------------------------------------------------------------------


def test_ansi_mode_is_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_json_defaults(spark):
    df = spark.createDataFrame(
        [('{"a":"x","n":5,"f":1.5,"l":[1],"o":{"a":"y"},"s":"7","z":""}',), ("junk",), (None,)], "t string"
    ).select(parse("t").alias("d"))
    row = df.select(
        json_str("d", "$.a"), json_str("d", "$.n"), json_str("d", "$.l"), json_str("d", "$.o.a"),
        json_str("d", "$.no"), json_str("d", "$.z", True), json_str("d", "$.a", True),
        json_int("d", "$.n"), json_int("d", "$.f"), json_int("d", "$.s"), json_int("d", "$.no"),
        json_float("d", "$.f"), json_float("d", "$.n"), json_float("d", "$.s"),
    ).collect()
    assert tuple(row[0]) == ("x", "", "", "y", "", None, "x", 5, 0, 0, 0, 1.5, 5.0, 0.0)
    for empty in row[1:]:
        assert tuple(empty) == ("", "", "", "", "", None, None, 0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_ratios_survive_zero(spark):
    row = one(spark.range(1).select(ratio(F.lit(1), F.lit(0)), percent(F.lit(1), F.lit(4))))
    assert tuple(row) == (None, 25.0)


def test_milliseconds_are_cut_not_rounded(spark):
    row = one(spark.range(1).select(
        second_of(F.lit(1704067199999)).cast("string"), date_of(F.lit(1704067199999)).cast("string"),
        date_of(F.lit(-1)).cast("string"),
    ))
    assert tuple(row) == ("2023-12-31 23:59:59", "2023-12-31", "1969-12-31")


@pytest.mark.parametrize("text,expected", [
    ("2024-03-05T06:07:08Z", "2024-03-05 06:07:08"),
    ("2024-03-05T06:07:08.250+02:00", "2024-03-05 04:07:08.25"),
    ("2024-03-05 06:07:08", "2024-03-05 06:07:08"),
    ("2024-03-05", "2024-03-05 00:00:00"),
    ("2024/03/05 06:07:08", "2024-03-05 06:07:08"),
    ("05/03/2024 06:07:08", "2024-03-05 06:07:08"),
    ("Tue, 05 Mar 2024 06:07:08 GMT", "2024-03-05 06:07:08"),
    ("1709618828", "2024-03-05 06:07:08"),
    ("1709618828000", "2024-03-05 06:07:08"),
    ("20240305060708", "2024-03-05 06:07:08"),
    ("20240305", "2024-03-05 00:00:00"),
    ("12:30", None),
    ("2024-13-45", None),
    ("n/a", None),
    ("", None),
])
def test_free_form_times(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(parse_any_timestamp("t").cast("string")))[0] == expected


# --- reconciliation -------------------------------------------------------------------


def test_latest_row_wins_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 9, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 1, 1, "w")],
                               "k string, v int, t int, val string")
    out = merge.latest_by_version(df, ["k"], "v", ["t"])
    assert out.columns == df.columns
    assert collected(out, df.columns) == ["('a', 2, 2, 'z')", "('b', 1, 1, 'w')"]


def test_signed_rows(spark):
    df = spark.createDataFrame(
        [("gone", 1, 1, "a"), ("gone", -1, 1, "a"), ("kept", 1, 1, "b"),
         ("new", 1, 1, "c"), ("new", -1, 1, "c"), ("new", 1, 2, "d"), ("odd", -1, 1, "e")],
        "id string, sign int, ver int, val string",
    )
    out = merge.collapse_by_sign(df, ["id"], "sign", ["ver"])
    assert collected(out, ["id", "sign", "ver", "val"]) == ["('kept', 1, 1, 'b')", "('new', 1, 2, 'd')"]


def test_tombstones(spark):
    value = lambda n, at: json.dumps({"team_id": "t", "gizmo_id": n, "author": {"user_id": "u"}, "detected_at": at})
    key = lambda n: json.dumps({"team_id": "t", "gizmo_id": n, "author_user_id": "u"})
    rows = [(value("g1", 1000), None, None), (value("g1", 2000), None, None), (value("g2", 1000), None, None),
            (None, key("g2"), "2024-01-01"), (value("g3", 1704067200001), None, None), (None, key("g3"), "2024-01-01")]
    df = spark.createDataFrame(rows, "value string, key string, ts string").withColumn("timestamp", F.to_timestamp("ts"))
    out = merge.gpt_usage_current(records.ingest_gpt_usage(df))
    assert collected(out, ["gizmo_id", "detected_at"]) == ["('g1', 2000)", "('g3', 1704067200001)"]


def test_dimension_without_secrets(spark):
    df = spark.createDataFrame([("a", "old", "k", 1), ("a", "new", "k", 2)],
                               "id string, name string, modelApiKey string, updatedAt int")
    out = dimensions.load_dimension(df)
    assert out.columns == ["id", "name", "updatedAt"] and one(out).name == "new"


# --- records ----------------------------------------------------------------------------


def _records(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_every_nesting_flattens(spark):
    flat = {"user_id": "u", "feedback_tag": "positive", "start_timestamp": 5}
    nested = {"user": {"id": "u"}, "feedback": {"tag": "positive"}, "start": {"timestamp": 5}}
    rows = records.ingest_traces(_records(spark, json.dumps(flat), json.dumps(nested)))
    assert len(set(collected(rows))) == 1
    row = rows.first()
    assert (row.user_id, row.feedback_tag, row.start_timestamp, row.input) == ("u", "positive", 5, "")


def test_a_name_that_is_value_and_object(spark):
    kinds = [
        {"SENTIMENT_PROMPT": "neutral", "SENTIMENT_PROMPT_POSITIVE": 0.5},
        {"SENTIMENT_PROMPT": {"POSITIVE": 0.5}},
        {"SENTIMENT": {"PROMPT": "neutral", "PROMPT_POSITIVE": 0.5}},
        {"SENTIMENT": {"PROMPT": {"POSITIVE": 0.5}}},
    ]
    rows = records.load_rows(_records(spark, *map(json.dumps, kinds)), schemas.TRACES_PROCESSED)
    got = [tuple(r) for r in rows.select("SENTIMENT_PROMPT", "SENTIMENT_PROMPT_POSITIVE").collect()]
    assert got == [("neutral", 0.5), ("", 0.5), ("neutral", 0.5), ("", 0.5)]


def test_metrics_are_not_flattened(spark):
    row = records.ingest_metrics(_records(spark, json.dumps({"user": {"ip": "x"}, "status_code": 200}))).first()
    assert (row.user_ip, row.status_code) == ("", 200)


def test_unfit_values_become_defaults(spark):
    row = records.ingest_traces(_records(spark, json.dumps({"latency": "x", "app_id": "a", "end_timestamp": 7}))).first()
    assert (row.latency, row.app_id, row.end_timestamp) == (0, "a", 7)


def test_repeated_keys_keep_the_row(spark):
    row = records.ingest_traces(_records(spark, '{"app_id":"a","app_id":"b"}')).first()
    assert row.app_id == "b"


def test_bad_records_are_set_aside(spark):
    df = _records(spark, '{"a":1}', '{"a":', "[1]", "5", None, "{}")
    good, bad = records.split_records(df)
    assert collected(good) == ["('{\"a\":1}',)", "('{}',)"]
    assert collected(bad, ["error"]) == ["('empty',)", "('not JSON',)", "('not an object',)", "('not an object',)"]
    assert records.split_records(df, tombstones=True)[0].count() == 3


def test_unfit_values_are_set_aside_with_their_reason(spark):
    def reasons(schema, *docs, flatten=True):
        df = _records(spark, *[json.dumps(d) for d in docs])
        good, bad = records.split_records(df, schema=schema, flatten=flatten)
        assert good.columns == df.columns and good.count() + bad.count() == len(docs)
        return {r.value: r.error.removeprefix("unfit: ") for r in bad.collect()}

    odd = {"input": {"a": 1}, "app_id": ["z"], "output": 5, "start_timestamp": "x"}
    fine = [
        {}, {"app_id": None, "latency": None}, {"output": True, "app_id": 7}, {"latency": 5, "start_timestamp": 1 << 40},
        {"user": {"id": "u", "other": [1]}}, {"unknown": {"app_id": []}, "feedback": "x"}, {"user_id": "", "feedback_tag": ""},
    ]
    assert reasons(schemas.TRACES, odd, *fine) == {json.dumps(odd): "app_id ARRAY, input OBJECT, start_timestamp STRING"}
    nested = {"user": {"id": ["x"], "phone": {"a": 1}}, "latency": 1.5, "end_timestamp": True}
    assert reasons(schemas.TRACES, nested) == {
        json.dumps(nested): "end_timestamp BOOLEAN, latency DECIMAL, user_id ARRAY, user_phone OBJECT"
    }
    big = {"latency": 1 << 31}
    assert reasons(schemas.TRACES, big) == {json.dumps(big): "latency BIGINT"}

    deep = {"SENTIMENT": {"PROMPT": {"POSITIVE": "much"}}}
    good = {"SENTIMENT_PROMPT": {"POSITIVE": 0.5}, "TOKENS": {"SPENT": {"PROMPT": 3}}, "READABILITY": {"RESPONSE": 1}}
    assert reasons(schemas.TRACES_PROCESSED, deep, good) == {json.dumps(deep): "SENTIMENT_PROMPT_POSITIVE STRING"}

    whole = {"user": {"ip": []}, "status_code": "200"}
    assert reasons(schemas.METRICS, whole, flatten=False) == {json.dumps(whole): "status_code STRING"}
    event = {"sensitive_data_types": "a", "date": "2024-01-02", "hour": "noon", "tab_id": 4}
    assert reasons(schemas.DISCOVER_EVENTS, event) == {json.dumps(event): "hour STRING, sensitive_data_types STRING"}


def test_unfit_and_unreadable_records_together(spark):
    df = _records(spark, '{"latency":"x"}', '{"latency":', "[1]", None, '{"latency":1}')
    good, bad = records.split_records(df, schema=schemas.TRACES)
    assert collected(good) == ["('{\"latency\":1}',)"]
    assert collected(bad, ["error"]) == ["('empty',)", "('not JSON',)", "('not an object',)", "('unfit: latency STRING',)"]
    assert records.split_records(df, tombstones=True, schema=schemas.TRACES)[0].count() == 2
    assert records.quarantine_unfit_records(df, schemas.TRACES).count() == 4


def test_flatten_keeps_arrays(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.array(F.lit(2)).alias("l")).alias("a"))
    assert records.flatten_record(df).columns == ["a_b_c", "a_l"]


def test_agent_records_stay_whole(spark):
    row = records.ingest_agent_traces(_records(spark, "any text"), NOW).first()
    assert row.raw_json == "any text" and str(row.ingested_date) == "2024-01-13"


# --- event tables ---------------------------------------------------------------------------


def test_supplied_defaults_win(spark):
    df = spark.createDataFrame([(1704067261500, "block", "navigation", 2, None), (1704067261500, "allow", "x", None, 1)],
                               "timestamp bigint, action string, event_type string, sensitive_data_count bigint, is_blocked int")
    rows = events.discover_events_enriched(df).withColumn("hour", F.col("hour").cast("string")).collect()
    assert [(r.is_blocked, r.has_sensitive_data, r.is_warned, r.event_format) for r in rows] == [
        (1, 1, 0, "old"), (1, 0, 0, "new")]
    assert rows[0].hour == "2024-01-01 00:01:01" and rows[1].sensitive_data_types == []


def test_rows_without_a_date_are_kept(spark):
    rows = spark.createDataFrame([(1, "2020-01-01"), (2, None), (3, "2024-01-01")], "id int, d string")
    kept = tables.apply_retention(rows.withColumn("d", F.to_date("d")), "d", "12 MONTHS", "2024-01-20 00:00:00")
    assert {r.id for r in kept.collect()} == {2, 3}


def test_retention_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([("2023-01-19",), ("2023-01-20",), ("2023-01-21",), ("2024-01-01",)], "d string")
    df = df.withColumn("d", F.to_date("d"))
    path = str(tmp_path / "t")
    tables.write_monthly(df, path, "d", ["d"])
    back = spark.read.parquet(path)
    kept = tables.apply_retention(back, "d", "12 MONTHS", "2024-01-20 00:00:00")
    assert collected(kept, ["d"]) == ["(datetime.date(2023, 1, 21),)", "(datetime.date(2024, 1, 1),)"]
    assert [r.yyyymm for r in tables.expired_months(back, "12 MONTHS", "2024-03-20 00:00:00").collect()] == [202301]
    assert tables.between_dates(back, "d", "2023-01-20", "2023-02-01").count() == 2


def test_expired_months_are_dropped_from_a_table(spark, tmp_path):
    df = spark.createDataFrame([("2023-01-19", 1), ("2024-01-01", 2)], "d string, x int").withColumn("d", F.to_date("d"))
    spark.sql("drop table if exists retained")
    tables.with_month(df, "d").write.partitionBy("yyyymm").option("path", str(tmp_path / "r")).saveAsTable("retained")
    assert tables.drop_expired_months(spark, "retained", "12 MONTHS", "2024-03-20") == [202301]
    assert spark.table("retained").count() == 1
    spark.sql("drop table retained")


# --- traces -----------------------------------------------------------------------------------


def _tp(spark, sf_dir):
    return derive.traces_processed(derive.read(spark, sf_dir, "events"))


def test_unknown_apps(spark, sf_dir):
    """Usage and conversations drop unknown apps; topics keep them at no cost."""
    tp, apps = _tp(spark, sf_dir), derive.apps(derive.read(spark, sf_dir, "nation"))
    lone = "APP_ID in ('app25', 'app26')"
    assert tp.filter(lone).count() > 0
    assert usage.traces_usage_metrics(tp, apps).filter(lone).count() == 0
    assert conversations.CONVERSATIONS.partial(tp, apps).filter(lone).count() == 0
    view = topics.kpi_topics_1d_view(*[r.partial(tp) for r in topics.TOPIC_ROLLUPS], apps).filter(lone)
    assert view.count() > 0 and view.filter("COST <> 0").count() == 0


def test_new_user_only_on_first_day(spark, sf_dir):
    tp = _tp(spark, sf_dir)
    users = usage.traces_user_metrics(tp)
    known = tp.filter("TASK = 'message' and USER_ID <> ''").select("APP_ID", "USER_ID").distinct().count()
    assert users.agg(F.sum("new_users_count")).first()[0] == known


def test_empty_channel_counts(spark, sf_dir):
    assert usage.traces_channel_metrics(_tp(spark, sf_dir)).filter("channel = ''").count() > 0
    assert usage.traces_device_metrics(_tp(spark, sf_dir)).filter("DEVICE = ''").count() == 0


def test_unmerged_counters(spark):
    rows = [("a", "2024-01-01", "2024-01-01", "u", 1), ("a", "2024-01-01", "2024-01-01", "u", 4), ("a", "2024-01-01", "2024-01-01", "v", 3)]
    df = spark.createDataFrame(rows, "APP_ID string, EVENT_DATE string, day string, USER_ID string, interaction_count bigint")
    row = one(usage.traces_engagement_metrics(df))
    assert (row.active_users, row.avg_calls_per_user, row.max_calls_per_user) == (2, 4.0, 5)


def test_odd_classifiers(spark, sf_dir):
    """A broken item loses itself, not its neighbours."""
    texts = [
        '[{"ID":1,"CATEGORY":"c","LABEL":["a",5,{"x":1}],"SCORE":3}, 5, "s", {"ID":1.5,"CATEGORY":7,"LABEL":["q"]}, {"ID":9,"LABEL":"no"}]',
        "[]", "", "junk", '{"ID":1,"LABEL":["k"]}', "[null]", None,
    ]
    df = spark.createDataFrame([(t, "message") for t in texts] + [(texts[0], "system")], "OUTPUT_CLASSIFIERS string, TASK string")
    got = collected(topics.classifier_labels(df), ["CLASSIFIER_ID", "CATEGORY_ID", "LABEL_ID", "SCORE"])
    assert got == ["(0, '', 'q', 0)", "(1, 'c', '', 3)", "(1, 'c', '', 3)", "(1, 'c', 'a', 3)"]


def test_polarity_is_checked(spark, sf_dir):
    with pytest.raises(ValueError):
        topics.kpi_topics_1d_view(None, None, None, None, denominator="x")


def test_classifier_lists_hold_every_message(spark, sf_dir):
    """Conversations of any length, the blank one too, have one row per message."""
    tp, apps = _tp(spark, sf_dir), derive.apps(derive.read(spark, sf_dir, "nation"))
    tp = tp.withColumn("CONVERSATION_ID", F.when(F.hash("TRACE_ID") % 3 == 0, "").otherwise(F.col("CONVERSATION_ID")))
    volumes = conversations.traces_conversations_view(conversations.CONVERSATIONS.partial(tp, apps))
    texts = conversations.conversation_classifiers(tp, apps).groupBy("APP_ID", "CONVERSATION_ID").count()
    columns = ["APP_ID", "CONVERSATION_ID", "DIALOGUE_VOLUME"]
    assert collected(texts.withColumnRenamed("count", "DIALOGUE_VOLUME"), columns) == collected(volumes, columns)
    assert volumes.filter("CONVERSATION_ID = ''").count() > 0


# --- agents -------------------------------------------------------------------------------------


def _document(spans_, team="t1", ingested=NOW, trace="tr", **extra):
    return (json.dumps({"team_id": team, "resource": {"library_name": "lib"},
                        "traces": [{"trace_id": trace, "spans": spans_}], **extra}), ingested)


def _spans(spark, *documents, **options):
    df = spark.createDataFrame(list(documents), "raw_json string, at string")
    return spans.explode_spans(df.select("raw_json", F.to_timestamp("at").alias("ingested_at")), **options)


def _agent(id_, name="a1", parent="", **attributes):
    return {"id": id_, "parent_id": parent, "kind": "workflow", "status": "ok", "started_at": 1.5, "ended_at": 2.75,
            "attributes": {"agent_name": name, **attributes}}


def _call(id_, parent, output="fine", status="ok", fn="f1", name="n1"):
    return {"id": id_, "parent_id": parent, "kind": "tool", "status": status, "name": name, "started_at": 1, "ended_at": 3,
            "attributes": {"function_name": fn, "output": output, "input": "i"}}


def test_broken_documents_and_spans(spark):
    good = _document([_agent("s0"), 7, {"id": 8, "kind": "workflow", "attributes": "x"}])
    df = _spans(spark, good, ("junk", NOW), ("[1]", NOW), ('{"traces":3}', NOW))
    assert df.filter("kind = 'workflow' and agent_name <> ''").count() == 1
    assert df.count() == 3
    raw = spark.createDataFrame([("junk",), ("{}",)], "raw_json string")
    assert spans.unparsed_documents(raw).count() == 1


def test_missing_team(spark):
    document = json.dumps({"resource": {"team_id": "r"}, "traces": [{"spans": [_agent("s0")]}]})
    assert one(_spans(spark, (document, NOW))).team_id == ""
    assert one(_spans(spark, (document, NOW), blank_as_null=True)).team_id == "r"


def test_fallback_tool_name(spark):
    document = _document([_agent("s0"), _call("s1", "s0", fn="", name="spare")])
    assert agents.tool_requests(_spans(spark, document)).count() == 0
    assert one(agents.tool_requests(_spans(spark, document, blank_as_null=True))).tool_id == "spare"


@pytest.mark.parametrize("output,status,expected,approved", [
    ("fine", "ok", "success", True),
    ("an error", "ok", "error", True),
    ("fine", "error", "error", True),
    ("Error code: 403", "ok", "success", False),
    ("jailbreak score 0.97", "ok", "success", False),
    ("jailbreak error", "ok", "blocked", False),
    ("Error code: 403", "error", "blocked", False),
])
def test_request_status(spark, output, status, expected, approved):
    row = one(agents.tool_requests(_spans(spark, _document([_agent("s0"), _call("s1", "s0", output, status)]))))
    assert (row.status, row.approved, row.duration_ms) == (expected, approved, 2000.0)
    assert row.error_message == (output if "error" in output else "")


@pytest.mark.parametrize("output,score", [
    ("jailbreak score 0.97", 0.97), ("jailbreak score 0.95", 0.95), ("jailbreak score 0.90", 0.90), ("Error code: 403", 0.85),
])
def test_guardian_score(spark, output, score):
    row = one(agents.guardian_invocations(_spans(spark, _document([_agent("s0"), _call("s1", "s0", output + "x" * 600)]))))
    assert row.risk_score == pytest.approx(score, rel=1e-6) and row.reason == output + "x" * 600
    assert row.metadata == '{"tool": "f1"}'


def test_blank_ids_link_nothing(spark):
    """Spans without ids are nobody's parent; blank parents are no parent."""
    spans_ = [_agent("", f"a{i}") for i in range(5)] + [_call("", "", fn=f"f{i}") for i in range(5)]
    df = _spans(spark, _document(spans_))
    assert agents.tool_requests(df).count() == agents.agent_dependencies(df).count() == 0
    assert agents.agent_tool_permissions(df).count() == 0
    assert agents.agent_requests(df).count() == 5
    named = _spans(spark, _document([_agent("s0"), _call("", "s0"), _call("", "s0")]))
    assert agents.tool_requests(named).count() == 2


def test_redelivered_spans_count_once(spark):
    """A span that comes again replaces its older row, parents too."""
    first = _document([_agent("s0", "old"), _agent("s2", "aide", "s0"), _call("s1", "s0", "jailbreak")])
    again = _document([_agent("s0", "new"), _agent("s2", "aide", "s0"), _call("s1", "s0", "jailbreak x")],
                      ingested="2024-01-14 12:00:00")
    df = _spans(spark, first, first, again)
    assert collected(agents.tool_requests(df), ["agent_id", "response_data"]) == ["('new', 'jailbreak x')"]
    assert collected(agents.guardian_invocations(df), ["agent_id", "reason"]) == ["('new', 'jailbreak x')"]
    assert collected(agents.agent_requests(df), ["agent_id", "parent_agent_id"]) == ["('aide', 'new')", "('new', '')"]
    assert collected(agents.agent_dependencies(df), ["source_agent_id", "target_id", "connection_count"]) == [
        "('new', 'aide', 2)", "('new', 'f1', 2)"]


def test_latest_child_wins(spark):
    llm = lambda id_, at, text: {"id": id_, "parent_id": "s0", "kind": "llm", "started_at": at,
                                 "attributes": {"input": text, "output": text}}
    row = one(agents.agent_requests(_spans(spark, _document([_agent("s0", agent_tools=["x"]), llm("l1", 5, "new"), llm("l2", 3, "old")]))))
    assert (row.input_data, row.agent_tools, row.duration_ms) == ("new", "", 1250.0)


def test_untimed_request(spark):
    span = _agent("s0") | {"started_at": 0}
    assert one(agents.agent_requests(_spans(spark, _document([span])))).duration_ms == 0.0


def test_dependency_paths(spark):
    document = _document([
        _agent("s0", "boss"), _agent("s1", "aide", "s0"), _call("s2", "s0"), _agent("s3", "deep", "s2"),
        _agent("s4", "boss", "s0"), _call("s5", "s2", fn="f2"), _agent("s6", "", "s0"),
    ])
    edges = agents.agent_dependencies(_spans(spark, document, document))
    got = collected(edges, ["source_agent_id", "target_type", "target_id", "dependency_type", "connection_count"])
    assert got == ["('boss', 'agent', 'aide', 'calls', 1)", "('boss', 'agent', 'deep', 'calls', 1)",
                   "('boss', 'tool', 'f1', 'uses', 1)"]


def test_same_ids_in_other_teams_do_not_meet(spark):
    df = _spans(spark, _document([_agent("s0")], "t1"), _document([_call("s1", "s0")], "t2"))
    assert agents.tool_requests(df).count() == 0


def test_agent_view_defaults_and_windows(spark):
    df = _spans(
        spark,
        _document([_agent("s0"), _call("s1", "s0", "jailbreak")], ingested="2024-01-13 11:00:00"),
        _document([_agent("s0"), _call("s1", "s0")], ingested="2024-01-01 11:00:00", trace="earlier"),
        _document([_agent("s9", "idle")], team="t2", ingested="2023-01-01 00:00:00"),
    )
    view = agent_views.v_agents_with_metrics(
        agents.agents(df), agents.guardian_invocations(df), agents.agent_requests(df), agents.agent_tool_permissions(df), NOW)
    columns = ["agent_id", "guardian_invocations_24h", "requests_24h", "requests_total", "allowed_tools"]
    assert collected(view, columns) == ["('a1', 1, 1, 2, ['f1'])", "('idle', 0, 0, 1, [])"]
    permissions = one(agent_views.v_agent_permissions_with_metrics(agents.agent_tool_permissions(df), agents.tool_requests(df), NOW))
    assert (permissions.requests_24h, permissions.requests_1m, permissions.approved) == (1, 2, True)
    graph = one(agent_views.v_agent_dependency_graph(agents.agent_dependencies(df), NOW))
    assert (graph.target_id, graph.connection_count) == ("f1", 2)
