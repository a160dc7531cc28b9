"""Streaming sinks give what the batch operators give."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import collected, plan, same
from tracefold.operators.spans import explode_spans
from tracefold.plans import derive
from tracefold.session import work_dir
from tracefold.sources import records
from tracefold.streaming import ingest
from tracefold.streaming.agents import TABLES, IncrementalAgentTables
from tracefold.streaming.batches import last_commit
from tracefold.streaming.counts import read_daily_counts, start_daily_counts
from tracefold.streaming.ingest import MonthlyTopic, TopicTable


def test_topic_with_bad_records(spark, tmp_path):
    source = str(tmp_path / "topic")
    lines = [json.dumps({"app_id": f"a{i}", "user": {"id": f"u{i}"}}) for i in range(20)] + ['{"app_id":', "[1]", "text"]
    spark.createDataFrame([(line,) for line in lines], "value string").repartition(4).write.text(source)
    topic = TopicTable(str(tmp_path / "table"), records.ingest_traces)
    stream = records.read_records(spark, "text", source, stream=True, maxFilesPerTrigger="1")
    topic.start(stream).awaitTermination()
    assert last_commit(spark, topic.checkpoint) == 3
    assert topic.rows(spark).select("user_id").distinct().count() == 20
    assert topic.rows(spark).count() == 20
    assert collected(topic.bad(spark), ["error"]) == ["('not JSON',)", "('not JSON',)", "('not an object',)"]


DAY = 86_400_000


def _trace(number, day, **more):
    return json.dumps({"trace_id": f"t{number}", "app_id": "a", "start_timestamp": day * DAY, **more})


def test_monthly_topic(spark, tmp_path):
    topic = MonthlyTopic(str(tmp_path / "table"), "traces", records.ingest_traces, ("trace_id",))
    first = [_trace(i, 10 + i % 3 * 31) for i in range(30)]
    same_key = [_trace("", 10, input="x"), _trace("", 10, input="y")]  # t without a number: one key
    batches = [
        [*first[:20], *first[:5], "[1]"],
        [*first[10:], *same_key],
        [*first, _trace(99, 75)],  # copies that come after the month was folded
    ]
    source = str(tmp_path / "topic")
    for number, lines in enumerate(batches):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(source)
        topic.start(records.read_records(spark, "text", source, stream=True)).awaitTermination()
        assert last_commit(spark, topic.checkpoint) == number
        if number == 1:
            assert topic.merge(spark, 197001) == 1
    got = sorted(r.trace_id for r in topic.rows(spark).collect())
    assert got == sorted([*(f"t{i}" for i in range(30)), "t", "t99"])
    assert topic.months(spark) == [197001, 197002, 197003]
    assert topic.bad(spark).count() == 1
    files = topic.rows(spark, [197002]).select(F.input_file_name()).distinct().collect()
    assert files and all("yyyymm=197002" in f[0] for f in files)
    folded = topic.rows(spark, [197001]).select(F.input_file_name()).distinct().collect()
    assert len(folded) == 1 and "/merged/yyyymm=197001/upto=1" in folded[0][0]
    batch = spark.createDataFrame([(x,) for x in batches[2]], "value string")
    topic.write(batch, 2)  # again
    assert topic.rows(spark).count() == 32


@pytest.mark.parametrize("records_a_task, most", [(50_000, 30), (4, 4)])
def test_a_batch_in_one_part_is_parsed_by_many_tasks(spark, tmp_path, monkeypatch, records_a_task, most):
    """A task parses a bounded number of records, and copies still go."""
    monkeypatch.setattr(ingest, "RECORDS", records_a_task)
    base = str(tmp_path / "table")
    sizes = []

    def load(rows):
        sizes.append(max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()))
        return records.ingest_traces(rows)

    topic = MonthlyTopic(base, "traces", load, ("trace_id",))
    for number in range(2):
        lines = [_trace(i, 10 + i % 2 * 31) for i in range(number * 15, number * 15 + 29)] + ["[1]"]
        topic.write(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), number)
    assert max(sizes) <= most
    got = [r.trace_id for r in spark.read.parquet(f"{base}/rows").collect()]
    assert sorted(got) == sorted(f"t{i}" for i in range(44))
    assert spark.read.parquet(f"{base}/bad").count() == 2


def test_monthly_topic_without_keys(spark, tmp_path):
    topic = MonthlyTopic(str(tmp_path / "table"), "traces", records.ingest_traces)
    lines = [_trace(1, 10, input="x"), _trace(1, 10, input="y"), _trace(1, 10, input="x")]
    for number in range(2):
        topic.write(spark.createDataFrame([(x,) for x in lines], "value string"), number)
    assert spark.read.parquet(f"{topic.base}/rows").count() == 2


def test_topic_batch_again(spark, tmp_path):
    topic = TopicTable(str(tmp_path), records.ingest_traces)
    batch = spark.createDataFrame([('{"app_id":"a"}',)], "value string")
    topic.write(batch, 0)
    topic.write(batch, 0)
    assert spark.read.parquet(f"{topic.base}/rows").count() == 1


def test_agent_tables_in_batches(spark, sf_dir, tmp_path):
    source = str(tmp_path / "documents")
    documents = derive.agent_documents(derive.read(spark, sf_dir, "conversations"))
    documents.repartition(3).write.parquet(source)
    stored = IncrementalAgentTables(str(tmp_path / "tables"))
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stored.start(stream).awaitTermination()
    spans = explode_spans(documents)
    for name, derive_table in TABLES.items():
        same(stored.table(spark, name), derive_table(spans))


def test_links_and_documents_across_batches(spark, tmp_path):
    span = lambda id_, parent, kind, **names: {"id": id_, "parent_id": parent, "kind": kind, "attributes": names}
    boss, call = span("p", "", "workflow", agent_name="boss"), span("c", "p", "tool", function_name="f")
    texts = [json.dumps({"team_id": "t", "traces": [{"trace_id": "x", "spans": s}]}) for s in ([call], [boss])]
    stored = IncrementalAgentTables(str(tmp_path / "tables"))
    for text in [*texts, texts[0]]:  # the child comes before its parent, and again
        row = spark.createDataFrame([(text,)], "raw_json string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
        row.write.mode("append").parquet(str(tmp_path / "documents"))
    stream = spark.readStream.schema(row.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "documents"))
    stored.start(stream).awaitTermination()
    assert stored.table(spark, "tool_requests").count() == 1
    assert [r.connection_count for r in stored.table(spark, "agent_dependencies").collect()] == [1]


def _documents(spark, spans, trace):
    text = json.dumps({"team_id": "t", "traces": [{"trace_id": trace, "spans": spans}]})
    return spark.createDataFrame([(text,)], "raw_json string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))


def test_a_batch_reads_its_own_traces(spark, tmp_path):
    span = lambda id_, parent, kind, **names: {"id": id_, "parent_id": parent, "kind": kind, "attributes": names}
    stored = IncrementalAgentTables(str(tmp_path), buckets=32)
    parents = None
    for k in range(12):
        row = _documents(spark, [span("p", "", "workflow", agent_name=f"boss{k}")], f"x{k}")
        parents = row if parents is None else parents.unionByName(row)
    stored.write(parents, 0)
    stored.write(_documents(spark, [span("c", "p", "tool", function_name="f")], "x3"), 1)
    read = stored.spans_of_touched(spark, 1)
    assert sorted(r.span_id for r in read.collect()) == ["c", "p"]
    (filters,) = [line for line in plan(read).split("\n") if "PartitionFilters" in line and "bucket" in line]
    assert re.search(r"\(bucket#\d+ = \d+\)|bucket#\d+ IN \(\d+\)", filters)  # one of 32 buckets
    rows = spark.read.parquet(f"{tmp_path}/live/tool_requests")
    assert [(r.agent_id, r.batch_id) for r in rows.collect()] == [("boss3", 1)]
    stored.write(_documents(spark, [span("c", "p", "tool", function_name="f")], "x3"), 1)  # again
    assert spark.read.parquet(f"{tmp_path}/live/tool_requests").count() == 1


def test_agent_tables_folded(spark, sf_dir, tmp_path):
    source = str(tmp_path / "documents")
    documents = derive.agent_documents(derive.read(spark, sf_dir, "conversations"), turns=2)
    stored = IncrementalAgentTables(str(tmp_path / "tables"), buckets=4)
    not_json = spark.createDataFrame([("{", None)], documents.schema)
    for seed, part in enumerate((documents.sample(0.5, 1), documents, not_json)):
        part.coalesce(1).write.mode("append").parquet(source)
        stored.start(spark.readStream.schema(documents.schema).parquet(source)).awaitTermination()
        assert stored.compact(spark) == seed
    spans = explode_spans(documents)
    for name, derive_table in TABLES.items():
        same(stored.table(spark, name), derive_table(spans))
    assert spark.read.parquet(f"{stored.base}/bad").count() == 1


def test_old_traces_leave_the_spans(spark, tmp_path):
    span = {"id": "p", "parent_id": "", "kind": "workflow", "attributes": {"agent_name": "boss"}}
    source, stored = str(tmp_path / "documents"), IncrementalAgentTables(str(tmp_path / "tables"))
    _documents(spark, [span], "old").write.parquet(source)
    new = _documents(spark, [span], "new").withColumn("ingested_at", F.lit("2024-02-01").cast("timestamp"))
    new.write.mode("append").parquet(source)
    stored.start(spark.readStream.schema(new.schema).parquet(source)).awaitTermination()
    stored.compact(spark, "7 DAYS", "2024-02-02 00:00:00")
    assert [r.trace_id for r in spark.read.parquet(f"{stored.base}/folded/upto=0/spans").collect()] == ["new"]
    assert stored.table(spark, "agent_requests").count() == 2


def test_daily_counts_in_batches(spark, sf_dir, tmp_path):
    source = str(tmp_path / "tp")
    tp = derive.traces_processed(derive.read(spark, sf_dir, "events"))
    # Newest file first: all others bring rows that are weeks late.
    middle = tp.agg(F.percentile_approx("START_TIMESTAMP", 0.5)).first()[0]
    for part in (f"START_TIMESTAMP > {middle}", f"START_TIMESTAMP <= {middle}"):
        tp.filter(part).coalesce(2).write.mode("append").parquet(source)
    files = spark.readStream.schema(tp.schema).option("maxFilesPerTrigger", 1).parquet(source)
    base = str(tmp_path / "counts")
    start_daily_counts(files, base, ["USER_ID"]).awaitTermination()
    direct = tp.filter("TASK = 'message'").groupBy("APP_ID", "EVENT_DATE", "USER_ID").count()
    same(read_daily_counts(spark, base, ["USER_ID"]), direct)


def test_redelivery_in_a_stream(spark, sf_dir, tmp_path):
    source = str(tmp_path / "twice")
    rows = derive.traces_processed(derive.read(spark, sf_dir, "events")).select("TRACE_ID", "START_TIME")
    rows.write.parquet(source)
    rows.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    once = records.dedupe_redelivery(stream, ["TRACE_ID"], ("START_TIME", "40 days"))
    out = str(tmp_path / "once")
    once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == rows.count()


def test_shared_folder_is_the_clusters(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first.startswith(base) and first != second


def test_no_commit_yet(spark, tmp_path):
    assert last_commit(spark, str(tmp_path / "none")) == -1
    with pytest.raises(Exception):
        IncrementalAgentTables(str(tmp_path)).table(spark, "agents")
