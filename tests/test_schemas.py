"""Column types, defaults and allowed values of the tables."""

import pytest

from tracefold import schemas
from tracefold.operators.spans import explode_spans
from tracefold.plans import derive
from tracefold.sources import records, tables
from tracefold.streaming.agents import TABLES

TIMES = {"start_time": "timestamp", "end_time": "timestamp", "event_date": "date", "event_hour": "timestamp"}


def _types(schema):
    return {f.name: f.dataType.simpleString() for f in schema.fields}


@pytest.mark.parametrize("load,schema,extra", [
    (records.ingest_traces, schemas.TRACES, TIMES),
    (records.ingest_traces_processed, schemas.TRACES_PROCESSED, {k.upper(): v for k, v in TIMES.items()}),
    (records.ingest_metrics, schemas.METRICS, TIMES),
    (records.ingest_discover_events, schemas.DISCOVER_EVENTS, {}),
    (records.ingest_gpt_usage, schemas.GPT_USAGE,
     {"detected_time": "timestamp", "event_date": "date", "event_hour": "timestamp", "is_deleted": "boolean"}),
])
def test_empty_object_loads_as_defaults(spark, load, schema, extra):
    rows = load(spark.createDataFrame([("{}",)], "value string"))
    assert dict(rows.dtypes) == _types(schema) | extra
    row = rows.first().asDict()
    nullable = schemas.DISCOVER_NULLABLE if schema is schemas.DISCOVER_EVENTS else ()
    for name, kind in _types(schema).items():
        if name in nullable and name not in ("date", "hour", "has_sensitive_data", "is_blocked", "is_warned", "event_format"):
            assert row[name] is None, name
        elif kind == "string" and name != "event_format":
            assert row[name] == "", name
        elif kind == "array<string>":
            assert row[name] == [], name
        elif kind in ("int", "bigint", "double"):
            assert row[name] == 0, name


def test_processed_traces_extend_traces():
    upper = {f.name.upper(): f.dataType for f in schemas.TRACES.fields}
    processed = {f.name: f.dataType for f in schemas.TRACES_PROCESSED.fields}
    assert upper.items() <= processed.items() and len(processed) == len(upper) + 16


@pytest.mark.parametrize("table", sorted(schemas.ENUMS))
def test_produced_values_are_allowed(spark, sf_dir, table):
    spans = explode_spans(derive.agent_documents(derive.read(spark, sf_dir, "conversations")))
    rows = TABLES[table](spans)
    assert rows.count() > 0 and tables.invalid_values(rows, table).count() == 0


def test_other_values_are_found(spark):
    rows = spark.createDataFrame([("success",), ("odd",)], "status string")
    assert tables.invalid_values(rows, "tool_requests").count() == 1


@pytest.mark.parametrize("table,old,young", [
    ("traces", "2023-01-13", "2023-01-14"), ("agent_traces", "2024-01-06", "2024-01-07"), ("tool_requests", "2023-10-15", "2023-10-16"),
])
def test_lifetimes(spark, table, old, young):
    date = schemas.LAYOUT[table][1]
    rows = spark.createDataFrame([(old,), (young,)], f"{date} string").selectExpr(f"cast({date} as date) as {date}")
    kept = tables.retain(rows, table, "2024-01-13 12:00:00").collect()
    assert [str(row[0]) for row in kept] == [young]
