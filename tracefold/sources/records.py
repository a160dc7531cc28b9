"""Topic records to table rows.

A record frame has one column `value` (text or binary), as Kafka and text
sources give it. Nothing here infers a schema: every table's columns are fixed.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import schemas
from tracefold.functions.json import json_str, parse
from tracefold.operators import events


# --- reading -------------------------------------------------------------------


def read_records(spark: SparkSession, source: str, path: str | None = None, stream: bool = False, **options: str) -> DataFrame:
    """Records of a topic: `source='kafka'` with the connector's options, or a
    folder of text files with one record per line."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format(source).options(**options)
    return reader.load(path) if path else reader.load()


# --- record transforms -----------------------------------------------------------


def flatten_record(df: DataFrame, delimiter: str = "_") -> DataFrame:
    """Nested struct fields as top-level columns; arrays stay as they are."""

    def leaves(path: tuple[str, ...], data_type: T.DataType):
        if isinstance(data_type, T.StructType):
            for child in data_type.fields:
                yield from leaves((*path, child.name), child.dataType)
        else:
            yield F.col(".".join(f"`{part}`" for part in path)).alias(delimiter.join(path))

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves((f.name,), f.dataType)])


def hoist_field(records: DataFrame, field: str = "raw_json") -> DataFrame:
    """The whole record as one text column."""
    return records.withColumn(field, F.col("value").cast("string")).drop("value")


def _is_object() -> Column:
    """Whether the record is a JSON object, read to its end but not built."""
    return F.json_object_keys(F.col("value").cast("string")).isNotNull()


def _bound(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.transform(F.array(value), use)[0]


def unfit_values(schema: T.StructType, flatten: bool = True, value: str = "value") -> Column:
    """Array of (column, kind): the values of a record that a load into `schema` would lose.

    Unfit are text or fractions in whole-number columns, whole numbers that are too
    large, text in number columns, what is no list in list columns, what is no date or
    time in such columns, and objects or lists in text columns. Numbers and flags fit
    text columns, which keep them as text; NULL fits every column. With `flatten`,
    nested objects are looked through as far as column names lead. `kind` is the JSON
    type found. A record that is no object has none.
    """
    names = schema.fieldNames()
    # Objects that lead to columns, such as user for user_id.
    inner = sorted({"_".join(n.split("_")[:i]) for n in names for i in range(1, n.count("_") + 1)}) if flatten else []
    depth = max((n.count("_") for n in names), default=0) if flatten else 0

    def among(path: Column, chosen: list[str]) -> Column:
        return F.array_contains(F.lit(chosen).cast("array<string>"), path)

    def fields(doc: Column) -> Column:
        return F.coalesce(
            F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>")),
            F.array().cast("array<struct<key:string,value:variant>>"),
        )

    def below(nodes: Column) -> Column:
        objects = F.filter(nodes, lambda x: among(x["key"], inner) & F.schema_of_variant(x["value"]).startswith("OBJECT"))
        return F.flatten(F.transform(objects, lambda x: F.transform(fields(x["value"]), lambda y: F.struct(
            F.concat_ws("_", x["key"], y["key"]).alias("key"), y["value"].alias("value")
        ))))

    def all_nodes(top: Column) -> Column:
        if not depth:
            return top
        grown = F.aggregate(
            F.sequence(F.lit(1), F.lit(depth)),
            F.struct(top.alias("all"), top.alias("last")),
            lambda done, _: _bound(below(done["last"]), lambda new: F.struct(
                F.concat(done["all"], new).alias("all"), new.alias("last")
            )),
        )
        return grown["all"]

    def of(kind: str) -> list[str]:
        return [f.name for f in schema.fields if f.dataType.simpleString() == kind]

    def lost(node: Column, kind: Column) -> Column:
        path, number = node["key"], kind.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
        nested = kind.isin("OBJECT", "ARRAY")
        out = among(path, of("string")) & nested & ~((kind == "OBJECT") & among(path, inner))
        out = out | (among(path, of("double")) & ~number)
        out = out | (among(path, [n for n in names if schema[n].dataType.typeName() == "array"]) & (kind != "ARRAY"))
        for whole in ("int", "bigint"):
            fits = (kind == "BIGINT") & F.try_variant_get(node["value"], "$", whole).isNotNull()
            out = out | (among(path, of(whole)) & ~fits)
        for time in ("date", "timestamp"):
            fits = (kind == "STRING") & F.try_variant_get(node["value"], "$", time).isNotNull()
            out = out | (among(path, of(time)) & ~fits)
        return out & (kind != "VOID")

    def judged(node: Column) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(node["value"]), "^[A-Z]+", 0)
        return _bound(kind, lambda k: F.struct(node["key"].alias("column"), k.alias("kind"), lost(node, k).alias("lost")))

    wanted = _bound(fields(parse(F.col(value).cast("string"))), all_nodes)
    verdicts = F.transform(F.filter(wanted, lambda x: among(x["key"], names)), judged)
    return F.transform(
        F.filter(verdicts, lambda v: v["lost"]),
        lambda v: F.struct(v["column"].alias("column"), v["kind"].alias("kind")),
    )


def split_records(
    records: DataFrame, tombstones: bool = False, schema: T.StructType | None = None, flatten: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad records are kept with a reason, never fail the job.

    A NULL value is a deletion where the topic allows `tombstones`, else bad. With
    `schema`, records with unfit values (see `unfit_values`) are bad too; the reason
    names the columns and what was found in them.
    """
    good = _is_object()
    if tombstones:
        good = good | F.col("value").isNull()
    reason = (
        F.when(F.col("value").isNull(), "empty")
        .when(parse(F.col("value").cast("string")).isNull(), "not JSON")
        .when(~_is_object(), "not an object")
    )
    if schema is None:
        return records.filter(good), records.filter(~good).withColumn("error", reason)
    unfit = F.transform(unfit_values(schema, flatten), lambda v: F.concat_ws(" ", v["column"], v["kind"]))
    names = F.concat(F.lit("unfit: "), F.array_join(F.array_sort(unfit), ", "))
    judged = records.withColumn("error", F.when(~good, reason).otherwise(F.nullif(names, F.lit("unfit: "))))
    return judged.filter("error is null").drop("error"), judged.filter("error is not null")


def quarantine_bad_records(records: DataFrame) -> DataFrame:
    """The records that cannot be loaded, with the reason."""
    return split_records(records)[1]


def quarantine_unfit_records(records: DataFrame, schema: T.StructType, flatten: bool = True) -> DataFrame:
    """The records that cannot be loaded into `schema` without loss, with the reason."""
    return split_records(records, schema=schema, flatten=flatten)[1]


def dedupe_redelivery(rows: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Drop copies that an at-least-once source delivered again.

    On a stream, `watermark` names the event-time column and how late a copy
    may come, which bounds the state kept.
    """
    if rows.isStreaming and watermark:
        return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


# --- typed loads -------------------------------------------------------------------


def _nestings(name: str) -> list[tuple[str, ...]]:
    """All nestings that flatten to this name: a_b is field a_b, or b inside a."""
    parts = name.split("_")
    out = []
    for joints in product("_.", repeat=len(parts) - 1):
        text = "".join(part + joint for part, joint in zip(parts, (*joints, "")))
        out.append(tuple(text.split(".")))
    return out


def _record_schema(tree: dict) -> T.StructType:
    """Parsing schema of a tree of names; a name that is both a value and an
    object in some nesting stays VARIANT."""
    fields = []
    for name, node in tree.items():
        children = {k: v for k, v in node.items() if k is not None}
        if not children:
            kind = node[None]
        elif None in node:
            kind = T.VariantType()
        else:
            kind = _record_schema(children)
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def _value(tree: dict, nesting: tuple[str, ...], data_type: T.DataType) -> Column:
    node, column = tree, F.col("doc")
    for depth, name in enumerate(nesting):
        node = node[name]
        column = column.getField(name)
        if None in node and len(node) > 1:
            path = ".".join(("$", *nesting[depth + 1:]))
            if path == "$" and isinstance(data_type, T.StringType):
                return F.nullif(json_str(column), F.lit(""))
            return F.try_variant_get(column, path, data_type.simpleString())
    return column


_DEFAULTS = {"string": "''", "int": "0", "bigint": "0L", "double": "0D"}


def load_rows(
    records: DataFrame, schema: T.StructType, flatten: bool = True, nullable: tuple[str, ...] = ()
) -> DataFrame:
    """Records as typed columns, each record parsed in one pass.

    With `flatten`, a column is also found inside nested objects. Missing or
    unfit values become the type's default unless the column is nullable.
    Records that are not JSON objects give no row (see `split_records`).
    """
    nestings = {f.name: _nestings(f.name) if flatten else [(f.name,)] for f in schema.fields}
    tree: dict = {}
    for field in schema.fields:
        for nesting in nestings[field.name]:
            node = tree
            for name in nesting:
                node = node.setdefault(name, {})
            node[None] = field.dataType

    def column(field: T.StructField) -> Column:
        value = F.coalesce(*[_value(tree, nesting, field.dataType) for nesting in nestings[field.name]])
        if field.name not in nullable:
            kind = field.dataType.simpleString()
            default = F.expr(_DEFAULTS[kind]) if kind in _DEFAULTS else F.array().cast(kind)
            value = F.coalesce(value, default)
        return value.alias(field.name)

    doc = F.from_json(F.col("value").cast("string"), _record_schema(tree))
    parsed = records.filter(_is_object()).select(doc.alias("doc"))
    return parsed.select(*[column(field) for field in schema.fields])


def ingest_traces(records: DataFrame) -> DataFrame:
    """Raw traces with computed times."""
    return events.traces_enriched(load_rows(records, schemas.TRACES))


def ingest_traces_processed(records: DataFrame) -> DataFrame:
    """Traces with KPIs, with computed times."""
    return events.traces_processed_enriched(load_rows(records, schemas.TRACES_PROCESSED))


def ingest_metrics(records: DataFrame) -> DataFrame:
    """Gateway metrics; nested fields of this topic are not flattened."""
    return events.metrics_enriched(load_rows(records, schemas.METRICS, flatten=False))


def ingest_discover_events(records: DataFrame) -> DataFrame:
    """Browser events with derived flags."""
    rows = load_rows(records, schemas.DISCOVER_EVENTS, nullable=schemas.DISCOVER_NULLABLE)
    return events.discover_events_enriched(rows)


def ingest_agent_traces(records: DataFrame, ingested_at: str | Column | None = None) -> DataFrame:
    """Whole records as text with the time of loading.

    A record frame may bring its own `ingested_at`, which then wins.
    """
    rows = hoist_field(records)
    if "ingested_at" not in rows.columns:
        at = F.current_timestamp() if ingested_at is None else F.lit(ingested_at)
        rows = rows.withColumn("ingested_at", at.cast("timestamp"))
    return rows.select("raw_json", "ingested_at", F.to_date("ingested_at").alias("ingested_date"))


def ingest_gpt_usage(records: DataFrame) -> DataFrame:
    """Assistant usage rows, with a delete marker for tombstones.

    Records may carry a `key` (JSON with the three key fields); a NULL value
    then marks the key as deleted as of the record's `timestamp` column.
    """
    rows = events.gpt_usage_enriched(load_rows(records, schemas.GPT_USAGE)).withColumn("is_deleted", F.lit(False))
    if "key" not in records.columns:
        return rows
    key = records.filter(F.col("value").isNull()).select(
        parse(F.col("key").cast("string")).alias("doc"), F.unix_millis("timestamp").alias("detected_at")
    )
    deleted = key.select(
        *[F.coalesce(F.try_variant_get("doc", f"$.{k}", "string"), F.lit("")).alias(k)
          for k in ("team_id", "gizmo_id", "author_user_id")],
        "detected_at",
        F.lit(True).alias("is_deleted"),
    )
    return rows.unionByName(deleted, allowMissingColumns=True)
