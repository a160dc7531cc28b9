"""Agent tables fed by a stream of agent-trace documents.

What a span means depends on other spans of its trace, and those may come in any
batch. A micro-batch therefore

1. parses its documents once and stores their spans, by bucket of their trace;
2. reads the stored spans of the traces it touched, from their buckets only;
3. derives those traces' rows anew and stores them under its number.

A trace's rows are those of the newest batch that touched it, so a read joins rows
with the batch numbers of their traces and computes nothing from spans. The work of
a batch follows the traces it touches. `compact` folds spans into one generation and
drops rows that newer batches have replaced, and spans that are older than traces
live; readers see the old generation or the new one.

A replayed batch writes the same folders again. Spans without a trace id are one
trace per team, as in the batch operators. Documents that are not JSON are kept in
`bad`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from tracefold.operators import agents as ops
from tracefold.operators.merge import latest_by_version
from tracefold.operators.spans import explode_spans, unparsed_documents
from tracefold.streaming.batches import last_commit, read_batches, run_batches, together, write_batch

TABLES = {
    "agents": ops.agents,
    "tools": ops.tools,
    "agent_tool_permissions": ops.agent_tool_permissions,
    "tool_requests": ops.tool_requests,
    "agent_dependencies": ops.agent_dependencies,
    "guardian_invocations": ops.guardian_invocations,
    "agent_requests": ops.agent_requests,
}

Derive = Callable[[DataFrame], DataFrame]

#: What a batch stores of the spans it brought, and how the rows of all batches are merged.
BY_BATCH: dict[str, tuple[Derive, Derive]] = {
    "agents": (ops.agents, lambda rows: latest_by_version(rows, ops.AGENT, "updated_at")),
    "tools": (ops.tools, lambda rows: latest_by_version(rows, ops.TOOL, "updated_at")),
}
#: What a batch stores of whole traces, and what becomes of the valid rows.
BY_TRACE: dict[str, tuple[Derive, Derive]] = {
    "agent_tool_permissions": (ops.permission_uses, ops.newest_permissions),
    "tool_requests": (ops.tool_requests, lambda rows: rows),
    "agent_dependencies": (ops.dependency_edges, ops.count_dependencies),
    "guardian_invocations": (ops.guardian_invocations, lambda rows: rows),
    "agent_requests": (ops.agent_requests, lambda rows: rows),
}

TRACE = ["team_id", "trace_id"]


def _span_schema(spark: SparkSession) -> StructType:
    """Of stored spans; a batch without spans has no file to read it from."""
    nothing = spark.range(0).select(F.lit("").alias("raw_json"), F.current_timestamp().alias("ingested_at"))
    return explode_spans(nothing).schema.add("bucket", IntegerType())


@dataclass(frozen=True)
class IncrementalAgentTables:
    base: str
    buckets: int = 64

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    def _live(self, name: str) -> str:
        return f"{self.base}/live/{name}"

    def _folded(self, upto: int, name: str) -> str:
        return f"{self.base}/folded/upto={upto}/{name}"

    def write(self, documents: DataFrame, batch_id: int) -> None:
        """Add one batch; the same batch again replaces itself."""
        spark = documents.sparkSession
        documents = documents.persist()
        try:
            bucket = F.pmod(F.xxhash64(*TRACE), F.lit(self.buckets)).cast("int")
            spans = explode_spans(documents).withColumn("bucket", bucket)
            spans = spans.hint("rebalance", "bucket").sortWithinPartitions("bucket", *TRACE)
            spans.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._live('spans')}/batch_id={batch_id}")
            write_batch(unparsed_documents(documents), f"{self.base}/bad", batch_id)
        finally:
            documents.unpersist()
        own = spark.read.schema(_span_schema(spark)).parquet(f"{self._live('spans')}/batch_id={batch_id}")
        write_batch(own.select(*TRACE, "bucket").distinct(), self._live("touched"), batch_id)
        # written once, for five tables read it, each its own columns
        write_batch(self.spans_of_touched(spark, batch_id).drop("bucket", "batch_id"), f"{self.base}/work", batch_id)
        whole = spark.read.parquet(f"{self.base}/work/batch_id={batch_id}")
        jobs = [partial(write_batch, derive(own), self._live(name), batch_id) for name, (derive, _) in BY_BATCH.items()]
        jobs += [partial(write_batch, derive(whole), self._live(name), batch_id) for name, (derive, _) in BY_TRACE.items()]
        together(jobs)

    def spans_of_touched(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """All spans, up to a batch, of the traces that this batch touched; other buckets are not read."""
        touched = spark.read.parquet(f"{self._live('touched')}/batch_id={batch_id}")
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most `buckets`
        stored = self._rows(spark, "spans", batch_id).filter(F.col("bucket").isin(buckets))
        return stored.join(touched, [*TRACE, "bucket"], "left_semi")

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return run_batches(stream, self.checkpoint, self.write, every=every)

    def _folded_upto(self, spark: SparkSession) -> int:
        try:
            newest = spark.read.schema("upto bigint").json(f"{self.base}/manifest").agg(F.max("upto").alias("n")).first().n
        except AnalysisException:
            return -1
        return -1 if newest is None else newest

    def _rows(self, spark: SparkSession, name: str, upto: int) -> DataFrame:
        """What the batches up to `upto` stored, with their numbers."""
        folded = self._folded_upto(spark)
        parts = []
        if folded >= 0:
            parts.append(spark.read.parquet(self._folded(folded, name)))
        if upto > folded:
            schema = _span_schema(spark).add("batch_id", LongType()) if name == "spans" else None
            parts.append(read_batches(spark, self._live(name), folded, upto, schema))
        if not parts:
            raise ValueError(f"no committed batch of {name} yet")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].withColumn("batch_id", F.col("batch_id").cast("bigint")))

    def _valid(self, spark: SparkSession, name: str, upto: int) -> DataFrame:
        """Rows of the newest batch of each trace."""
        newest = self._rows(spark, "touched", upto).groupBy(*TRACE).agg(F.max("batch_id").alias("batch_id"))
        return self._rows(spark, name, upto).join(newest, [*TRACE, "batch_id"], "left_semi")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """One of `TABLES` over all committed batches."""
        upto = last_commit(spark, self.checkpoint)
        if name in BY_BATCH:
            return BY_BATCH[name][1](self._rows(spark, name, upto).drop("batch_id"))
        return BY_TRACE[name][1](self._valid(spark, name, upto).drop("batch_id"))

    def compact(self, spark: SparkSession, keep: str | None = None, as_of: str | None = None) -> int:
        """Fold the committed batches into one generation; gives the last batch folded.

        With `keep` (an interval such as '7 DAYS') and `as_of`, traces whose newest span
        is older leave the stored spans: their rows stay, but spans that come still later
        no longer find them. Folded files are whole before the manifest names them. Old
        folders are left for clean-up once no reader uses them.
        """
        upto = last_commit(spark, self.checkpoint)
        if upto <= self._folded_upto(spark):
            return upto
        batch = F.col("batch_id").cast("bigint").alias("batch_id")
        newest = self._rows(spark, "touched", upto).groupBy(*TRACE, "bucket").agg(F.max(batch).alias("batch_id"))
        spans = self._rows(spark, "spans", upto).withColumn("batch_id", batch)
        if keep:
            alive = spans.groupBy(*TRACE, "bucket").agg(F.max("ingested_at").alias("newest"))
            alive = alive.filter(F.col("newest") + F.expr(f"INTERVAL {keep}") > F.lit(as_of).cast("timestamp"))
            spans = spans.join(alive.select(*TRACE, "bucket"), [*TRACE, "bucket"], "left_semi")
        spans = spans.hint("rebalance", "bucket").sortWithinPartitions("bucket", *TRACE)
        fold = lambda rows, name: rows.write.mode("overwrite").parquet(self._folded(upto, name))
        jobs = [lambda: spans.write.mode("overwrite").partitionBy("bucket").parquet(self._folded(upto, "spans"))]
        jobs.append(partial(fold, newest, "touched"))
        for name, (_, merge) in BY_BATCH.items():
            jobs.append(partial(fold, merge(self._rows(spark, name, upto).drop("batch_id")).withColumn("batch_id", F.lit(upto).cast("bigint")), name))
        for name in BY_TRACE:
            jobs.append(partial(fold, self._valid(spark, name, upto).withColumn("batch_id", batch), name))
        together(jobs)
        spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).write.mode("append").json(f"{self.base}/manifest")
        return upto
