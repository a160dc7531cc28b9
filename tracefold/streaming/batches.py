"""Folders of micro-batch output that survive replays.

Every micro-batch writes below `batch_id=<n>` in overwrite mode, so a batch
that runs again after a failure replaces its own rows and nothing is counted
twice. Readers take the batches the stream has committed, by the stream's own
checkpoint; a batch that is half written is not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

T = TypeVar("T")


def last_commit(spark: SparkSession, checkpoint: str) -> int:
    """Newest committed batch of a stream, -1 before the first.

    The commit log holds one small file per recent batch, named by its id.
    """
    try:
        log = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{checkpoint}/commits")
    except AnalysisException:
        return -1
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint")
    newest = log.select(F.max(number).alias("n")).first().n
    return -1 if newest is None else newest


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any file system Spark knows."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(m.getPath().toString() for m in matches or [])


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def together(jobs: Iterable[Callable[[], T]]) -> list[T]:
    """Run independent Spark jobs at the same time; the first error is raised.

    One job after the other would leave the cluster idle at the end of each.
    """
    with ThreadPoolExecutor(max_workers=8) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]


def read_batches(spark: SparkSession, folder: str, after: int, upto: int, schema: StructType | None = None) -> DataFrame:
    """Rows of the batches in (after, upto]; files of other batches are not listed."""
    reader = spark.read.option("basePath", folder)
    inside = [path for path in found(spark, f"{folder}/batch_id=*") if after < int(path.rsplit("=", 1)[1]) <= upto]
    rows = (reader.schema(schema) if schema else reader).parquet(*(inside or [f"{folder}/batch_id=*"]))
    return rows.filter((F.col("batch_id") > after) & (F.col("batch_id") <= upto))


def run_batches(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    output_mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start the stream: all that is there by default, or `every` interval."""
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
