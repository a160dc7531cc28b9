"""Reading tables, writing intermediate tables to the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words in every operator that counts or hashes words.
WORD = r"[^\x20\x09-\x0D]+"
# Rows of an id and a few numbers that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it again.

    Cuts the lineage: a lost executor costs the tasks it ran, never the steps
    before. `discard` removes the files of tables that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*frames: DataFrame) -> None:
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


#: Names of the columns of `row_keys`.
ROW = ["_row", "_row2"]


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a row's columns as ROW. Only equal rows share both."""
    values = [x for c in columns(docs) for x in (c, c.isNull())]
    return [F.xxhash64(*values).alias(ROW[0]), F.xxhash64(F.lit(7), *values).alias(ROW[1])]


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]


def keyed(docs: DataFrame) -> DataFrame:
    """(row, _row, _row2): whole rows as structs, so that their columns may have any name, and their keys."""
    return docs.select(F.struct(*columns(docs)).alias("row"), *row_keys(docs))


def join_by_id(docs: DataFrame, found: DataFrame, how: str = "inner", key: str = "doc_id") -> DataFrame:
    """`docs` with the other columns of `found`, joined by `key`, NULL equal to NULL.

    `found` (narrow, a row per key) is written first. It is broadcast only if it
    has at most BROADCAST_ROWS rows; beyond that both sides are shuffled.
    """
    right = saved(found.withColumnRenamed(key, "_key"), "found")
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(right) if small else right, same(docs[key], right["_key"]), how).drop("_key")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a long, b long).

    `component` is the smallest node reachable. Alternating large-star and
    small-star steps: every step is one aggregate of minima and one join, the
    number of links never grows, and each round is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    current = saved(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    state = _digest(current)
    while state[0]:
        linked = current.select("a", "b").union(current.select(b, a)).toDF("a", "b")
        smallest = linked.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = linked.where(b > a).join(smallest, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a != b).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        small = small.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(
            smallest.select("a", F.col("m").alias("b"))
        )
        following = saved(small.distinct(), "links")
        discard(current)
        current, before = following, state
        state = _digest(current)
        if state == before:
            break
    roots = current.select(b.alias("node"), b.alias("component")).distinct()
    return current.select(a.alias("node"), b.alias("component")).union(roots)


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return row[0], row[1]
