"""Topics to tables, with bad records set aside.

`TopicTable` appends a folder per micro-batch. `MonthlyTopic` writes a table's own
layout, drops records that are delivered again, and merges small files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tracefold import schemas
from tracefold.sources.records import split_records
from tracefold.sources.tables import with_month
from tracefold.streaming.batches import found, last_commit, read_batches, run_batches, write_batch

# How often a topic is polled in continuous running.
POLL = "5 seconds"
#: Records of a batch that one task parses.
RECORDS = 50_000


def dealt(batch: DataFrame) -> DataFrame:
    """A batch in even parts of RECORDS records at most.

    A source gives a batch in as many parts as it has files or partitions, one
    perhaps, while parsing is what takes the time. The parts are kept, as filters
    would else move below the exchange and parse in the source's parts.
    """
    parts = -(-batch.count() // RECORDS)
    return batch.repartition(parts).persist() if parts > 1 else batch


def with_rows(
    batch: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    tombstones: bool,
    use: Callable[[DataFrame, DataFrame], object],
    schema: StructType | None = None,
    flatten: bool = True,
) -> None:
    """Call `use` with a batch's rows and its bad records; `schema` sets aside records with unfit values."""
    parts = batch = batch.persist()
    try:
        parts = dealt(batch)
        good, bad = split_records(parts, tombstones, schema, flatten)
        use(load(good), bad)
    finally:
        parts.unpersist()
        batch.unpersist()


@dataclass(frozen=True)
class TopicTable:
    """A topic loaded into `<base>/rows`; bad records go to `<base>/bad`.

    `load` is one of the `ingest_*` functions. Bad records never stop the
    stream, and a batch that runs again replaces its own output. With `schema`, the
    columns of the topic, records with values of the wrong type are bad as well.
    """

    base: str
    load: Callable[[DataFrame], DataFrame]
    tombstones: bool = False
    schema: StructType | None = None
    flatten: bool = True

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        with_rows(batch, self.load, self.tombstones, lambda rows, bad: (
            write_batch(rows, f"{self.base}/rows", batch_id), write_batch(bad, f"{self.base}/bad", batch_id)
        ), self.schema, self.flatten)

    def start(self, records: DataFrame, every: str | None = None) -> StreamingQuery:
        return run_batches(records, self.checkpoint, self.write, every=every)

    def _read(self, spark: SparkSession, folder: str) -> DataFrame:
        return read_batches(spark, f"{self.base}/{folder}", -1, last_commit(spark, self.checkpoint)).drop("batch_id")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "rows")

    def bad(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "bad")


#: Two hashes of what tells records apart, stored with every row.
KEYS = ["_key", "_key2"]
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class MonthlyTopic:
    """A topic loaded into the layout of one of the known tables, every record once.

    Rows lie below `rows/yyyymm=<month>/batch_id=<n>`, sorted by the table's key. A
    record that is delivered again has the month of the first delivery, however late
    it comes, so a batch compares the hashes of its rows with those stored for its own
    months: two narrow columns are read, and only the batch's rows are shuffled. Since
    hashes are stored with the rows, they are never out of step. Records are the same
    if their `keys` are, or all columns if those are blank or there are none.

    A batch that runs again replaces its own partitions and compares itself with
    earlier batches only. `merge` folds a month's batches into few files; readers take
    folded files as soon as the manifest names them.
    """

    base: str
    table: str
    load: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ()
    schema: StructType | None = None
    flatten: bool = True

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    @property
    def _order(self) -> list[str]:
        return list(schemas.LAYOUT[self.table][0])

    def start(self, records: DataFrame, every: str | None = None) -> StreamingQuery:
        return run_batches(records, self.checkpoint, self.write, every=every)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        def store(rows: DataFrame, bad: DataFrame) -> None:
            write_batch(bad, f"{self.base}/bad", batch_id)
            rows = with_month(rows, schemas.LAYOUT[self.table][1])
            keyed = rows.select("*", *self._hashes(rows)).persist()  # parsed once
            try:
                new = self._new(keyed, batch_id).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
                new = new.hint("rebalance", "yyyymm", self._order[0]).sortWithinPartitions("yyyymm", *self._order)
                new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymm", "batch_id").parquet(
                    f"{self.base}/rows"
                )
            finally:
                keyed.unpersist()

        with_rows(batch, self.load, False, store, self.schema, self.flatten)

    def _hashes(self, rows: DataFrame) -> list[Column]:
        everything = [x for c in rows.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
        named = [F.col(c) for c in self.keys]
        blank = F.lit(True)
        for c in named:
            blank = blank & (F.coalesce(c.cast("string"), F.lit("")) == "")
        own = lambda *seed: F.when(blank, F.xxhash64(*seed, F.lit(1), *everything)).otherwise(F.xxhash64(*seed, *named))
        return [own(F.lit(3)).alias(KEYS[0]), own(F.lit(7)).alias(KEYS[1])]

    def _new(self, keyed: DataFrame, batch_id: int) -> DataFrame:
        """The rows that no earlier batch has brought, each once; `keyed` has their hashes."""
        once = keyed.dropDuplicates(KEYS)
        months = [r.yyyymm for r in keyed.select("yyyymm").distinct().collect()]  # of one batch
        stored = self._stored(keyed.sparkSession, months, batch_id - 1)
        if stored is None:
            return once
        known = stored.select(*KEYS).join(keyed.select(*KEYS).distinct(), KEYS, "left_semi").distinct()
        # Hinted, as known keys may be as many as the batch's rows; these lie by key already.
        return once.join(known.hint("merge"), KEYS, "left_anti")

    def _merged(self, spark: SparkSession) -> dict[int | None, int]:
        """The last batch folded, by month."""
        try:
            log = spark.read.schema("yyyymm int, upto bigint").json(f"{self.base}/manifest")
        except AnalysisException:
            return {}
        return {r.yyyymm: r.upto for r in log.groupBy("yyyymm").agg(F.max("upto").alias("upto")).collect()}

    def _stored(self, spark: SparkSession, months: list[int | None], upto: int) -> DataFrame | None:
        """Rows of some months up to a batch; no other month's folder is listed."""
        merged, parts = self._merged(spark), []
        for month in months:
            folder = f"yyyymm={NO_MONTH if month is None else month}"
            after = merged.get(month, -1)
            if after >= 0:
                parts.append(spark.read.parquet(f"{self.base}/merged/{folder}/upto={after}"))
            batches = found(spark, f"{self.base}/rows/{folder}/batch_id=*")
            batches = [path for path in batches if after < int(path.rsplit("=", 1)[1]) <= upto]
            if batches:
                parts.append(spark.read.parquet(*batches))
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def months(self, spark: SparkSession) -> list[int | None]:
        names = [path.rsplit("=", 1)[1] for path in found(spark, f"{self.base}/rows/yyyymm=*")]
        return sorted((None if n == NO_MONTH else int(n) for n in names), key=lambda m: (m is None, m or 0))

    def rows(self, spark: SparkSession, months: list[int | None] | None = None) -> DataFrame:
        """Committed rows, of some months or of all."""
        months = self.months(spark) if months is None else months
        rows = self._stored(spark, months, last_commit(spark, self.checkpoint))
        if rows is None:
            raise ValueError("no committed rows in these months")
        return rows.drop(*KEYS)

    def bad(self, spark: SparkSession) -> DataFrame:
        return read_batches(spark, f"{self.base}/bad", -1, last_commit(spark, self.checkpoint)).drop("batch_id")

    def merge(self, spark: SparkSession, month: int | None) -> int:
        """Fold a month's committed batches into files of even size; gives the last batch folded.

        Only this month is read and written. Folded batches are left for clean-up once
        no reader uses them.
        """
        upto = last_commit(spark, self.checkpoint)
        rows = self._stored(spark, [month], upto)
        if rows is None or upto <= self._merged(spark).get(month, -1):
            return upto
        folder = f"yyyymm={NO_MONTH if month is None else month}"
        rows.hint("rebalance", self._order[0]).sortWithinPartitions(*self._order).write.mode("overwrite").parquet(
            f"{self.base}/merged/{folder}/upto={upto}"
        )
        spark.range(1).select(F.lit(month).cast("int").alias("yyyymm"), F.lit(upto).cast("bigint").alias("upto")).write.mode(
            "append"
        ).json(f"{self.base}/manifest")
        return upto
