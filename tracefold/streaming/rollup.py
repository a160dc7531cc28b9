"""Roll-ups kept up to date by a stream.

Each micro-batch adds partial rows per roll-up; reading merges them. Merging is
commutative, so late rows simply add to their day and no watermark is needed.

`compact` folds new batches into runs, one per month they touch. Months without
new rows are not rewritten. A month with `fanout` runs of a level gets one run of
the next level instead of them, so a row is rewritten once per level: about
log(folds) / log(fanout) times, however old its month grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.functions.timeparts import month_of
from tracefold.operators.rollup import Kept, Rollup
from tracefold.streaming.batches import found, last_commit, read_batches, run_batches, together, write_batch

DATE = "EVENT_DATE"

# The month of rows without a date, and of roll-ups that are not kept by date.
NO_MONTH = 0


class Run(NamedTuple):
    """Folded partial rows of one roll-up and month, written by the fold up to batch `upto`."""

    name: str
    month: int
    level: int
    upto: int


_RUN = "name string, month int, level int, upto bigint"


@dataclass(frozen=True)
class IncrementalRollups:
    """Stored partial rows of several roll-ups, and kept rows, over one source stream.

    `sides` gives, by roll-up name, the dimension frames its rows need.
    `fanout` is the number of runs of a month and level that are merged.
    `cache` keeps a micro-batch in memory for all roll-ups: for sources that
    are dear to read, such as topics of JSON. Columnar files are better read by
    each roll-up, which takes only its own columns.
    """

    base: str
    rollups: Sequence[Rollup | Kept]
    sides: dict[str, tuple[DataFrame, ...]] = field(default_factory=dict)
    cache: bool = False
    fanout: int = 8

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    def _folder(self, name: str) -> str:
        return f"{self.base}/state/{name}"

    def _folded(self, name: str) -> str:
        return f"{self.base}/folded/{name}"

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Add one batch; the same batch again replaces itself."""
        if self.cache:
            rows = rows.persist()
        try:
            together(partial(self._write_one, rollup, rows, batch_id) for rollup in self.rollups)
        finally:
            if self.cache:
                rows.unpersist()

    def _write_one(self, rollup: Rollup | Kept, rows: DataFrame, batch_id: int) -> None:
        partials = rollup.partial(rows, *self.sides.get(rollup.name, ()))
        write_batch(partials, self._folder(rollup.name), batch_id)

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        return run_batches(stream, self.checkpoint, self.write, every=every)

    def runs(self, spark: SparkSession) -> tuple[int, list[Run]]:
        """The last batch folded, -1 before the first fold, and the runs that hold the folded rows.

        A manifest counts once its write is complete. It has at most
        `fanout` rows per roll-up, month and level.
        """
        complete = found(spark, f"{self.base}/manifest/upto=*/_SUCCESS")
        if not complete:
            return -1, []
        upto = max(int(path.split("/")[-2].split("=")[1]) for path in complete)
        listed = spark.read.schema(_RUN).json(f"{self.base}/manifest/upto={upto}").collect()
        return upto, sorted(Run(*row) for row in listed)

    def partials(
        self,
        spark: SparkSession,
        rollup: Rollup | Kept,
        upto: int | None = None,
        first: str | None = None,
        last: str | None = None,
    ) -> DataFrame:
        """Committed partial rows, of the days from `first` to `last` (ISO dates) if given.

        A date range lists only the folders of its own months, and of batches
        not folded yet.
        """
        if (first or last) and DATE not in rollup.keys:
            raise ValueError(f"{rollup.name} is not kept by {DATE}")
        upto = last_commit(spark, self.checkpoint) if upto is None else upto
        folded, runs = self.runs(spark)
        live = [run for run in runs if run.name == rollup.name and _within(run.month, first, last)]
        if max(upto, folded) < 0:
            raise ValueError(f"no committed batch of {rollup.name} yet")
        parts = []
        if live:
            parts.append(self._read_runs(spark, rollup, live))
        if upto > folded or not live:  # without new batches this adds no rows, only columns
            parts.append(self._read_new(spark, rollup, folded, upto))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if first:
            rows = rows.filter(F.col(DATE) >= F.lit(first).cast("date"))
        return rows.filter(F.col(DATE) <= F.lit(last).cast("date")) if last else rows

    def state(self, spark: SparkSession, rollup: Rollup | Kept, first: str | None = None, last: str | None = None) -> DataFrame:
        """One merged row per key, of all days or of a range of days."""
        return rollup.merge(self.partials(spark, rollup, first=first, last=last))

    def compact(self, spark: SparkSession) -> int:
        """Fold the batches committed since the last fold; gives the last one folded.

        Runs are complete before a manifest names them: readers see either the
        old or the new fold. Runs that were merged leave the manifest, so no
        reader lists them again; their files stay for readers that still use them.
        """
        upto = last_commit(spark, self.checkpoint)
        folded, runs = self.runs(spark)
        if upto <= folded:
            return upto
        kept = together(
            partial(self._fold_one, spark, rollup, [run for run in runs if run.name == rollup.name], folded, upto)
            for rollup in self.rollups
        )
        manifest = spark.createDataFrame([run for part in kept for run in part], _RUN)
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.base}/manifest/upto={upto}")
        return upto

    def _fold_one(self, spark: SparkSession, rollup: Rollup | Kept, live: list[Run], folded: int, upto: int) -> list[Run]:
        """Write the runs of new batches, merge where a level is full, and give the runs to keep."""
        live = live + self._write_runs(spark, rollup, self._read_new(spark, rollup, folded, upto), 0, upto)
        level = 0
        while level <= max((run.level for run in live), default=-1):
            here = [run for run in live if run.level == level]
            full = [run for run in here if sum(other.month == run.month for other in here) >= self.fanout]
            if full:
                merged = self._write_runs(spark, rollup, self._read_runs(spark, rollup, full), level + 1, upto)
                live = [run for run in live if run not in full] + merged
            level += 1
        return live

    def _write_runs(self, spark: SparkSession, rollup: Rollup | Kept, rows: DataFrame, level: int, upto: int) -> list[Run]:
        """Merged rows by month, files of even size sorted by date and key."""
        path = f"{self._folded(rollup.name)}/upto={upto}/level={level}"
        order = sorted(rollup.keys, key=lambda key: key != DATE)
        by_month = rollup.merge(rows).withColumn("yyyymm", _month(rollup)).hint("rebalance", "yyyymm", order[0])
        by_month.sortWithinPartitions("yyyymm", *order).write.mode("overwrite").partitionBy("yyyymm").parquet(path)
        months = [int(folder.rsplit("=", 1)[1]) for folder in found(spark, f"{path}/yyyymm=*")]
        return [Run(rollup.name, month, level, upto) for month in months]

    def _read_runs(self, spark: SparkSession, rollup: Rollup | Kept, runs: list[Run]) -> DataFrame:
        base = self._folded(rollup.name)
        paths = [f"{base}/upto={run.upto}/level={run.level}/yyyymm={run.month}" for run in runs]
        return spark.read.option("basePath", base).parquet(*paths).select(*rollup.keys, *rollup.measures)

    def _read_new(self, spark: SparkSession, rollup: Rollup | Kept, folded: int, upto: int) -> DataFrame:
        return read_batches(spark, self._folder(rollup.name), folded, upto).select(*rollup.keys, *rollup.measures)


def _month(rollup: Rollup | Kept) -> Column:
    return F.coalesce(month_of(DATE), F.lit(NO_MONTH)) if DATE in rollup.keys else F.lit(NO_MONTH)


def _within(month: int, first: str | None, last: str | None) -> bool:
    number = lambda date: int(date[:4] + date[5:7])
    return (not first or month >= number(first)) and (not last or NO_MONTH < month <= number(last))
