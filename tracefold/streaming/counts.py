"""Daily message counts kept up to date by a stream.

The counters are a roll-up: a late row adds to its day however late it is, so
there is no watermark and no state in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracefold.operators.rollup import Rollup
from tracefold.operators.usage import DAY, messages
from tracefold.streaming.rollup import IncrementalRollups


def daily_counts(base: str, keys: Sequence[str]) -> IncrementalRollups:
    """Stored counters of messages per app, day and `keys`; `compact()` folds them."""
    return IncrementalRollups(base, (Rollup("daily_counts", (*DAY, *keys), {"count": ("count", "1")}, messages),))


def start_daily_counts(stream: DataFrame, base: str, keys: Sequence[str], every: str | None = None) -> StreamingQuery:
    """Add the counts of every micro-batch."""
    return daily_counts(base, keys).start(stream, every)


def read_daily_counts(spark: SparkSession, base: str, keys: Sequence[str]) -> DataFrame:
    """One row per counter over all committed batches."""
    stored = daily_counts(base, keys)
    return stored.state(spark, stored.rollups[0])
