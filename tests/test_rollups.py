"""Merging partial rows equals aggregating once, however the rows are split."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.helpers import collected, same
from tracefold.operators import conversations, topics, usage
from tracefold.operators.rollup import merge_states, sum_counters
from tracefold.plans import derive
from tracefold.streaming.batches import found, last_commit
from tracefold.streaming.rollup import IncrementalRollups

ROLLUPS = (*usage.DAILY_ROLLUPS, *topics.TOPIC_ROLLUPS, conversations.CONVERSATIONS)


@pytest.fixture(scope="module")
def tp(spark, sf_dir):
    rows = derive.traces_processed(derive.read(spark, sf_dir, "events")).persist()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def apps(spark, sf_dir):
    return derive.apps(derive.read(spark, sf_dir, "nation"))


def _sides(rollup, apps):
    return (apps,) if rollup is conversations.CONVERSATIONS else ()


@pytest.mark.parametrize("rollup", ROLLUPS, ids=lambda r: r.name)
@pytest.mark.parametrize("seed", [1, 2])
def test_split_and_merge(tp, apps, rollup, seed):
    sides = _sides(rollup, apps)
    part = F.pmod(F.hash("TRACE_ID", F.lit(seed)), F.lit(3))
    pieces = [rollup.partial(tp.filter(part == i), *sides) for i in (2, 0, 1)]
    merged = rollup.merge(pieces[0].unionByName(pieces[1]).unionByName(pieces[2]))
    same(merged, rollup.partial(tp, *sides))


def test_merge_is_idempotent_on_merged_rows(tp):
    state = usage.USAGE_DAYS.partial(tp)
    same(usage.USAGE_DAYS.merge(state), state)


def test_merge_to_coarser_keys(tp):
    fine = topics.TOPIC_DAYS.partial(tp)
    same(topics.TOPIC_DAYS.merge(fine, topics.LABEL), topics.TOPIC_DAYS.partial(tp, keys=topics.LABEL))


def test_approximate_states_merge(tp):
    rollup = usage.APPROX_DAYS
    whole = usage.approx_usage(rollup.partial(tp))
    odd = F.hash("TRACE_ID") % 2 != 0
    halves = rollup.partial(tp.filter(odd)).unionByName(rollup.partial(tp.filter(~odd)))
    same(usage.approx_usage(rollup.merge(halves)), whole)


def test_average_is_not_a_mean_of_means(spark):
    state = spark.createDataFrame([("a", 1, 10), ("a", 9, 90)], "k string, n bigint, s bigint")
    merged = merge_states(state, ["k"], {"n": "sum", "s": "sum"}).first()
    assert merged.s / merged.n == 10.0


def test_sum_counters(spark):
    state = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 5, 6)], "k string, x bigint, y bigint")
    assert collected(sum_counters(state, ["k"], ["x", "y"])) == ["('a', 4, 6)", "('b', 5, 6)"]


def _stored(tmp_path, rollups, cache=False):
    return IncrementalRollups(str(tmp_path), rollups, cache=cache)


@pytest.mark.parametrize("cache", [False, True])
def test_stream_in_many_batches(spark, tp, tmp_path, cache):
    """Several micro-batches, a replayed batch and a fold give the direct result."""
    source = str(tmp_path / "source")
    tp.repartition(5).write.parquet(source)
    stored = _stored(tmp_path / "state", usage.DAILY_ROLLUPS, cache)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stored.start(stream).awaitTermination()
    assert last_commit(spark, stored.checkpoint) == 4

    for rollup in usage.DAILY_ROLLUPS:
        same(stored.state(spark, rollup), rollup.partial(tp))
    assert stored.compact(spark) == 4
    assert stored.compact(spark) == 4
    for rollup in usage.DAILY_ROLLUPS:
        same(stored.state(spark, rollup), rollup.partial(tp))

    # New rows after the fold, in the next run of the stream.
    tp.limit(50).write.mode("append").parquet(source)
    stored.start(stream).awaitTermination()
    doubled = usage.USAGE_DAYS.partial(spark.read.parquet(source))
    same(stored.state(spark, usage.USAGE_DAYS), doubled)


def _folders(spark, stored, rollup):
    """Months written per fold and level."""
    pattern = f"{stored.base}/folded/{rollup.name}/upto=*/level=*/yyyymm=*"
    return [tuple(int(part.split("=")[1]) for part in path.split("/")[-3:]) for path in found(spark, pattern)]


def test_folds_rewrite_only_their_months(spark, tp, tmp_path):
    """Batches of shifted months: a fold writes the months of its batch, full levels are merged."""
    source, days, first = str(tmp_path / "source"), usage.USER_DAYS, usage.FIRST_SEEN
    stored = IncrementalRollups(str(tmp_path / "state"), (days, first), fanout=2)
    shifted = lambda months: tp.withColumn("EVENT_DATE", F.add_months("EVENT_DATE", months).cast("date"))
    undated = tp.limit(200).withColumn("EVENT_DATE", F.lit(None).cast("date"))
    january = tp.agg(F.min("EVENT_DATE")).first()[0]
    month = january.year * 100 + january.month
    batches = [shifted(2), shifted(1), shifted(2).limit(300), undated, tp, shifted(2).limit(50)]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        stored.start(spark.readStream.schema(tp.schema).parquet(source)).awaitTermination()
        stored.compact(spark)
    whole = spark.read.parquet(source)
    for rollup in (days, first):
        same(stored.state(spark, rollup), rollup.partial(whole))

    # One folder a fold, and the two runs of the third month merged once; the third one waits.
    assert _folders(spark, stored, days) == [
        (0, 0, month + 2), (1, 0, month + 1), (2, 0, month + 2), (2, 1, month + 2), (3, 0, 0), (4, 0, month), (5, 0, month + 2),
    ]
    upto, runs = stored.runs(spark)
    assert upto == 5
    assert [run[1:] for run in runs if run.name == days.name] == [
        (0, 0, 3), (month, 0, 4), (month + 1, 0, 1), (month + 2, 0, 5), (month + 2, 1, 2),
    ]
    # Rows without a date key merge as a binary counter: six folds leave two runs.
    assert [run[1:] for run in runs if run.name == first.name] == [(0, 1, 5), (0, 2, 3)]

    # A range of days lists the folders of its own month only.
    start, end = f"{january.year}-{january.month + 1:02d}-05", f"{january.year}-{january.month + 1:02d}-20"
    part = stored.partials(spark, days, first=start, last=end)
    same(days.merge(part), days.partial(whole.filter(F.col("EVENT_DATE").between(start, end))))
    assert all(f"yyyymm={month + 1}" in path for path in part.inputFiles() if "/folded/" in path)
    assert stored.state(spark, days, first="1990-01-01", last="1990-01-31").count() == 0
    with pytest.raises(ValueError):
        stored.partials(spark, first, first=start)


def test_half_written_fold_is_not_read(spark, tp, tmp_path):
    source = str(tmp_path / "source")
    tp.repartition(2).write.parquet(source)
    stored = _stored(tmp_path / "state", (usage.USAGE_DAYS,))
    stored.start(spark.readStream.schema(tp.schema).parquet(source)).awaitTermination()
    # Runs without a manifest, and a manifest whose write did not end.
    stored._fold_one(spark, usage.USAGE_DAYS, [], -1, 0)
    spark.range(1).selectExpr("'usage_days' as name", "202401 as month", "0 as level", "0 as upto").write.json(
        f"{stored.base}/manifest/upto=0"
    )
    (tmp_path / "state" / "manifest" / "upto=0" / "_SUCCESS").unlink()
    same(stored.state(spark, usage.USAGE_DAYS), usage.USAGE_DAYS.partial(tp))
    stored.compact(spark)
    same(stored.state(spark, usage.USAGE_DAYS), usage.USAGE_DAYS.partial(tp))


def test_first_day_moves_back(spark):
    """A late row makes an earlier day the first one, also when only later days are asked for."""
    state = lambda rows: spark.createDataFrame(rows, "APP_ID string, EVENT_DATE date, USER_ID string, n bigint")
    day = lambda number: date(2024, 1, number)
    user_days = state([("a", day(5), "u", 1), ("a", day(5), "v", 1), ("a", day(6), "u", 1)])
    sessions = user_days.withColumnRenamed("USER_ID", "SESSION_ID")
    seen = spark.createDataFrame(
        [("a", "u", day(5)), ("a", "v", day(5)), ("a", "u", day(2))], "APP_ID string, USER_ID string, first_day date"
    )
    got = usage.finish_users(user_days, sessions, first_seen=usage.FIRST_SEEN.merge(seen))
    assert collected(got, ["EVENT_DATE", "users_count", "new_users_count"]) == [
        f"({day(5)!r}, 2, 1)", f"({day(6)!r}, 1, 0)",
    ]


def test_replayed_batch_replaces_itself(spark, tp, tmp_path):
    stored = _stored(tmp_path, (usage.USAGE_DAYS,))
    halves = [tp.filter("pmod(hash(TRACE_ID), 2) = 0"), tp.filter("pmod(hash(TRACE_ID), 2) = 1")]
    stored.write(halves[0], 0)
    stored.write(halves[1], 1)
    stored.write(halves[1], 1)
    same(usage.USAGE_DAYS.merge(stored.partials(spark, usage.USAGE_DAYS, upto=1)), usage.USAGE_DAYS.partial(tp))


def test_uncommitted_batch_is_not_read(spark, tp, tmp_path):
    stored = _stored(tmp_path, (usage.USAGE_DAYS,))
    stored.write(tp, 0)
    stored.write(tp, 1)
    same(stored.partials(spark, usage.USAGE_DAYS, upto=0), usage.USAGE_DAYS.partial(tp))
    with pytest.raises(ValueError):
        stored.partials(spark, usage.USAGE_DAYS)


def test_a_batch_without_rows(spark, tp, tmp_path):
    source = str(tmp_path / "source")
    tp.filter("TASK = 'system'").write.parquet(source)
    stored = _stored(tmp_path / "state", (usage.USAGE_DAYS, usage.USER_DAYS))
    stored.start(spark.readStream.schema(tp.schema).parquet(source)).awaitTermination()
    assert stored.state(spark, usage.USER_DAYS).count() == 0
    stored.compact(spark)
    assert stored.state(spark, usage.USAGE_DAYS).count() == 0
