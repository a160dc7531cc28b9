"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its target is its
share of the mix, limited by the number of times its documents may repeat. The
documents of a source stand in hashed order, copy after copy, and take words
until the target; the inverse of the source's integrated schedule turns the
words taken so far into a training position, and documents are sorted by it.

Null text has size 0, null source is a source of its own. A copy is taken when it
ends within the target. What is then open is filled from the copies left over, in
FILLS rounds: the largest that fit, as many as fit, so each round leaves less than the
size at which it stopped. Such copies stand at hashed shares of their source's words.
No source takes more than its target. Rows that repeat a doc_id or have none are separate rows, each
with positions of its own; `training_order` finds them by hashes of the whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, WORD, keyed, row_keys, saved, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Knots (time, relative weight) of the schedules of the sources, repeating like the weights.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
BUCKET_ROWS = 4096
#: Rounds that fill what is open below a target.
FILLS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(src, source_size, rows, rank, target) from (src, size).

    Filling all sources to one level of words per weight is what resharing the
    excess comes to: sources below the level are full. Works on a row per source.
    """
    ordered = Window.orderBy("src")
    by_ratio = Window.orderBy("ratio", "src")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    sources = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = (
        sources.withColumn("rank", F.row_number().over(ordered) - 1)
        .withColumn("weight", pick.cast("double"))
        .withColumn("most", (F.col("source_size") * repeats).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(all_rows) * share)
        .withColumn("full", F.sum("most").over(by_ratio) - F.col("most"))
        .withColumn("open", F.sum("weight").over(all_rows) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open"))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio")))
    return sources.withColumn("at", level.over(all_rows)).select(
        "src", "source_size", "rows", "rank",
        F.coalesce(F.least(F.col("most"), F.col("weight") * F.col("at")), F.col("most")).alias("target"),
    )


def position(done: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training time at which the share `done` (0..1) of a source's words is used up.

    A schedule is linear between its knots, so its integral is quadratic there
    and is inverted in closed form.
    """
    out = None
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, before, inverse = sum(areas), 0.0, None
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            slope = (w1 - w0) / (t1 - t0)
            y = F.greatest(done * whole - before, F.lit(0.0))
            t = t0 + 2 * y / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * y, F.lit(0.0))))
            before += area
            here = done * whole <= before
            inverse = F.when(here, t) if inverse is None else inverse.when(here, t)
        inverse = F.least(inverse.otherwise(F.lit(knots[-1][0])), F.lit(float(knots[-1][0])))
        chosen = rank % len(schedules) == k
        out = F.when(chosen, inverse) if out is None else out.when(chosen, inverse)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions, *ROW), a row per row of `docs`.

    Running sums are taken in two steps, buckets of a source first and rows of a
    bucket then; the number of buckets follows the rows of the source.
    """
    sized = docs.select(
        "doc_id",
        "source",
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        *row_keys(docs),
    )
    sized = saved(sized, "sizes")  # so all texts are scanned once
    goal = saved(targets(sized, weights, share, repeats), "targets")
    width = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / BUCKET_ROWS))).cast("int")
    rows = sized.join(goal, "src").withColumn("bucket", F.substring("h", F.lit(1), width))
    buckets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.withColumn(
        "before", F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")
    ).drop("words")
    inner = Window.partitionBy("src", "bucket").orderBy("h", "size", *ROW).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(buckets, ["src", "bucket"]).withColumn(
        "start", F.col("before") + F.sum("size").over(inner) - F.col("size")
    )
    spots = []
    for copy in range(int(repeats)):
        begin = F.col("start") + copy * F.col("source_size")
        done = F.when(F.col("target") > 0, (begin + F.col("size") / 2) / F.col("target")).otherwise(F.lit(0.0))
        spots.append(F.when(begin + F.col("size") <= F.col("target"), position(done, F.col("rank"), schedules)))
    rows = rows.withColumn("first", F.filter(F.array(*spots), lambda p: p.isNotNull()))
    rows = saved(rows.select("doc_id", "source", "src", "size", "source_size", "target", "rank", "h", "start", "first", *ROW), "placed")
    more = fill(rows, int(repeats), schedules)
    rows = rows.join(more, ["src", "start", "size"], "left")
    positions = F.concat("first", F.coalesce("more", F.array().cast("array<double>")))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.size(positions) * F.col("size")).cast("long").alias("taken"), positions.alias("positions"), *ROW,
    )


def fill(rows: DataFrame, repeats: int, schedules=SCHEDULES) -> DataFrame:
    """(src, start, size, more): positions of the copies that fill what is open below the targets.

    How many copies of each size a source takes is found on a row per source and size.
    Rows with words have a `start` of their own within their source.
    """
    taken = F.size("first") * F.col("size")
    gaps = rows.groupBy("src").agg((F.floor(F.first("target")) - F.sum(taken)).alias("gap"))
    left = rows.where((F.col("size") > 0) & (F.size("first") < repeats))
    # Sizes are counted before the gaps are joined, so no source's rows meet in one task.
    levels = left.groupBy("src", "size").agg(F.sum(repeats - F.size("first")).alias("n")).join(gaps, "src").where("size <= gap")
    levels = levels.withColumn("take", F.lit(0).cast("long"))
    larger = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(FILLS):
        free = F.when(F.col("size") <= F.col("gap"), F.col("n") - F.col("take")).otherwise(F.lit(0))
        levels = levels.withColumn("free", free)
        room = F.col("gap") - F.coalesce(F.sum(F.col("free") * F.col("size")).over(larger), F.lit(0))
        now = F.greatest(F.lit(0), F.least("free", F.floor(room / F.col("size"))))
        levels = levels.withColumn("now", now).withColumn("take", F.col("take") + F.col("now")).withColumn(
            "gap", F.col("gap") - F.sum(F.col("now") * F.col("size")).over(Window.partitionBy("src"))
        )
    levels = saved(levels.where("take > 0").select("src", "size", "n", "take"), "levels")
    # Ranks of a size in two steps, as sizes may be shared by most rows.
    width = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / BUCKET_ROWS))).cast("int")
    left = left.join(levels, ["src", "size"]).select(
        "src", "start", "size", "rank", "h", "take", F.substring("h", F.lit(1), width).alias("bucket"),
        F.explode(F.sequence(F.size("first"), F.lit(repeats - 1))).alias("copy"),
    )
    group = ["src", "size"]
    buckets = left.groupBy(*group, "copy", "bucket").agg(F.count("*").alias("here"))
    buckets = buckets.withColumn(
        "before", F.sum("here").over(Window.partitionBy(*group).orderBy("copy", "bucket")) - F.col("here")
    ).drop("here")
    left = left.join(buckets, [*group, "copy", "bucket"])
    inner = Window.partitionBy(*group, "copy", "bucket").orderBy("h", "start")
    left = left.where(F.col("before") < F.col("take")).withColumn("nth", F.col("before") + F.row_number().over(inner))
    share = F.conv(F.substring("h", F.col("copy") % 4 * 8 + 1, F.lit(8)), 16, 10).cast("double") / 2.0**32
    chosen = left.where("nth <= take").select("src", "start", "size", position(share, F.col("rank"), schedules).alias("p"))
    return chosen.groupBy("src", "start", "size").agg(F.array_sort(F.collect_list("p")).alias("more"))


def training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as the mix uses them: a row per copy, range-sorted by position, the columns of `docs`."""
    # Equal rows are interchangeable: one of them stands at the positions of all.
    unique = keyed(docs).dropDuplicates(ROW)
    spots = mixed.select(*ROW, F.explode("positions").alias("_at"))
    return unique.join(spots, ROW).orderBy("_at", "row.doc_id", *ROW).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.array_min("positions").alias("position_1"),
        F.when(F.size("positions") > 1, F.array_max("positions")).alias("position_2"),
    )


OP3_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    case when source is null then '1' else '0' end || coalesce(source, '') as src,
    md5(coalesce(cast(doc_id as varchar), '')) as h
  from documents
), sources as (
  select src, cast(sum(size) as bigint) as source_size, row_number() over (order by src) - 1 as rank
  from sized group by src
), weighed as (
  select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
    (source_size * 2)::double as most
  from sources
), levels as (
  select *, most / weight as ratio,
    (sum(source_size) over () * 1.5::double - (sum(most) over by_ratio - most))
      / (sum(weight) over () - sum(weight) over by_ratio + weight) as level
  from weighed window by_ratio as (order by most / weight, src)
), targets as (
  select src, source_size, rank,
    coalesce(least(most, weight * (min_by(level, ratio) filter (where level <= ratio) over ())), most) as target
  from levels
), placed as (
  select s.src, s.h, s.doc_id, s.size, t.source_size, t.target, t.rank,
    sum(s.size) over (partition by s.src order by s.h, s.size rows unbounded preceding) - s.size as start
  from sized s join targets t using (src)
), copies as (
  select *, k, start + k * source_size + size / 2::double as middle, start + k * source_size + size <= target as first
  from placed, (values (0), (1)) as copy(k)
), gaps as (
  select src, floor(any_value(target))::bigint - sum(case when first then size else 0 end)::bigint as gap from copies group by src
), levels_0 as (
  select src, size, count(*) as n, 0::bigint as take, any_value(gap) as gap
  from copies join gaps using (src) where not first and size > 0 and size <= gap group by src, size
), freed_1 as (
  select *, case when size <= gap then n - take else 0 end as free from levels_0
), taken_1 as (
  select *, greatest(0, least(free, (gap - coalesce(sum(free * size) over (
    partition by src order by size desc rows between unbounded preceding and 1 preceding), 0)) // size)) as now
  from freed_1
), levels_1 as (
  select src, size, n, take + now as take, gap - sum(now * size) over (partition by src) as gap from taken_1
), freed_2 as (
  select *, case when size <= gap then n - take else 0 end as free from levels_1
), taken_2 as (
  select *, greatest(0, least(free, (gap - coalesce(sum(free * size) over (
    partition by src order by size desc rows between unbounded preceding and 1 preceding), 0)) // size)) as now
  from freed_2
), levels_2 as (
  select src, size, n, take + now as take, gap - sum(now * size) over (partition by src) as gap from taken_2
), freed_3 as (
  select *, case when size <= gap then n - take else 0 end as free from levels_2
), taken_3 as (
  select *, greatest(0, least(free, (gap - coalesce(sum(free * size) over (
    partition by src order by size desc rows between unbounded preceding and 1 preceding), 0)) // size)) as now
  from freed_3
), levels_3 as (
  select src, size, n, take + now as take, gap - sum(now * size) over (partition by src) as gap from taken_3
), ranked as (
  select c.*, row_number() over (partition by src, size, first order by k, h) <= l.take and not first as filled
  from copies c left join levels_3 l using (src, size)
), positions as (
  select *, first or coalesce(filled, false) as used,
    case when not first then ('0x' || substr(h, k * 8 + 1, 8))::bigint / 4294967296::double
      when target > 0 then middle / target else 0 end as y
  from ranked
), timed as (
  select *, least(case rank % 3
    when 0 then 0 + 2 * greatest(y * 1.0::double - 0, 0) / (1 + sqrt(greatest(1.0::double + 0, 0)))
    when 1 then 0 + 2 * greatest(y * 1.0::double - 0, 0) / (0.5::double + sqrt(greatest(0.25::double + 2 * greatest(y, 0), 0)))
    else case when y <= 0.625::double
      then 2 * greatest(y, 0) / (1.5::double + sqrt(greatest(2.25::double - 2 * greatest(y, 0), 0)))
      else 0.5::double + 2 * greatest(y - 0.625::double, 0)
        / (1.0::double + sqrt(greatest(1.0::double - 2 * greatest(y - 0.625::double, 0), 0))) end
    end, 1.0::double) as position
  from positions
)
select doc_id, cast(max(size) as bigint) as size, max(source_size) as source_size, max(target) as target,
  cast(sum(case when used then size else 0 end) as bigint) as taken,
  min(case when used then position end) as position_1,
  case when count(case when used then 1 end) > 1 then max(case when used then position end) end as position_2
from timed group by doc_id
"""
