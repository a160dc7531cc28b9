"""Hard-negative mining: a vertical scan of columnar dimensions with shrinking candidate sets.

Vectors are whole numbers, floor(256 * x), and a row's score is its inner product with
an anchor. The rows are dealt into tiles, each held column by column. For an anchor,
the columns of a tile are read in descending magnitude of the anchor's components. The
smallest and the largest value of every column bound what the columns not read yet can
still add, and a row leaves the candidates as soon as these bounds show that it lies
outside every wanted window of scores or below enough rows that are surely inside. The
bounds close as columns are read, so what is left at the end has its exact score.

Two scans: the first finds an anchor's positives (the best rows of its label, a window
without ends), the second the negatives of all its positives at once, one window each.
Anchors are the query set: blocks of them meet tiles of rows, first only the tiles that
their label can be in, then all.

Rows with a NULL label, a NULL vector or a component that is NULL or not finite, also
once multiplied by 256, take no part; nor do rows of another length than the anchor's.
A zero or empty vector scores 0. Rows that repeat a vec_id are rows of their own, also
as anchors; rows without a vec_id are never anchors and stand behind the others in
ties. Scores are exact; one beyond 64 bits counts as the nearest long. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

ANCHORS = 50  # ids divisible by it
POSITIVES = 5
NEGATIVES = 3
LOWEST, HIGHEST = 50, 95  # per cent of the positive's score
TILE = 4096  # rows
CHUNK = 512  # anchors that meet a tile in one task
STEP = 8  # columns read between two looks at the bounds


def kind_for(dims: int, largest: float) -> type:
    """A type in which sums of `dims` products of whole numbers up to `largest` are exact."""
    most = dims * largest * largest
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def scan(
    anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray,
    windows: Sequence[tuple], k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores): of `rows`, those that may be among the `k` best within a window (first, last score).

    `columns` has a line per dimension, of which `low` and `high` are the ends. Rows
    with the score of a window's last place all stay, so that ties can be settled.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = weights * low[order], weights * high[order]
    smaller, larger = np.minimum(*ends), np.maximum(*ends)
    # what columns from the i-th on add at least and at most
    rest = [np.append(np.cumsum(x[::-1])[::-1], x.dtype.type(0) if x.dtype != object else 0) for x in (smaller, larger)]
    score = np.zeros(len(rows), columns.dtype)
    whole = len(rows) == columns.shape[1]
    for at in range(0, max(len(order), 1), STEP):
        dims = order[at : at + STEP]
        if len(dims):
            score = score + weights[at : at + STEP] @ (columns[dims] if whole else columns[np.ix_(dims, rows)])
        least, most = (_clipped(score + r[min(at + STEP, len(order))]) for r in rest)
        alive = np.zeros(len(rows), bool)
        for first, last in windows:
            able = (most >= first) & (least <= last)
            sure = least[(least >= first) & (most <= last)]
            if len(sure) >= k:
                able &= most >= np.sort(sure)[-k]
            alive |= able
        if not alive.all():
            rows, score, whole = rows[alive], score[alive], False
        if not len(rows):
            break
    return rows, _clipped(score)


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Scores as far as a long goes; only Python's numbers can be beyond it."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object else scores


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, first, last, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` best scores between `first` and `last` and their rows; ties by id."""
    inside = (scores >= first) & (scores <= last)
    rows, scores = rows[inside], scores[inside]
    order = np.lexsort((rows, ids[rows], -scores))[:k]
    return rows[order], scores[order]


def window_of(score: int) -> tuple[int, int]:
    """Scores n with LOWEST * score <= 100 * n <= HIGHEST * score."""
    return -(-LOWEST * score // 100), HIGHEST * score // 100


class _Tile:
    """The rows of one length of a tile, column by column."""

    def __init__(self, rows: pa.Table):
        self.dims = np.asarray(rows["q"].combine_chunks().value_lengths())
        self.q = rows["q"].combine_chunks()
        self.key = rows["key"].to_numpy()
        last = np.iinfo(np.int64).max
        self.id = rows["vec_id"].fill_null(last).to_numpy()
        self.no_id = rows["vec_id"].is_null().to_numpy().astype(bool)
        self.label = rows["label"].to_numpy()

    def of_length(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.dims == n)
        values = self.q.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        return at, values.reshape(len(at), n)


def _exact(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return values.astype(kind)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _scan_pair(rows: pa.Table, anchors: pa.Table, negatives: bool, largest: float) -> pa.Table:
    """A tile against a chunk of anchors: the best rows of every window."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        tile, chunk = _Tile(rows), _Tile(anchors)
        wanted = anchors["positives"].to_pylist() if negatives else None
        for n in np.unique(chunk.dims):
            at, values = tile.of_length(n)
            if not len(at):
                continue
            kind = kind_for(max(int(n), 1), largest)
            columns = np.ascontiguousarray(_exact(values, kind).T)
            low, high = columns.min(axis=1), columns.max(axis=1)
            key, ids, label = tile.key[at], tile.id[at], tile.label[at]
            mine, vectors = chunk.of_length(n)
            vectors = _exact(vectors, kind)
            for i, vector in zip(mine, vectors):
                if negatives:
                    windows = [window_of(int(p["score"])) for p in wanted[i]]
                    candidates, k = np.flatnonzero(label != chunk.label[i]), NEGATIVES
                else:
                    windows, k = [(float("-inf"), float("inf"))], POSITIVES
                    candidates = np.flatnonzero((label == chunk.label[i]) & (key != chunk.key[i]))
                found, scores = scan(vector, columns, low, high, candidates, windows, k)
                for place, (first, last) in enumerate(windows):
                    for row, score in zip(*best(found, scores, ids, first, last, k)):
                        no_id = tile.no_id[at[row]]
                        out.append((int(chunk.key[i]), place, int(key[row]), None if no_id else int(ids[row]), int(score)))
    columns = list(zip(*out)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, _FOUND)], names=["anchor", "place", "row", "vec_id", "score"])


_FOUND = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _first(found: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(rows: DataFrame, anchors: DataFrame, negatives: bool, largest: float) -> DataFrame:
    """Every tile with every chunk of anchors dealt to it."""
    keys = ["bucket", "part", "chunk"]
    columns = ["key", "vec_id", "label", "q"]
    held = rows.select(*keys, *columns).groupBy(*keys)
    # aliases, for both sides come from one table
    asked = anchors.select(
        *(F.col(c).alias(f"to_{c}") for c in keys), *(F.col(c).alias(c) for c in columns), *(["positives"] if negatives else [])
    ).groupBy(*(f"to_{c}" for c in keys))
    return held.cogroup(asked).applyInArrow(
        lambda a, b: _scan_pair(a, b, negatives, largest),
        "anchor long, place int, row long, vec_id long, score long",
    )


def hard_negatives(vectors: DataFrame, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, embedding, label)."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: 256 * x)
    whole = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        scaled.alias("scaled"),
    ).where(F.col("label").isNotNull() & F.col("scaled").isNotNull() & whole)
    rows = rows.select("vec_id", "label", _floors("scaled").alias("q"))
    rows = saved(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    is_anchor = F.coalesce(F.col("vec_id") % ANCHORS == 0, F.lit(False))
    n, asked, largest = rows.agg(
        F.count("*"), F.count_if(is_anchor),
        F.max(F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("q", F.abs)), F.lit(0.0)))),
    ).head()
    largest = largest or 0.0
    if largest < 1 << 15:
        rows = rows.withColumn("q", F.col("q").cast("array<smallint>"))

    # Buckets of labels; one that holds much more than a tile is cut into parts.
    buckets = max(1, -(-n // tile))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("asked"))
    sizes = saved(sizes.select(
        "bucket",
        F.ceil(F.col("n") / tile).alias("parts"),
        F.ceil(F.col("asked") / chunk).alias("chunks"),
    ), "tiles")
    dealt = rows.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    anchors = rows.where(is_anchor)
    spread = lambda over: F.explode(F.sequence(F.lit(0).cast("long"), over - 1))

    inside = dealt.where("chunks > 0").withColumn("chunk", spread(F.col("chunks")))
    labelled = anchors.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    labelled = labelled.withColumn("part", spread(F.col("parts")))
    near = saved(_meet(inside, labelled, False, largest), "near")
    positives = _first(near, ["anchor"], POSITIVES)
    positives = positives.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives")
    )

    chunks = max(1, -(-asked // chunk))
    asking = saved(anchors.drop("bucket").join(positives, F.col("key") == F.col("anchor")).drop("anchor"), "anchors")
    everywhere = asking.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    everywhere = everywhere.withColumn("bucket", spread(F.lit(buckets).cast("long")))
    everywhere = everywhere.join(sizes, "bucket").withColumn("part", spread(F.col("parts")))
    outside = dealt.drop("chunks").withColumn("chunk", spread(F.lit(chunks).cast("long")))
    hard = saved(_meet(outside, everywhere, True, largest), "hard")
    hard = _first(hard, ["anchor", "place"], NEGATIVES).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = asking.select(
        F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive")
    )
    return named.join(hard, ["anchor", "place"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank", "negative_id",
        F.col("positive.score").alias("positive_score"), "negative_score",
    )


def _floors(column: str) -> Column:
    """Floors as doubles: `floor` itself gives longs, and whole numbers beyond 2^52 are their own floor."""
    return F.transform(column, lambda x: F.when(F.abs(x) < 1 << 52, F.floor(x).cast("double")).otherwise(x))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with v as (
  select row_number() over () as k, vec_id, len(embedding) as n,
    case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(256 * x::double)]) = 0
), a as (
  select * from v where vec_id % 50 = 0
), p as (
  select a.k, a.vec_id as anchor_id, a.label, a.n, a.q, b.vec_id as positive_id,
    list_dot_product(a.q, b.q)::bigint as positive_score,
    row_number() over (partition by a.k order by list_dot_product(a.q, b.q) desc, b.vec_id nulls last, b.k) as place
  from a join v b on a.label = b.label and a.k <> b.k and a.n = b.n
  qualify place <= 5
), s as (
  select a.k, a.label, c.k as c, c.label as other, c.vec_id as negative_id,
    list_dot_product(a.q, c.q)::bigint as negative_score
  from a join v c on a.label <> c.label and a.n = c.n
), h as (
  select p.anchor_id, p.positive_id, s.negative_id, p.positive_score, s.negative_score,
    row_number() over (partition by p.k, p.place order by s.negative_score desc, s.negative_id nulls last, s.c) as rank
  from p join s on p.k = s.k
    and 50 * p.positive_score <= 100 * s.negative_score and 100 * s.negative_score <= 95 * p.positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from h where rank <= 3
"""
