"""Spelling variant grouping: words one edit apart, found in k-d trees over letter counts.

A word is a point: how often it holds each letter. One inserted, deleted or replaced
letter moves the point by an L1 distance of 1 or 2. The words of a length form a k-d
tree, and a word searches the tree of its own length within distance 2 and that of
the next length within distance 1. A box farther away than that is passed over with
all its words; words in the boxes that are left are compared by their counts, and the
pairs still in question letter by letter.

Across tasks, the upper part of a tree is a set of planes that cut a length's words
into regions of about LEAF words. The planes come from a sample of at most SAMPLE
words, taken by hash; all words are indexed in the region they lie in, and a word is
sent to every region within reach, so the sample decides how even regions are and
nothing else. Regions with more words, or more searches, than a task should hold are
cut by hash. Inside a task the lower part of the tree is built from the region's own
words.

A word's form is its near word of largest count (ties: first in code-point order), if
that count is at least RATIO times its own. Counts grow along forms, so there are no
circles, and the root is found by doubling the steps.

NULL and empty texts have no words. Words are told apart by code points. The letter
counts cover a-z and U+00C0 to U+00FF; `variants` refuses no other word, but counts
its other code points together, which costs time and loses no pair. In the query, a
NULL doc_id counts as an empty string where it is hashed, and rows that repeat a
doc_id or a text count once each. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST = 6
FEWEST = 5  # occurrences
RATIO = 5
LEAF = 2048  # words of a region
SEARCHES = 32 * LEAF  # of a region in one task
SAMPLE = 20_000
BUCKET = 16  # words of a box that is not cut any more
_COMPARED = 1 << 22  # letters compared at once

#: Dimension of every code point below 256; all others share the last one.
_DIMENSION = np.full(256, 90, np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[0xC0:] = np.arange(26, 90)
DIMENSIONS = 91


# --- k-d trees -------------------------------------------------------------------


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word's begin (one more entry than words)."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def letter_counts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(starts) - 1
    rows = np.repeat(np.arange(n), np.diff(starts))
    dimension = np.where(points < 256, _DIMENSION[np.minimum(points, 255)], DIMENSIONS - 1)
    return np.bincount(rows * DIMENSIONS + dimension, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.int32)


@dataclass
class Box:
    low: np.ndarray
    high: np.ndarray
    leaf: int = -1
    below: Box | None = None
    above: Box | None = None
    dimension: int = 0
    plane: int = 0  # counts up to it are below
    members: np.ndarray | None = None


def plane_of(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension of widest spread and the count at which it halves the points best."""
    spread = points.var(axis=0)
    dimension = int(spread.argmax())
    if not spread[dimension]:
        return None
    values, numbers = np.unique(points[:, dimension], return_counts=True)
    below = np.cumsum(numbers)[:-1]
    return dimension, int(values[np.abs(below - len(points) / 2).argmin()])


def grow(points: np.ndarray, size: float, tight: bool) -> list[Box]:
    """A tree whose leaves hold about `size` of the points; its root comes first.

    `tight` boxes end where their points do, others at the planes.
    """
    dims = points.shape[1]
    everything = Box(np.zeros(dims, np.int32), np.full(dims, np.iinfo(np.int32).max // 2, np.int32), members=np.arange(len(points)))
    boxes, at = [everything], 0
    while at < len(boxes):
        box = boxes[at]
        at += 1
        mine = points[box.members]
        if tight and len(mine):
            box.low, box.high = mine.min(axis=0), mine.max(axis=0)
        cut = plane_of(mine) if len(mine) > size else None
        if cut is None:
            continue
        box.dimension, box.plane = cut
        under = mine[:, box.dimension] <= box.plane
        low, high = box.low.copy(), box.high.copy()
        high[box.dimension], low[box.dimension] = box.plane, box.plane + 1
        box.below = Box(box.low, high, members=box.members[under])
        box.above = Box(low, box.high, members=box.members[~under])
        boxes += [box.below, box.above]
    for number, box in enumerate(b for b in boxes if b.below is None):
        box.leaf = number
    return boxes


def home(root: Box, points: np.ndarray) -> np.ndarray:
    """The leaf that each point lies in."""
    out, stack = np.zeros(len(points), np.int64), [(root, np.arange(len(points)))]
    while stack:
        box, rows = stack.pop()
        if box.below is None:
            out[rows] = box.leaf
        elif len(rows):
            under = points[rows, box.dimension] <= box.plane
            stack += [(box.below, rows[under]), (box.above, rows[~under])]
    return out


def reach(root: Box, points: np.ndarray, radius: np.ndarray | int) -> Iterator[tuple[Box, np.ndarray]]:
    """Every leaf with the numbers of the points that have it within their radius; all points go down together."""
    radius = np.broadcast_to(radius, len(points))
    stack = [(root, np.arange(len(points)))]
    while stack:
        box, rows = stack.pop()
        mine = points[rows]
        distance = (np.maximum(box.low - mine, 0) + np.maximum(mine - box.high, 0)).sum(axis=1)
        rows = rows[distance <= radius[rows]]
        if not len(rows):
            continue
        if box.below is None:
            yield box, rows
        else:
            stack += [(box.below, rows), (box.above, rows)]


# --- tasks -----------------------------------------------------------------------


def _route(batches: Iterator[pa.RecordBatch], trees: dict[int, Box]) -> Iterator[pa.RecordBatch]:
    """(length, leaf, search, word, n): a word's place in the index, and the regions it searches."""
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        if not words:
            continue
        points, starts = codes(words)
        counts, lengths = letter_counts(points, starts), np.diff(starts)
        found = []  # length, leaf, search, row
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for steps in (0, 1):
                tree, to = trees.get(int(length) + steps), int(length) + steps
                if tree is None:
                    found.append((to, 0, True, rows))
                    if not steps:
                        found.append((to, 0, False, rows))
                    continue
                found += [(to, box.leaf, True, rows[k]) for box, k in reach(tree, counts[rows], 2 - steps)]
                if not steps:
                    leaves = home(tree, counts[rows])
                    found += [(to, int(leaf), False, rows[leaves == leaf]) for leaf in np.unique(leaves)]
        sizes = [len(rows) for *_, rows in found]
        at = np.concatenate([rows for *_, rows in found])
        column = lambda k, kind: pa.array(np.repeat(np.array([f[k] for f in found], kind), sizes))  # noqa: E731, B023
        yield pa.record_batch(
            [column(0, np.int64), column(1, np.int64), column(2, bool), batch.column(0).take(pa.array(at)), pa.array(n[at])],
            ["length", "leaf", "search", "word", "n"],
        )


def one_edit(points: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b (as long, or one letter longer) are one edit apart; all a are of one length, all b too."""
    if not len(a):
        return np.zeros(0, bool)
    short, long = (int(starts[x[0] + 1] - starts[x[0]]) for x in (a, b))
    out = np.zeros(len(a), bool)
    step = max(1, _COMPARED // max(long, 1))
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        from_start = starts[a[part], None], starts[b[part], None]
        places = np.arange(short)
        differ = points[from_start[0] + places] != points[from_start[1] + places]
        lead = np.where(differ.any(axis=1), differ.argmax(axis=1), short) if short else np.zeros(len(differ), int)
        if long > short:
            differ = points[from_start[0] + places] != points[from_start[1] + places + 1]
        trail = np.where(differ.any(axis=1), differ[:, ::-1].argmax(axis=1), short) if short else lead
        # With one replaced letter the equal ends leave out just that one; with one more letter they cover the shorter word.
        out[part] = (lead + trail >= short) if long > short else (lead + trail == short - 1)
    return out


def near_words(index: list[str], searches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(search, index) numbers of words one edit apart; index words have one length, the others that or one less."""
    points, starts = codes(index + searches)
    counts, lengths = letter_counts(points, starts), np.diff(starts)
    apart = not counts[:, -1].any()  # then no two letters share a dimension, and one edit has just one distance
    counts = counts[:, counts.any(axis=0)]
    m = len(index)
    asked, radius = counts[m:], np.where(lengths[m:] == lengths[0], 2, 1)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(q: np.ndarray, p: np.ndarray) -> None:
        for same_length in (True, False):
            chosen = (radius[q] == 2) == same_length
            a, b = q[chosen], p[chosen]
            close = one_edit(points, starts, a + m, b)
            out.append((a[close], b[close]))

    for box, rows in reach(grow(counts[:m], BUCKET, True)[0], asked, radius):
        members = box.members
        step = max(1, _COMPARED // max(1, len(members) * counts.shape[1]))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            distance = np.abs(asked[some][:, None, :] - counts[members][None, :, :]).sum(axis=2)
            within = radius[some][:, None]
            q, p = np.nonzero(distance == within if apart else distance <= within)
            held = np.concatenate([held[0], some[q]]), np.concatenate([held[1], members[p]])
            if len(held[0]) > 100_000:
                settle(*held)
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    settle(*held)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _search(index: pa.Table, searches: pa.Table) -> pa.Table:
    """(word, near, near_n) of a region, both ways round where the lengths differ."""
    if not index.num_rows or not searches.num_rows:
        return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["word", "near", "near_n"])
    words, asked = index["word"].combine_chunks(), searches["word"].combine_chunks()
    n, asked_n = index["n"].combine_chunks(), searches["n"].combine_chunks()
    q, p = near_words(words.to_pylist(), asked.to_pylist())
    other = (searches["length"].to_numpy() != searches["own"].to_numpy())[q]
    one = [asked.take(pa.array(q)), words.take(pa.array(p)), n.take(pa.array(p))]
    back = [words.take(pa.array(p[other])), asked.take(pa.array(q[other])), asked_n.take(pa.array(q[other]))]
    return pa.table([pa.concat_arrays(pair) for pair in zip(one, back)], names=["word", "near", "near_n"])


# --- jobs ------------------------------------------------------------------------


def upper_trees(words: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> dict[int, Box]:
    """Planes for every length that has more than `leaf` of the `words` (word, n, length)."""
    crowded = words.groupBy("length").agg(F.count("*").alias("words")).where(F.col("words") > leaf)
    crowded = {r["length"]: r["words"] for r in crowded.collect()}  # one in `leaf` words at most
    if not crowded:
        return {}
    longer = words.groupBy("length").agg(F.count("*").alias("words")).where(F.col("words") > leaf).select("length")
    drawn = words.join(F.broadcast(longer), "length").orderBy(F.xxhash64("word"), "word").limit(sample).select("length", "word").collect()
    trees = {}
    for length, number in crowded.items():
        mine = [r["word"] for r in drawn if r["length"] == length]
        if mine:
            boxes = grow(letter_counts(*codes(mine)), max(1.0, leaf * len(mine) / number), False)
            for box in boxes:
                box.members = None
            trees[length] = boxes[0]
    return trees


def near_pairs(words: DataFrame, leaf: int = LEAF, searches: int = SEARCHES, sample: int = SAMPLE) -> DataFrame:
    """(word, near, near_n): each two of the `words` (word, n, length) that are one edit apart, both ways round."""
    trees = upper_trees(words, leaf, sample)
    routed = words.select("word", "n").mapInArrow(
        lambda it: _route(it, trees), "length long, leaf long, search boolean, word string, n long"
    )
    routed = saved(routed, "routed")
    region = ["length", "leaf"]
    sizes = routed.groupBy(*region).agg(
        F.ceil(F.count_if(~F.col("search")) / leaf / 2).alias("parts"), F.ceil(F.count_if("search") / searches).alias("chunks")
    )
    sizes = saved(sizes.where("parts > 0 and chunks > 0"), "regions")
    spread = lambda over: F.explode(F.sequence(F.lit(0).cast("long"), F.col(over) - 1))
    dealt = lambda over: F.pmod(F.xxhash64("word", F.lit(1)), F.col(over))
    held = routed.where(~F.col("search")).join(sizes, region)
    held = held.withColumn("part", dealt("parts")).withColumn("chunk", spread("chunks")).select(*region, "part", "chunk", "word", "n")
    asked = routed.where("search").join(sizes, region).withColumn("chunk", dealt("chunks")).withColumn("part", spread("parts"))
    asked = asked.select(
        *(F.col(c).alias(f"to_{c}") for c in (*region, "part", "chunk")), F.col("word").alias("word"), F.col("n").alias("n"),
        F.col("length").alias("length"), F.char_length("word").cast("long").alias("own"),
    )
    pairs = held.groupBy(*region, "part", "chunk").cogroup(asked.groupBy("to_length", "to_leaf", "to_part", "to_chunk"))
    return pairs.applyInArrow(_search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last one."""
    current = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = current.join(ahead, "root", "left")
        following = saved(following.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = bool(following.where("moved").limit(1).count())
        discard(current)
        current = following.drop("moved")
        current.saved_path = following.saved_path
        if not moved:
            return current


def variants(words: DataFrame, ratio: int = RATIO, leaf: int = LEAF, searches: int = SEARCHES, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per row of `words` (word, n), which are distinct."""
    words = saved(words.select("word", F.col("n").cast("long").alias("n"), F.char_length("word").alias("length")), "words")
    largest_first = F.struct((-F.col("near_n")).alias("minus"), "near")
    found = near_pairs(words, leaf, searches, sample).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(largest_first).alias("best")
    )
    found = words.drop("length").join(found, "word", "left")
    takes = -F.col("best.minus") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n"),
    )
    found = saved(found, "forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, run): maximal runs of at least `shortest` letters, a row per occurrence, A-Z lower-cased."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS + f"{{{shortest},}}"), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    lower = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    return each.select("doc_id", lower.alias("run"))


def misspelt(doc_id: Column, run: Column) -> Column:
    """`run`, in one of 199 cases without one of its letters, as the query's contract wants it."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % 199 == 0, without).otherwise(run)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = found.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return variants(words.where((F.col("n") >= FEWEST) & (F.char_length("word") >= SHORTEST)))
