"""SimHash near-dedup: fingerprints joined by walking a binary trie against itself.

Fingerprints that occur are collapsed to one row each first, so copies cost
nothing in the join. The trie over the distinct fingerprints is cut into blocks
of bounded size. Pairs of blocks whose prefixes differ in few enough bits are
walked together, node pair by node pair, adding up differing bits and dropping a
pair of nodes as soon as the budget is exceeded. A walk returns a spanning forest
of the links it finds, so a dense neighbourhood never turns into all its pairs.

Null text counts as no words. Rows without words have fingerprint zero and link
like any other. Rows that repeat a doc_id are separate rows; null doc_ids take
part but never name a component that has another id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, components, keyed, row_keys, saved, table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 4096  # fingerprints of a trie block, on average; four times that at most
_CHUNK = 1 << 14
_FRONTIER = 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        n = min(_CHUNK, total - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(n))), "<u8", n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: list[Column] | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long. `keys`, longs, stand behind if given."""
    keys = keys or []
    names = ["doc_id", "fp", *(f"key{k}" for k in range(len(keys)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), fps, *batch.columns[2:]], names)

    return docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("t"), *keys).mapInArrow(
        run, ", ".join(f"{name} long" for name in names)
    )


def _expand(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset in a and offset in b of every pair of each row's na x nb rectangle."""
    sizes = na * nb
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, at // nb[row], at % nb[row]


def walk(a: np.ndarray, b: np.ndarray, budget: int, self_join: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted unsigned arrays within `budget` differing bits.

    A trie node is a range of a sorted array. The stack holds chunks of node
    pairs at one level; a step splits both ranges at the level's bit.
    """
    one = np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([0])
    stack = [(63, *one)]
    while stack:
        bit, alo, ahi, blo, bhi, used = stack.pop()
        small = (ahi - alo) * (bhi - blo) <= 16
        if bit < 0:
            small = np.ones_like(small)
        if small.any():
            lo_a, lo_b = alo[small], blo[small]
            row, i, j = _expand(ahi[small] - lo_a, bhi[small] - lo_b)
            i, j = i + lo_a[row], j + lo_b[row]
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if self_join:
                hit &= i < j
            if hit.any():
                yield i[hit], j[hit]
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi, used = alo[big], ahi[big], blo[big], bhi[big], used[big]
        flag = np.uint64(1 << bit)
        keep = np.uint64((1 << 64) - (1 << (bit + 1)))
        amid = np.clip(np.searchsorted(a, (a[alo] & keep) | flag), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & keep) | flag), blo, bhi)
        parts = [
            (alo, amid, blo, bmid, used),
            (alo, amid, bmid, bhi, used + 1),
            (amid, ahi, blo, bmid, used + 1),
            (amid, ahi, bmid, bhi, used),
        ]
        cols = [np.concatenate(c) for c in zip(*parts)]
        live = (cols[1] > cols[0]) & (cols[3] > cols[2]) & (cols[4] <= budget)
        if self_join:
            live &= cols[0] <= cols[2]
        cols = [c[live] for c in cols]
        for start in range(0, len(cols[0]), _FRONTIER):
            stack.append((bit - 1, *(c[start : start + _FRONTIER] for c in cols)))


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (indices of roots) after linking i[k] with j[k]."""
    while True:
        x, y = labels[i], labels[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return labels
        np.minimum.at(labels, high[apart], low[apart])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def _forest(a: np.ndarray, b: np.ndarray, budget: int, self_join: bool) -> tuple[np.ndarray, np.ndarray]:
    values = a if self_join else np.concatenate([a, b])
    shift = 0 if self_join else len(a)
    labels = np.arange(len(values))
    for i, j in walk(a, b, budget, self_join):
        labels = union(labels, i, j + shift)
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[linked], values[labels[linked]]


def _prefix(depth):
    return F.when(F.col(depth) == 0, F.lit(0).cast("long")).otherwise(
        F.expr(f"shiftrightunsigned(fp, 64 - {depth})")
    )


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect all fingerprints (fp, distinct) within `max_bits` bits.

    Blocks are trie nodes at a depth that follows the number of fingerprints;
    a node that is still too large is cut deeper, until every block is small.
    """
    top = max(0, (distinct.count() // block).bit_length())
    cut = distinct.select("fp", F.lit(top).alias("depth"))
    while True:
        sized = cut.withColumn("prefix", _prefix("depth"))
        heavy = sized.groupBy("depth", "prefix").count().where(f"count > {4 * block} and depth < 64").drop("count")
        if heavy.isEmpty():
            break
        cut = saved(
            sized.join(heavy.withColumn("deeper", F.lit(4)), ["depth", "prefix"], "left").select(
                "fp", F.least(F.lit(64), F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")
            ),
            "trie",
        )
    root = F.expr(f"shiftrightunsigned(fps[0], {64 - top})") if top else F.lit(0).cast("long")
    nodes = saved(
        sized.groupBy("depth", "prefix")
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        .withColumn("root", root),
        "blocks",
    )
    flips = [sum(1 << x for x in c) for k in range(min(max_bits, top) + 1) for c in combinations(range(top), k)]
    left = nodes.select(
        F.col("fps").alias("a"), F.col("depth").alias("da"), F.col("prefix").alias("pa"), "root"
    ).withColumn("flip", F.explode(F.lit(flips).cast("array<long>")))
    left = left.withColumn("root", F.expr("root ^ flip")).drop("flip")
    right = nodes.select(F.col("fps").alias("b"), F.col("depth").alias("db"), F.col("prefix").alias("pb"), "root")
    differing = F.expr(
        "bit_count(shiftrightunsigned(pa, da - least(da, db)) ^ shiftrightunsigned(pb, db - least(da, db)))"
    )
    pairs = left.join(right, "root").where(F.expr("a[0] <= b[0]") & (differing <= max_bits)).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                x, y = (np.sort(v.values.to_numpy().view(np.uint64)) for v in (a, b))
                u, v = _forest(x, y, max_bits, x[0] == y[0])
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return pairs.repartition("a", "b").mapInArrow(run, "a long, b long")


def _rooted(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, doc, root): each fingerprint of `rows` with its smallest doc_id and its component."""
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    found = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    return saved(rooted.select("fp", "doc", "root"), "rooted")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of `docs`."""
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(rows, max_bits)
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs` for each component, all columns.

    It is the one with the smallest doc_id, NULL last; of several, the one whose
    text, then whose whole row has the smallest hash; of equal rows, any.
    """
    keys = [F.xxhash64("text"), *row_keys(docs)]
    rows = saved(fingerprints(docs, shingle, keys), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key0", "key1", "key2")).alias("first")
    # by fingerprint first: a large component has many
    by_fp = rows.groupBy("fp").agg(first).join(_rooted(rows, max_bits), "fp")
    kept = by_fp.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.key1").alias(ROW[0]), F.col("first.key2").alias(ROW[1])
    )
    kept = saved(kept, "kept")
    return keyed(docs).join(kept, ROW).dropDuplicates(ROW).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
