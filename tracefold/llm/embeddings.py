"""Embedding near-dedup: int8 tile products with a proven error bound per vector.

Equal vectors of a label are one row with a count first. The distinct vectors of a
label are dealt into tiles of bounded size by hash, and every pair of tiles of a
label is one row of a Spark join. A task multiplies the two tiles as 8-bit
integers. With u = s*q + r, where r is what rounding left, the true cosine differs
from the integer product by at most |s*q| |r'| + |r| |s'*q'| + |r| |r'|, from
stored norms. Only pairs that may reach the threshold within that bound are
computed from the full vectors in double precision.

A task returns numbers of links per vector and a spanning forest of the links it
found, never the pairs. Labels that are NULL and vectors that are NULL, zero or
hold NULL or non-finite components link with nothing; vectors of different
lengths do not link either. Rows that repeat a vec_id are vectors of their own and
share its links; NULL ids link like others but do not name a component. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, same, saved, table
from .simhash import union
from .vectors import matrix, unit, usable

THRESHOLD = 0.93
TILE = 1024
_SLACK = 1e-9  # covers rounding of the bound itself
_EXACT = 1 << 14  # pairs computed in full precision at once


class Quantised:
    """Unit vectors as 8-bit integers, with the exact norms of what the integers hold and of what they miss."""

    def __init__(self, units: np.ndarray):
        self.scale = np.abs(units).max(axis=1) / 127
        self.codes = np.rint(units / self.scale[:, None]).astype(np.int8)
        held = self.codes * self.scale[:, None]
        self.held = np.linalg.norm(held, axis=1)
        self.missed = np.linalg.norm(units - held, axis=1)


def possible(a: Quantised, b: Quantised, threshold: float) -> np.ndarray:
    """Pairs whose cosine may be `threshold` or more.

    Sums of products of 8-bit integers are exact in single precision up to 1040
    dimensions and in double precision beyond.
    """
    kind = np.float32 if a.codes.shape[1] <= 1040 else np.float64
    product = (a.codes.astype(kind) @ b.codes.T.astype(kind)).astype(np.float64)
    product *= a.scale[:, None] * b.scale[None, :]
    product += a.held[:, None] * b.missed + a.missed[:, None] * (b.held + b.missed)
    return product >= threshold - _SLACK


def tile_links(u: np.ndarray, v: np.ndarray, threshold: float, same_tile: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs of unit vectors; each pair of one tile once."""
    maybe = possible(Quantised(u), Quantised(v), threshold)
    if same_tile:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    hit = np.zeros(len(i), bool)
    for at in range(0, len(i), _EXACT):
        part = slice(at, at + _EXACT)
        hit[part] = np.einsum("ij,ij->i", u[i[part]], v[j[part]]) >= threshold
    return i[hit], j[hit]


def _tile_rows(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            left, right = (
                {f: batch.column(batch.schema.get_field_index(side))[k].values.field(f) for f in ("key", "n", "v")}
                for side in ("left", "right")
            )
            keys, sizes = (
                np.concatenate([left[f].to_numpy(), right[f].to_numpy()]) for f in ("key", "n")
            )
            one_tile = bool(batch.column(batch.schema.get_field_index("one_tile"))[k].as_py())
            m = len(left["key"])
            i, j = tile_links(unit(matrix(left["v"])), unit(matrix(right["v"])), threshold, one_tile)
            shift = 0 if one_tile else m
            j = j + shift
            found = np.bincount(i, sizes[j], len(keys)) + np.bincount(j, sizes[i], len(keys))
            roots = union(np.arange(len(keys)), i, j)
            rows = np.flatnonzero(found)
            yield pa.record_batch(
                [pa.array(keys[rows]), pa.array(found[rows].astype(np.int64)), pa.array(keys[roots[rows]])],
                ["key", "found", "root"],
            )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of `vectors` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), "label")
    able = F.col("label").isNotNull() & usable(F.col("v"))
    # Grouping treats -0.0 as 0.0, so equal vectors are the rows of one group.
    rows = rows.select("vec_id", "label", "v", able.alias("able"))
    classes = (
        rows.where("able").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    )
    classes = saved(
        classes.withColumns({"key": F.monotonically_increasing_id(), "dim": F.size("v")}),
        "classes",
    )
    sizes = classes.groupBy("label", "dim").count().withColumn("tiles", F.ceil(F.col("count") / tile).cast("long"))
    dealt = classes.join(sizes.drop("count"), ["label", "dim"]).withColumn(
        "tile", F.pmod(F.xxhash64("key", F.lit(1)), F.col("tiles"))
    )
    tiles = saved(
        dealt.groupBy("label", "dim", "tile").agg(F.collect_list(F.struct("key", "n", "v")).alias("rows")), "tiles"
    )
    pairs = tiles.select("label", "dim", F.col("tile").alias("i")).join(sizes.drop("count"), ["label", "dim"])
    pairs = pairs.withColumn("j", F.explode(F.sequence("i", F.col("tiles") - 1)))
    left = tiles.select("label", "dim", F.col("tile").alias("i"), F.col("rows").alias("left"))
    right = tiles.select("label", "dim", F.col("tile").alias("j"), F.col("rows").alias("right"))
    joined = pairs.join(left, ["label", "dim", "i"]).join(right, ["label", "dim", "j"])
    spread = joined.select("left", "right", (F.col("i") == F.col("j")).alias("one_tile")).repartition(
        *(F.xxhash64("left.key"), F.xxhash64("right.key"))
    )
    found = saved(
        spread.mapInArrow(lambda it: _tile_rows(it, threshold), "key long, found long, root long"), "links"
    )
    linked = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("found").alias("found"))
    full = (
        classes.select("label", "v", "key", "first", "n")
        .join(counts, "key", "left")
        .join(linked.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("component", "key"))
    )
    full = saved(full.drop("component"), "rooted")
    names = full.groupBy("root").agg(F.min("first").alias("component_id"))
    named = full.join(names, "root").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), "component_id",
        (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("links"),
    )
    out = rows.join(named, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")) & F.col("able"), "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        same(F.col("vec_id"), component).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
