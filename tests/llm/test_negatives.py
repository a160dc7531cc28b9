"""Hard negatives against comparisons of all rows."""

import math

import numpy as np
import pytest

from tracefold.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, key int"


def expected(rows):
    able = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        able.append((vec_id, [math.floor(256 * x) for x in v], label))
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    last = lambda vec_id: (vec_id is None, vec_id or 0)
    out = []
    for i, (anchor, q, label) in enumerate(able):
        if anchor is None or anchor % 50:
            continue
        scored = [
            (-cut(sum(a * b for a, b in zip(q, w))), last(vec_id), other == label)
            for j, (vec_id, w, other) in enumerate(able) if j != i and len(w) == len(q)
        ]
        for minus, positive, _ in sorted(x for x in scored if x[2])[:5]:
            hard = [x for x in scored if not x[2] and 50 * -minus <= 100 * -x[0] <= 95 * -minus]
            for rank, (score, negative, _) in enumerate(sorted(hard)[:3], 1):
                name = lambda x: None if x[0] else x[1]
                out.append((anchor, name(positive), rank, name(negative), -minus, -score))
    return sorted(out, key=str)


def table(seed=0, n=400, dims=12):
    rng = np.random.default_rng(seed)
    base, rows = rng.normal(size=(8, dims)), []
    for i in range(n):
        near = base[rng.integers(8)] + rng.normal(size=dims) * 0.3
        rows.append((i, np.round(near, 2).tolist(), int(rng.integers(3)) if i % 19 else None, "x", i))
    odd = [None, [None] * dims, [float("nan")] * dims, [float("inf")] * dims, [0.0] * dims, [1.0] * 3, [1e306] * dims, []]
    rows += [(700 + 50 * k, v, 1, None, None) for k, v in enumerate(odd)]
    rows += [(50, rows[50][1], 1, "y", 1), (50, rows[51][1], 2, "y", 1), (None, rows[100][1], 1, "z", 2), (None, rows[3][1], 2, "z", 2)]
    return rows + [(i, rows[i][1], rows[i][2], "copy", 0) for i in range(0, 60, 3)]


@pytest.mark.parametrize("tile, chunk", [(4096, 512), (32, 4)])
def test_all_rows(spark, tile, chunk):
    rows = table()
    got = hardnegatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), tile, chunk)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert len(expected(rows)) > 50


def test_large_numbers(spark):
    rows = [(i, [(i % 5 + 1) * 1e6 + i, float(-i), 3e6], i % 2) for i in range(60)]
    rows += [(100 + i, [(i + 1) * 1e300, 1.0, 2.0], i % 2) for i in range(6)]
    rows = [(*r, "", 0) for r in rows]
    assert len(expected(rows)) >= 15
    got = hardnegatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), 16, 2)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_one_label_and_no_rows(spark):
    rows = [(i, [1.0, i / 7], 3, "", 0) for i in range(101) if i % 7]
    assert hardnegatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert hardnegatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scan_drops_rows_early():
    rng = np.random.default_rng(1)
    columns = rng.integers(-50, 50, (32, 500)).astype(np.float32)
    anchor = np.zeros(32, np.float32)
    anchor[[3, 9]] = 100, -80
    low, high = columns.min(axis=1), columns.max(axis=1)
    rows, scores = hardnegatives.scan(anchor, columns, low, high, np.arange(500), [(-1e9, 1e9)], 5)
    exact = anchor @ columns
    assert set(np.argsort(-exact)[:5]) <= set(rows.tolist())
    assert len(rows) < 50 and (scores == exact[rows]).all()
    rows, scores = hardnegatives.scan(anchor, columns, low, high, np.arange(500), [(1000, 1100)], 3)
    inside = np.flatnonzero((exact >= 1000) & (exact <= 1100))
    assert sorted(exact[inside])[-3:] == sorted(s for s in scores if 1000 <= s <= 1100)[-3:]


def test_query(spark, tmp_path):
    rows = table(3, 300)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hardnegatives.op11_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
        ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
