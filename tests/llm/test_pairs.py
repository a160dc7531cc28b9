"""Operators on pairs against all-pairs comparisons of small inputs."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracefold.llm import embeddings, linededup, neighbours, simhash
from tracefold.llm.common import components


def smallest_reachable(n, linked, names):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    best = {}
    for i in range(n):
        if names[i] is not None:
            best[root[i]] = min(names[i], best.get(root[i], names[i]))
    return [best.get(root[i]) for i in range(n)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (5, 5), (7, 1)] + [(100, k) for k in range(101, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 1 for k in (1, 2, 3, 7, 8, 9)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(20, 16)), []
    for i in range(150):
        v = base[rng.integers(20)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.3])
        rows.append((i, v.tolist(), int(rng.integers(2)) if i % 17 else None))
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1e300] * 16, [1e-300] * 16, [1.0] * 3, []]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)]
    return rows + [(5, [-0.0] * 15 + [1.0], 1), (1020, [0.0] * 15 + [1.0], 1), (None, [0.0] * 15 + [2.0], 1)]


def usable(v):
    return bool(v) and None not in v and np.isfinite(v).all() and any(v)


@pytest.mark.parametrize("tile", [1024, 16])
def test_embedding_links(spark, tile):
    rows = vectors()
    n, linked, count = len(rows), [], [0] * len(rows)
    for i in range(n):
        for j in range(n):
            (_, u, a), (_, v, b) = rows[i], rows[j]
            if i != j and a is not None and a == b and usable(u) and usable(v) and len(u) == len(v):
                u, v = (np.array(x) / np.abs(x).max() for x in (u, v))
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    linked.append((i, j))
                    count[i] += 1
    root = smallest_reachable(n, linked, [r[0] for r in rows])
    want = [(r[0], c, k, r[0] == k) for r, c, k in zip(rows, count, root)]
    df = spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component_id string"
    )
    assert in_order(embeddings.near_duplicates(df, tile=tile).collect()) == in_order(want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_int8_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(1)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 300, 24)))
    exact = u @ v.T
    for threshold in (0.0, 0.3, 0.6):
        maybe = embeddings.possible(embeddings.Quantised(u), embeddings.Quantised(v), threshold)
        assert maybe[exact >= threshold].all()
        assert not maybe[exact < threshold - 0.1].any()


def words(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    random.seed(4)
    vocabulary = ["".join(random.choices("abcÉ", k=4)) for _ in range(40)]
    texts = [None, "", " \t\n", "One", "one two", "A B c\x0bd e"] + [
        " ".join(random.choices(vocabulary, k=random.randrange(1, 60))) for _ in range(120)
    ]
    texts += [t + " extra" for t in texts[60:90]] + texts[70:80] + [texts[9] * 3000]
    rows = [(i if i != 30 else None, t, "x") for i, t in enumerate(texts)] + [(2, "repeated id", "y")]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    n = len(rows)
    linked = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = smallest_reachable(n, linked, [r[0] for r in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    want = [(r[0], f"{f:016x}", k) for r, f, k in zip(rows, fps, root)]
    assert in_order(simhash.near_duplicates(df).collect()) == in_order(want)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[0] == w[2]}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark):
    random.seed(12)

    def prose():
        return " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(60))

    a, b, c, d, e = (prose() for _ in range(5))
    rows = [
        (1, a, "s"), (1, a, "s"), (1, a, None), (2, a, "s"),  # equal rows, a row that differs elsewhere, a copy
        (None, b, "s"), (None, b, "s"), (None, b, "t"),  # nothing but NULL ids
        (3, c, "s"), (5, d, "s"), (5, c, "s"), (None, c, "s"),  # id 5 stays for d only
        (None, e, "s"), (9, e, "s"), (10, None, "s"), (11, "", "s"), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert in_order(r[:2] for r in kept) == in_order([(1, a), (None, b), (3, c), (5, d), (9, e), (10, None)])
    assert set(kept) <= set(rows)
    assert in_order(kept) == in_order(simhash.keep_one(df.repartition(3)).collect())
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_trie_join_finds_every_link(spark, block):
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    base[:20] &= np.uint64(0xFF)  # a crowded part of the trie
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(5)]
    fps = sorted({int(x) for x in [*base, *near]})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, block)
    got = dict(map(tuple, components(links).collect()))
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = smallest_reachable(len(fps), linked, signed)
    assert [got.get(s, s) for s in signed] == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, times):
    chars = list(text)
    for _ in range(times):
        i = random.randrange(len(chars))
        chars[i : i + random.randrange(2)] = random.choice([[], ["é"], ["a"]])
    return "".join(chars)


def budget(a, b, tau=2, per_edit=16):
    return min(tau, min(len(a), len(b)) // per_edit)


@pytest.mark.parametrize("tau, per_edit", [(1, 18), (2, 11), (3, 7), (2, 16)])
def test_line_links(spark, monkeypatch, tau, per_edit):
    random.seed(tau)
    monkeypatch.setattr(linededup, "SHARE", 3)
    base = ["".join(random.choices("abc déf", k=random.choice((9, 14, 20, 21, 22, 33, 40)))) for _ in range(40)]
    texts = sorted({*base, *(changed(random.choice(base), random.randrange(5)) for _ in range(120))})
    rows = spark.createDataFrame([(t,) for t in texts], "line string").selectExpr("line", "xxhash64(line) AS id").collect()
    names = {r.id: r.line for r in rows}
    found = linededup.links(spark.createDataFrame([(t,) for t in texts], "line string"), tau, per_edit)
    got = {(names[r.id], names[r.other]) for r in found.collect()}
    assert got == {
        (a, b) for a in texts for b in texts
        if a != b and abs(len(a) - len(b)) <= tau and edits(a, b) <= budget(a, b, tau, per_edit)
    }
    assert len(got) > 20


def test_line_removal(spark):
    line, near, other = "the quick brown fox jumps over the dog", "the quick brown fox jumps over the d0gs", "z" * 40
    rows = [
        (3, f"{line}\nshort\n{other}", "a"), (1, f"{near}\n{line}\n{other}", "b"), (2, "short\nshort", "c"),
        (4, None, "d"), (5, "", "e"), (6, f"{line}\n\n", "f"), (7, "x" * 50_000 + "\n" + "x" * 49_999, "g"),
        (None, f"{other}\nnew", "h"), (7, "x" * 50_000, "i"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {(r.doc_id, r.line_no) for r in linededup.duplicates(df).collect()}
    assert got == {(3, 0), (3, 1), (3, 2), (1, 1), (1, 2), (2, 1), (6, 0), (7, 1)}
    kept = linededup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.removed) for r in kept.collect() if r.removed not in "gi"), key=lambda r: r[2]) == [
        (1, near, "b"), (2, "short", "c"), (4, None, "d"), (5, "", "e"), (None, f"{other}\nnew", "h")
    ]
    assert linededup.duplicates(df.limit(0)).count() == 0


def lines_removed_plainly(rows, tau=2):
    """(doc_id, n_lines, n_removed, removed) of every row."""
    held = [
        ((doc is not None, doc or 0, k), i, line)
        for i, (doc, text) in enumerate(rows) if text is not None
        for k, line in enumerate(text.split("\n")) if re.search(r"[^ \t-\r]", line)
    ]
    gone = [set() for _ in rows]
    for place, i, a in held:
        for before, _, b in held:
            allowed = budget(a, b, tau)
            if before < place and (a == b or abs(len(a) - len(b)) <= allowed and edits(a, b) <= allowed):
                gone[i].add(place[2])
                break
    return in_order(
        (doc, 0 if text is None else text.count("\n") + 1, len(g), ",".join(map(str, sorted(g))))
        for (doc, text), g in zip(rows, gone)
    )


def removed_by_query(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return in_order(linededup.op10_line_dedup(spark, str(folder)).collect())


def test_short_lines_in_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(11)
    pool = ["Released under the MIT License.", "All rights reserved.", "All rights reserved!", "ab", "x", "é", "", "  ", "\t"]
    pool += ["".join(random.choices("abcdé ", k=random.randrange(1, 14))) for _ in range(60)]
    rows = [(i, "\n".join(random.choices(pool, k=random.randrange(1, 8)))) for i in range(40)] + [(50, None), (51, "")]
    rows += [(60 + i, f"{pool[0]}\nowner {i:09d}{i:09d}\n{pool[1]}\nab") for i in range(3)]
    assert removed_by_query(spark, tmp_path, rows) == lines_removed_plainly(rows)
    kept = corpus_pipeline.dedup_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    left = [line for r in kept for line in (r.text or "").split("\n")]
    assert [left.count(line) for line in (pool[0], "ab", "x")] == [1, 1, 1]


def test_lines_of_rows_that_share_an_id(spark, tmp_path):
    own = iter("".join(random.Random(k).choices("abcdefghijklmnop", k=40)) for k in range(99))
    line, other = next(own), next(own)
    rows = [(None, f"{line}\n{next(own)}"), (None, f"{next(own)}\n{line}"), (None, next(own)), (None, None), (None, "")]
    rows += [(5, f"{other}\n{next(own)}\n{line}"), (5, f"{next(own)}\n{next(own)}\n{other}\n{line}"), (5, next(own))]
    rows += [(6, f"{next(own)}\n{line}")] + [(7, f"{next(own)}\n{other}")]
    rows += rows[-1:]
    want = lines_removed_plainly(rows)
    assert sum(r[2] for r in want) == 7
    assert removed_by_query(spark, tmp_path, rows) == want
    kept = linededup.dedup(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    texts = []
    for doc, text in rows:
        drop = {(None, rows[1][1]): [line], (5, rows[5][1]): [line], (5, rows[6][1]): [line, other]}.get((doc, text), [])
        drop = drop or {6: [line], 7: [other]}.get(doc, [])
        texts.append((doc, None if text is None else "\n".join(x for x in text.split("\n") if x not in drop)))
    assert in_order(kept) == in_order(texts)


def test_common_lines_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "SHARE", 3)
    random.seed(21)
    common = ["the same line in every document", "the same line in every documents", "x", " " * 40, " " * 31, "\t"]
    rows = [(i % 37 or None, "\n".join(random.choices([*common, f"line number {i * i * 7919} stands alone"], k=6))) for i in range(80)]
    assert removed_by_query(spark, tmp_path, rows) == lines_removed_plainly(rows)


def test_columns_of_any_name(spark):
    names = ["row", "removed", "tk", "left", "whole", "id", "of", "share", "shares", "key", "_id"]
    rows = [(i, "a line of some length\n" * (1 + i) + f"own {i}", *(f"{n}{i}" for n in names)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = linededup.dedup(df)
    assert kept.columns == df.columns
    own = "a line of some length\n"
    assert sorted(map(tuple, kept.collect())) == [(i, own * (not i) + f"own {i}", *rows[i][2:]) for i in range(4)]


def test_text_of_many_lines(spark):
    lines = [hashlib.md5(b"%d" % (i % 200_000)).hexdigest() for i in range(300_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, f"{lines[5][:-1]}\nthe end")], "doc_id long, text string")
    for tau, left in ((0, f"{lines[5][:-1]}\nthe end"), (2, "the end")):
        start = time.time()
        kept = {r.doc_id: r.text for r in linededup.dedup(df, tau).collect()}
        assert time.time() - start < 60
        assert kept == {1: "\n".join(lines[:200_000]), 2: left}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[7].tolist()) for i in range(40)]
    odd = [None, [0.0] * 12, [float("inf")] * 12, [None] * 12, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(600 + k, v) for k, v in enumerate(odd)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(d[r.vec_id] - r.score) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[best].tolist()))
    assert hits >= 0.9 * 10 * (ids % 20 == 0).sum()
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert {r.vec_id for r in few} == {1, 2, 3}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_keys_are_compiled_and_wide_code_points_meet(spark):
    """The JVM compiles methods up to 8,000 bytes; an edit beside code points beyond 16 bits is found."""
    import re

    from pyspark.sql import functions as F
    from tracefold.llm import linededup

    lines = ["\U0001f600 " * 20 + "the same end of a line", "\U0001f600 " * 20 + "the same end of a lime", "none of it is like the others"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    made = linededup.keys(df.select(F.xxhash64("line").alias("id"), "line"), linededup.TAU, linededup.PER_EDIT)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", made._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) < 8000
    of = {r[1]: r[0] for r in df.select("line", F.xxhash64("line")).collect()}
    got = {(of[r.id], of[r.other]) for r in linededup.links(df).collect()}
    assert got == {(lines[0], lines[1]), (lines[1], lines[0])}
