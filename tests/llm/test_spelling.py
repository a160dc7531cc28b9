"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, length string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counted):
    out = {}
    for word, n in counted.items():
        near = [w for w in counted if w != word and one_edit(word, w)]
        best = min(near, key=lambda w: (-counted[w], w), default=None)
        form = best if best is not None and counted[best] >= 5 * n else None
        out[word] = [word, form, word, n, len(near), counted[form] if form else None]
    for row in out.values():
        while out[row[2]][1] is not None:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def words(docs):
    counted = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}


def vocabulary(seed=0, n=700):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        word = "".join(rng.choice("abeißÉ") for _ in range(rng.randrange(6, 9)))
        for _ in range(rng.randrange(6)):
            out[word] = rng.choice([5, 6, 7, 30, 31, 200, 1000, 6000])
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + "a" + word[k:], word[:k] + "b" + word[k + 1 :]])
    return out


@pytest.mark.parametrize("leaf, searches, sample", [(2048, 65536, 20000), (40, 30, 60), (5, 1000, 20000)])
def test_all_words(spark, leaf, searches, sample):
    counted = vocabulary()
    counted |= {"x" * 3000: 5, "x" * 3001: 40, "y" + "x" * 2999: 300, "": 7, "a": 8, "b": 60, "ab": 9, "日本語": 5, "日木語": 90, "日本": 6}
    rows = spark.createDataFrame(list(counted.items()), "word string, n int")
    got = spelling.variants(rows, leaf=leaf, searches=searches, sample=sample)
    assert sorted(map(tuple, got.collect())) == grouped(counted)


def test_anagrams_share_a_region(spark):
    """Words with the same letters cannot be cut by planes, so hashes cut them."""
    rng = random.Random(4)
    letters = list("abcdefgh")
    counted = {}
    while len(counted) < 300:
        rng.shuffle(letters)
        counted["".join(letters)] = 5
    counted |= {w[:-1]: 25 for w in list(counted)[:50]}
    got = spelling.variants(spark.createDataFrame(list(counted.items()), "word string, n int"), leaf=16, searches=40)
    assert sorted(map(tuple, got.collect())) == grouped(counted)


def test_boxes_prune():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 4, (2000, 12)).astype(np.int32)
    for tight in (True, False):
        root = spelling.grow(points, 16, tight)[0]
        seen = [len(rows) * len(box.members) for box, rows in spelling.reach(root, points[:50], 2)]
        assert sum(seen) < 50 * 2000 / 4
        for box, rows in spelling.reach(root, points[:50], 2):
            assert len(box.members)
        found = {(q, p) for box, rows in spelling.reach(root, points[:50], 2) for q in rows for p in box.members}
        close = np.abs(points[:50, None, :] - points[None]).sum(axis=2) <= 2
        assert {tuple(x) for x in np.argwhere(close)} <= found


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n int")).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(2)
    stock = list(vocabulary(5, 150)) + ["ÀÉglise", "église", "Müller", "MÜLLER", "×÷ÿÀàà", "Straße", "STRASSE"]
    docs = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(120))) + rng.choice(["", ".", "1", "\n"]), "w", 1, "l") for i in range(60)]
    docs += [(None, docs[3][1], None, None, None), (None, None, "w", 1, "l"), (7, None, "w", 1, "l"), (7, docs[5][1], "w", 1, "l"), (8, "", "w", 1, "l")]
    docs += [(99, "straße" * 200_000 + " Straße, strase-strasse" * 20_000, "w", 1, "l"), docs[0], docs[0]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op12_spelling(spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(map(tuple, got.collect())) == grouped(words(docs))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spelling.op12_spelling(spark, f"{tmp_path}/none").count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = spelling.op12_spelling(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == grouped(words([tuple(r) for r in docs]))
    assert got.where(F.col("form").isNotNull()).count()
