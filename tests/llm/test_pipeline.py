"""The whole pipeline, every row after every stage, against plain versions."""

import os
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
import xxhash

from tracefold.llm import common, mixing, quality
from tracefold.llm import sentencepiece_fst as fst
from tests.llm.test_pairs import budget, edits, plain_fingerprint, smallest_reachable
from tests.llm.test_texts import quality_plainly

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def good_plainly(rows):
    _, _, scores = quality_plainly([r["text"] for r in rows], quality.TRAIN_ROWS)
    assert all(abs(s - 0.5) > 1e-4 for s in scores)
    return [r for r, s in zip(rows, scores) if s >= 0.5]


def without_lines_plainly(rows):
    held = []
    for i, r in enumerate(rows):
        for k, line in enumerate(r["text"].split("\n")):
            if re.search(r"[^ \t-\r]", line):
                held.append(((r["doc_id"] is not None, r["doc_id"] or 0, k), i, line, Counter(line)))
    held.sort(key=lambda h: h[0])
    gone = [set() for _ in rows]
    for place, i, a, letters in held:
        for before, _, b, others in held:
            if before >= place:
                break
            allowed = budget(a, b)
            if a == b or (
                abs(len(a) - len(b)) <= allowed
                and sum(((letters - others) + (others - letters)).values()) <= 2 * allowed
                and edits(a, b) <= allowed
            ):
                gone[i].add(place[2])
                break
    out = []
    for r, lines in zip(rows, gone):
        text = "\n".join(line for k, line in enumerate(r["text"].split("\n")) if k not in lines)
        if not lines or re.search(r"[^ \t-\r]", text):
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def one_of_each_group_plainly(rows):
    fps = [plain_fingerprint(r["text"]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]

    def order(r):
        key = xxhash.xxh64_intdigest(r["text"].encode(), seed=42)
        return r["doc_id"] is None, r["doc_id"] or 0, key - (key >> 63 << 64)

    ranked = sorted(range(len(rows)), key=lambda i: order(rows[i]))
    rank = {i: n for n, i in enumerate(ranked)}
    roots = smallest_reachable(len(rows), linked, [rank[i] for i in range(len(rows))])
    return [rows[ranked[k]] for k in sorted(set(roots))]


def mixed_plainly(rows):
    documents = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=t) for c, t in
                              (("doc_id", "Int64"), ("source", object), ("text", object))})
    con = duckdb.connect()
    con.register("documents", documents)
    uses = {r[0]: sum(p is not None for p in r[1:]) for r in con.sql(
        f"select doc_id, position_1, position_2 from ({mixing.OP3_SQL})"
    ).fetchall()}
    assert len(uses) == len(rows), "the SQL tells rows apart by doc_id"
    return [r for r in rows for _ in range(uses[r["doc_id"]])]


def tokens_plainly(rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=fst.MODEL)
    return [{**r, "ids": library.encode(r["text"])} for r in rows]


PLAINLY = [good_plainly, without_lines_plainly, one_of_each_group_plainly, mixed_plainly, tokens_plainly]


def as_text(rows):
    return sorted(str(sorted(r.items())) for r in rows)


@pytest.mark.skipif(not os.path.exists(fst.MODEL), reason="no model file")
def test_every_row_of_every_stage(spark, tmp_path, monkeypatch):
    """NULL, empty, blank and long texts, repeated rows and ids, copies, near copies, clashing extra columns."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [{**r.asDict(), "_row": r.doc_id % 3, "_score": str(r.source), "a.b": None} for r in given]
    by = {r["doc_id"]: r for r in rows}
    some = sorted(by)
    prose = "Clouds gathered over the quiet harbour while fishermen mended nets, talked of winter and drank tea. "
    extra = [{**rows[0], "doc_id": -k, "text": text} for k, text in enumerate([None, "", " \n\t", "word " * 50_000, "x" * 300_000], 1)]
    extra += [{**by[some[5]]}, {**by[some[5]]}]  # repeated rows
    extra += [{**by[some[150]], "text": by[some[5]]["text"]}]  # a repeated id with a copy
    extra += [{**by[some[20]], "doc_id": None}]  # NULL comes first, so its copy goes
    extra += [{**rows[0], "doc_id": 900_000 + k, "text": prose * 3 + f"Number {k} ends here."} for k in range(4)]
    extra += [{**rows[0], "doc_id": 900_010, "text": None, "source": None}, {**rows[1], "doc_id": 900_011, "source": None}]
    schema = spark.createDataFrame(given[:1]).schema.simpleString()[7:-1]
    names = list(rows[0])
    df = spark.createDataFrame(
        [tuple(r[c] for c in names) for r in rows + extra],
        ", ".join(part.replace(":", " ", 1) for part in schema.split(",")) + ", _row bigint, _score string, `a.b` string",
    )
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")

    stages, saved = [], common.saved
    named = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES]

    def keep(frame, name):
        out = saved(frame, name)
        if name in named:
            stages.append(out)
        return out

    monkeypatch.setattr(common, "saved", keep)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(stages) == len(PLAINLY) == len(corpus_pipeline.STAGES)
    held = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    for (name, _), stage, plainly in zip(corpus_pipeline.STAGES, stages, PLAINLY):
        before = len(held)
        held = plainly(held)
        assert as_text(r.asDict() for r in stage.collect()) == as_text(held), name
        assert stage.columns == [*names, *(["ids"] if name == "sentencepiece" else [])]
        assert held and (len(held) != before or name == "sentencepiece"), name
    assert as_text(r.asDict() for r in out.collect()) == as_text(held)


def test_empty_table(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*documents.columns, "ids"] and out.count() == 0
