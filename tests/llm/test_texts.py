"""Operators on single texts and on sources, against plain versions and exact round trips."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tracefold.llm import chat, mixing, quality, repeats, secrets, templates, trigrams
from tracefold.llm import sentencepiece_fst as fst
from tracefold.llm.common import row_keys
from tracefold.llm.queries import ORACLE, QUERIES
from tests.oracle_check import connect, differences


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def removed_plainly(rows, length):
    def place(doc, at):
        return (doc is not None, doc or 0), at

    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(first.get(key, place(doc, i)), place(doc, i))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < place(doc, i):
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(data, mask) if not m)
        out.append((doc, len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeats(spark, hot):
    random.seed(5)
    words = ["".join(random.choices("abcdeéf", k=random.randrange(2, 7))) for _ in range(200)]
    passages = [" ".join(random.choices(words, k=random.randrange(15, 50))) for _ in range(15)]
    rows = [
        (i, " ".join(random.choice(passages)[random.randrange(30) :] for _ in range(random.randrange(1, 6)))
         + " ".join(random.choices(words, k=20)))
        for i in range(60)
    ]
    rows += [(200, None), (201, ""), (202, "a" * 3000), (203, "ab" * 500 + "x" + "ab" * 300), (None, rows[3][1])]
    rows += [(5, rows[5][1]), (5, rows[9][1] + "zz"), (205, "a" * 99), (206, "é" * 50), (207, "xé" * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string").repartition(3)
    got = sorted((tuple(r)[:5] for r in repeats.removed(df, hot=hot).collect()), key=str)
    assert got == removed_plainly(rows, 100)
    assert repeats.removed(df.limit(0)).count() == 0


def test_common_prefixes_by_increasing_value():
    rng = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        text = np.append(rng.integers(1, 4, size), 0)
        order = repeats.suffixes(text)
        tails = [text[i:].tolist() for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: tails[i])
        for least in (1, 2, 5):
            want = [False] + [
                len(a := tails[order[k - 1]]) >= least and len(b := tails[order[k]]) >= least and a[:least] == b[:least]
                for k in range(1, len(text))
            ]
            assert repeats.common_prefixes(text, order, least).tolist() == want


def matches_plainly(text):
    letters = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}
    names = "|".join("".join(letters.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = {r.kind: r.expression for r in secrets.RULES}
    rules["hex"] = "[0-9a-f]+"
    rules["assign"] = f"({names})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out = [
        (m.start(), k, r.kind, m.end())
        for k, r in enumerate(secrets.RULES)
        for m in re.finditer(rules[r.kind], text or "")
        if len(m[r.group]) >= r.least
    ]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_secrets(spark):
    random.seed(3)
    parts = ["password", "PassWD", "secret", "token=", 'api_key: "', "ApiKey", "=", ":", " ", '"', "'", "abcdefgh", "AKIA"]
    parts += ["AKIA0123456789ABCD", "ſecret=abcdefghij", "toKen=abcdefghi", "0123456789abcdef" * 3, "é🙂", "\n", "=="]
    parts += ["ghp_" + "a1" * 20, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghi.eyJabcdefghi.abcdefghi"]
    texts = [None, "", "a" * 200_000 + "token=abcdefgh"] + ["".join(random.choices(parts, k=random.randrange(14))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = secrets.scan(df).select("doc_id", secrets.joined("spans").alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: matches_plainly(t) for i, t in enumerate(texts)}
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_query_and_very_many_matches(spark, tmp_path):
    many = "".join(f"é{i} token=abcdefgh{i} AKIA{i:016d} " for i in range(50_000))
    texts = [None, "", many, many[:4000], many[:4000], "password: hunter2222 " + "0123456789abcdef" * 2 + " AKIA1"]
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in secrets.op5_secrets(spark, str(tmp_path)).collect()]
    want = []
    for i, text in enumerate(texts):
        spans = matches_plainly(text)
        kinds = [s.split(":")[0] for s in spans.split(",")]
        base = ",".join(s for s in spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        counts = [kinds.count(k) for k in ("assign", "access", "hex")]
        want.append((i // 2, *counts, hashlib.sha256(base.encode()).hexdigest(), spans))
    assert sorted(got) == sorted(want)


def test_trigram_queries():
    assert trigrams.query("abcd") == {frozenset(["abc", "bcd"])}
    assert trigrams.query("abc|xyz[0-9]+") == {frozenset(["abc"]), frozenset(["xyz"])}
    assert trigrams.query("(?i:ABC)?x") == trigrams.query("[0-9a-f]{32,}") == trigrams.ANY
    assert trigrams.query("ab[cd]e.*fgh") == {frozenset(["abc", "bce", "fgh"]), frozenset(["abd", "bde", "fgh"])}
    random.seed(1)
    for rule in secrets.RULES:  # whatever matches holds the trigrams
        asked = trigrams.query(rule.expression)
        for text in ("my api_key=x", "PASSWD: 12", "AKIAZ", "gho_" + "a" * 36, "xoxb-1234567890", "0" * 32):
            if re.search(rule.expression, text):
                assert any(all(t in text.lower() for t in a) for a in asked)


MODEL = os.environ.get("SENTENCEPIECE_MODEL", fst.MODEL)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_sentencepiece_equals_library(spark, sf_dir):
    import sentencepiece

    random.seed(2)
    texts = [r[0] for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' limit 60").fetchall()]
    texts += ["", "  ", " a", "a  b   c", "\n\n x", "日本語 ünï 🙂\t\x01", "a" * 300, " " * 50 + "x", "w" * 20_000]
    texts += ["".join(random.choices("  aeionrst\nθ🙂ab=-*0019", k=random.randrange(60))) for _ in range(300)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    rows = {r.doc_id: r for r in fst.decode(fst.encode(df, MODEL), MODEL).collect()}
    assert [rows[i].ids for i in range(len(texts))] == library.encode(texts)
    assert [rows[i].decoded for i in range(len(texts))] == texts
    assert rows[len(texts)].ids == [] and rows[len(texts)].decoded == ""
    assert fst.encode(df.limit(0), MODEL).count() == 0


def test_unigram_path_is_the_cheapest():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aab", "▁ab"]
    scores = [0.0, -2.0, -1.5, -1.7, -2.1, -2.4, -1.9, -2.6, -3.3]
    machine = fst.Machine(fst.Model(pieces, scores, [2] + [1] * 8, bpe=False))
    random.seed(6)

    def cheapest(s):
        if not s:
            return 0.0
        return min(cheapest(s[len(p) :]) - w for p, w in zip(pieces[1:], scores[1:]) if s.startswith(p))

    for _ in range(100):
        text = "".join(random.choices("ab ", k=random.randrange(1, 9)))
        ids = machine.encode(text)
        assert machine.decode(ids) == text
        assert -sum(scores[i] for i in ids) == pytest.approx(cheapest("▁" + text.replace(" ", "▁")))


def test_normaliser_trims():
    machine = fst.Machine(fst.Model(["<unk>", "▁", "a", "▁a", "b"], [0.0, -1.0, -1.0, -1.5, -1.0], [2] + [1] * 4, bpe=False, trim=True))
    for text, marked in (("  a  b ", "▁a▁b"), ("a", "▁a"), ("   ", ""), ("a \n b", "▁a▁\n▁b"), ("", "")):
        assert machine.normaliser.compose(text)[0] == marked
        whole = [x for x in machine.path(marked)] if marked else []
        assert machine.encode(text) == whole


def test_unknown_characters_without_bytes():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -1.5, 1), ("▁a", -1.9, 1), ("ab", -2.5, 1), ("b", 1.0, 1)]
    proto = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in pieces:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name, proto.normalizer_spec.remove_extra_whitespaces = "identity", False
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    machine = fst.Machine(fst.Model(*map(list, zip(*pieces)), bpe=False, byte_fallback=False))
    random.seed(12)
    for _ in range(300):
        text = "".join(random.choices("ab xyé", k=random.randrange(10)))
        assert machine.encode(text) == library.encode(text), text


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_models_in_turn(spark):
    """Workers keep machines by the content of their models."""
    whole = fst.Model.read(MODEL)
    texts = ["the cat", "Straße 12", "", "internationalisation of words"]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(2)
    want = {}
    for k in range(12):
        few = [i for i, kind in enumerate(whole.kinds) if kind != 1 or len(whole.pieces[i]) <= 1 + k % 4]
        model = fst.Model(*([x[i] for i in few] for x in (whole.pieces, whole.scores, whole.kinds)), bpe=True)
        got = {r.doc_id: r.ids for r in fst.encode(df, model).collect()}
        plain = fst.Machine(model)
        assert got == {i: plain.encode(t) for i, t in enumerate(texts)}
        assert want.setdefault(k % 4, got) == got
    assert len({str(x) for x in want.values()}) == 4


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_sentencepiece_query(spark, tmp_path):
    import sentencepiece

    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "ünï 🙂\n\n", None, None), (2, None, "y", 2), (3, "", "y", 2), (4, "▁ mark", "y", 3)]
    rows += [(5, "word " * 250_000, "z", 4), (6, "long" * 200_000, "z", 5)] + [(10 + i, f"{i} " * (i % 90), "w", 6) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        back = library.decode(ids)
        want.append((doc_id, ids, len(ids), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
    got = [tuple(r) for r in fst.op6_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(not r[4] for r in got) == 1


def test_chat(spark, sf_dir):
    assert differences(chat.op8_chat(spark, sf_dir), chat.OP8_SQL, connect(sf_dir)) is None
    rows = [(1, 0, "a\n\\b<|", "x<\\|y<|im_end|>\n<|im_start|>\\<\\\\|", "z"), (1, 1, "assistant", None, "z")]
    rows += [(1, 1, "assistant", "é🙂", "z"), (None, None, None, None, "z"), (2, 5, "user", "t" * 100_000, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    said = "a\n\\b<|\nx<\\|y<|im_end|>\n<|im_start|>\\<\\\\|\nassistant\n\nassistant\né🙂\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].formatted_chars) == (3, 2, 1, 100_028)
    assert got[1].loss_sha256 == hashlib.sha256("é🙂".encode()).hexdigest()
    parts = sorted(r for r in chat.formatted(df).collect() if r.conv_id == 1)
    assert "".join(p.text for p in parts).count("<|im_start|>") == 3
    assert chat.digests(df.limit(0)).count() == 0


def test_escapes():
    random.seed(8)
    for _ in range(500):
        text = "".join(random.choices("<|\\\nna", k=random.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unline(chat.line(text)) == text and "\n" not in chat.line(text)


def test_templates():
    def render(source, **names):
        return "".join(p for p, _ in templates.compiled(source, chat.FILTERS)(names))

    assert render("{% for m in x %}{% if loop.first %}[{% elif m.a == 'b' and not m.c %}B{% else %}-{% endif %}{% endfor %}",
                  x=iter([{}, {"a": "b"}, {"a": "b", "c": 1}])) == "[B-"
    folded = templates.fold(templates.parse("a{{ 'b' + 1 | trim }}{% if 1 == 2 %}x{% else %}c{% endif %}", chat.FILTERS), chat.FILTERS)
    assert folded == [templates.Text([templates.Const("ab1c")])]
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{{ x | nothing }}", "{% for a in b %}", "{% import os %}", "{{ 'a }}"):
        with pytest.raises(templates.TemplateError):
            templates.compiled(bad, chat.FILTERS)
    with pytest.raises(templates.TemplateError):
        render("{{ os }}")


def test_mixing(spark, sf_dir):
    assert differences(mixing.op3_mixing(spark, sf_dir), mixing.OP3_SQL, connect(sf_dir)) is None
    rows = [(i, "w " * (i % 50), None if i % 7 == 0 else f"s{i % 4}", "x") for i in range(400)]
    rows += [(900, None, "s1", "x"), (901, "", None, "x"), (None, "a b", "s2", "x"), (7, "c d", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 2 * r.size for r in mixed)
    total = sum(r.size for r in mixed)
    by = {r.source: (r.target, r.source_size) for r in mixed}
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in by.items():
        assert target <= 2 * size
        assert abs(sum(r.taken for r in mixed if r.source == source) - target) <= 25
    assert all(0 <= p <= 1 for r in mixed for p in r.positions)
    order = mixing.training_order(df, mixing.mix(df))
    assert order.columns == df.columns and order.count() == sum(len(r.positions) for r in mixed)
    assert mixing.mix(df.limit(0)).count() == 0


def missed(mixed):
    """By source: the share of its target that is open, and whether no copy left over would fit into it."""
    by = {}
    for r in mixed:
        by.setdefault(r.source, []).append(r)
    out = {}
    for source, rows in by.items():
        target = rows[0].target
        gap = target - sum(r.taken for r in rows)
        left = [r.size for r in rows if r.size and len(r.positions) < mixing.REPEATS]
        out[source] = (gap / max(1, target), not left or min(left) > gap)
        assert gap >= 0
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    mixed = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    misses = missed(mixed)
    assert all(share < 0.02 or tight for share, tight in misses.values()), misses
    assert sorted(share for share, _ in misses.values())[len(misses) // 2] < 0.02


def test_fill_takes_one_size_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, "w " * (40 if i == 3 else 2), "b") for i in range(200)] + [(i, "w " * 900, "a") for i in range(300, 302)]
    rows += [(400 + i, "w " * (5 + i % 3), "c") for i in range(100)] + [(600, None, "b"), (601, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    first, again = mixing.mix(df).collect(), mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert all(tight or share < 0.02 for share, tight in missed(first).values())
    assert all(len(r.positions) <= 2 and r.taken == r.size * len(r.positions) for r in first) and len(first) == len(rows)


def test_training_order_by_row(spark):
    random.seed(13)
    rows = [(random.choice([None, None, 7, i]), f"{i} " * random.randrange(1, 9), random.choice(["a", "b", "c", None])) for i in range(300)]
    rows += rows[:20] + rows[:5] + [(None, None, None), (7, None, "a"), (None, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(df)
    taken = {}
    for r in mixed.collect():
        taken.setdefault((r._row, r._row2), []).extend(r.positions)
    by = {(r._row, r._row2): tuple(r)[:3] for r in df.select("*", *row_keys(df)).collect()}
    want = sorted((at, by[key]) for key, spots in taken.items() for at in spots if by[key][0] is not None)
    got = [tuple(r) for r in mixing.training_order(df, mixed).collect()]
    everything = sorted((by[key] for key, spots in taken.items() for _ in spots), key=str)
    assert sorted(got, key=str) == everything
    at = {}
    for spot, row in want:
        at.setdefault(row, []).append(spot)
    spots = [at[r].pop(0) for r in got if r[0] is not None]
    assert spots == sorted(spots)
    words = {}
    for _, text, source in got:
        words[source] = words.get(source, 0) + len((text or "").split())
    for source, target in {r.source: r.target for r in mixed.collect()}.items():
        assert abs(words.get(source, 0) - target) <= 4


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for k, knots in enumerate(mixing.SCHEDULES):
        t0, w0 = zip(*knots)
        grid = np.linspace(0, 1, 2001)
        area = np.concatenate([[0], np.cumsum(np.diff(grid) * (lambda w: (w[1:] + w[:-1]) / 2)(np.interp(grid, t0, w0)))])
        rows = spark.range(11).select(mixing.position(F.col("id") / 10, F.lit(k)).alias("t")).collect()
        assert [r.t for r in rows] == pytest.approx(np.interp(np.linspace(0, area[-1], 11), area, grid).tolist(), abs=1e-3)


def test_em_finds_accuracies():
    rng = np.random.default_rng(7)
    good = rng.random(5000) < 0.8
    right = np.array([0.95, 0.8, 0.7, 0.9])
    cast = np.where(rng.random((5000, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    cast[rng.random((5000, 4)) < 0.2] = 0
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts)
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert model.on_good == pytest.approx(right.tolist(), abs=0.08)
    assert ((model.posterior(cast) > 0.5) == good).mean() > 0.93
    assert quality.fit_labels(np.zeros((0, 4)), np.zeros(0)).prior == 0.5


def test_quality_against_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs)
    scored = quality.score(docs, model).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r._keep == bool(r.quality) for r in scored]) > 0.97
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "word " * 50_000, 5)], "doc_id long, text string, keep int")
    assert [(r._keep, r._score) for r in quality.score(odd, model).orderBy("doc_id").collect()[:1]] == [(False, 0.0)]
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(docs.limit(0)).count() == 0


def quality_plainly(texts, train_rows):
    """Row by row: votes, EM over rows instead of combinations, training texts by hash, dense scoring."""
    data = [(t or "").encode() for t in texts]
    cast = np.array([quality.votes(t) for t in data], float)
    posterior = (model := quality.fit_labels(cast, np.ones(len(data)))).posterior(cast)
    share = min(1.0, 0.9 * train_rows / len(data))
    taught = {}
    for t, v, p in zip(data, cast, posterior):
        h = xxhash.xxh64_intdigest(b"train", seed=xxhash.xxh64_intdigest(t, seed=42))
        h -= (h >> 63) << 64
        if h / 2.0**64 + 0.5 <= share and v.any() and not 0.2 <= p <= 0.8:
            taught[h] = *quality.features(t), p
    rows = [taught[h] for h in sorted(taught)[:train_rows]]
    weights = quality.fit_scorer([(i, v.astype(np.float32).astype(float)) for i, v, _ in rows], np.array([r[2] for r in rows]))
    scores = []
    for t in data:
        ids, values = quality.features(t)
        scores.append(1 / (1 + np.exp(-(weights[ids] @ values + weights[-1]))) if t.split() else 0.0)
    return model, posterior, scores


@pytest.mark.parametrize("train_rows", [quality.TRAIN_ROWS, 500])
def test_quality_equals_plain_version(spark, tmp_path, monkeypatch, train_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, "x" * 1_000_000), (-5, "word " * 100_000), (None, "A good text. It ends.")]
    odd += [(7, r.text) for r in docs.where("doc_id in (7, 8)").collect()] * 2
    docs.union(spark.createDataFrame(odd, docs.schema)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(quality.fit, "__defaults__", (train_rows,))
    got = quality.op2_quality(spark, str(tmp_path)).orderBy("doc_id", "score").collect()
    table = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    _, posterior, scores = quality_plainly([r.text for r in table], train_rows)
    want = sorted(zip([r.doc_id for r in table], scores, posterior), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.score for r in got] == pytest.approx([w[1] for w in want], abs=1e-4)
    assert [r.posterior for r in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert all(r.keep == (w[1] >= 0.5) for r, w in zip(got, want) if abs(w[1] - 0.5) > 1e-4)


def test_quality_with_clashing_names(spark):
    rows = [(i, "Some good words here, and more. " * 3 if i % 2 else "## $$ @@ | | | ##", i, "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _score int, _keep string, `a.b` int")
    kept = quality.keep_good(df)
    assert kept.schema == df.schema and kept.collect() == df.where("doc_id % 2 = 1").collect()
    scored = quality.score(df, quality.fit(df))
    assert scored.columns == ["doc_id", "text", "a.b", *quality.FOUND] and scored.schema["_score"].dataType.typeName() == "double"


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns, name
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r.ids is not None for r in out)
