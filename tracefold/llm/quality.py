"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The
number of documents per combination of votes is all that expectation-maximisation
needs: it estimates each labeller's accuracy on good and on bad documents and the
posterior of every combination. Documents with their posterior as soft label then
train a linear scorer over hashed word and word-shape features, which decides.

The vote table has at most 3^7 rows whatever the corpus, and EM runs on it in the
driver. The scorer is fitted on at most TRAIN_ROWS distinct texts, the bound the
contract allows: those of smallest hash among the texts that the labellers are sure
of, so reruns and other layouts of the table train on the same ones. Votes,
posteriors and scores cover all rows.

A document without words (NULL, empty, blank) gets no votes and score 0 and is
rejected. Each row is judged by its text alone, so repeated rows and ids get equal
decisions. Other columns pass through `keep_good` unchanged, whatever their names;
`score` replaces given columns that have the names of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LABELLERS = ("symbols", "capitals", "variety", "stutter", "marks", "bars", "sentences")
TRAIN_ROWS = 6_000
BUCKETS = 1 << 13
_CACHE = 100_000
FOUND = ("_posterior", "_score", "_keep")

_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_CAPITALS = bytes(range(65, 91))
_PLAIN = _ASCII_LETTERS + bytes(range(48, 58)) + b" \t\n\r\x0b\x0c.,;:'\"-?()" + bytes(range(128, 256))


def votes(text: bytes) -> tuple[int, ...]:
    """One vote of +1 (good), -1 (bad) or 0 (none) per labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS)
    size = len(text)
    letters = size - len(text.translate(None, _ASCII_LETTERS))
    odd = len(text.translate(None, _PLAIN)) / size
    capitals = (size - len(text.translate(None, _CAPITALS))) / max(1, letters)
    variety = len(set(words)) / n ** 0.85  # a corpus has fewer new words the longer a text gets
    stutter = sum(map(eq, words, words[1:])) / n
    marked = sum(text.count(m) for m in (b"!", b"&", b"$", b"%", b"*", b"#", b"@", b"^", b"~")) / n
    bars = (text.count(b"|") + text.count(b"\t")) / n
    stops = sum(text.count(m) for m in (b". ", b".\n", b"? ", b"! ")) + text.rstrip().endswith((b".", b"?", b"!"))
    per_stop = n / max(1, stops)

    def vote(value: float, good: float, bad: float) -> int:
        return 1 if value <= good else -1 if value >= bad else 0

    return (
        vote(odd, 0.02, 0.08),
        0 if letters < 20 else vote(capitals, 0.15, 0.4),
        0 if n < 20 else vote(-variety, -0.8, -0.5),
        0 if n < 10 else vote(stutter, 0.03, 0.15),
        vote(marked, 0.05, 0.3),
        vote(bars, 0.02, 0.2),
        0 if n < 12 or n / 40 > stops > 0 else vote(per_stop, 40, 60),
    )


@dataclass
class LabelModel:
    """P(good), and per labeller P(votes good | good) and P(votes bad | bad) where it votes."""

    prior: float
    on_good: list[float]
    on_bad: list[float]

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) of vote rows (n x labellers)."""
        up, down = pattern > 0, pattern < 0
        good, bad = np.array(self.on_good), np.array(self.on_bad)
        log_good = np.log(self.prior) + up @ np.log(good) + down @ np.log(1 - good)
        log_bad = np.log(1 - self.prior) + up @ np.log(1 - bad) + down @ np.log(bad)
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over vote combinations and their numbers of documents.

    Starts from calling a document bad that has a bad vote and a vote sum of 2 or less. Documents no labeller votes on say nothing.
    """
    patterns, counts = np.asarray(patterns, float), np.asarray(counts, float)
    m = patterns.shape[1]
    told = (patterns != 0).any(axis=1) if len(patterns) else np.zeros(0, bool)
    patterns, counts = patterns[told], counts[told]
    if not len(patterns):
        return LabelModel(0.5, [0.5] * m, [0.5] * m)
    good = np.where((patterns < 0).any(axis=1) & (patterns.sum(axis=1) <= 2), 0.2, 0.95)
    up, down = patterns > 0, patterns < 0
    for _ in range(rounds):
        g, b = good * counts, (1 - good) * counts
        rates = [
            (w @ hit + 0.8 * smooth * 10) / (w @ (up | down) + smooth * 10) for w, hit in ((g, up), (b, down))
        ]
        prior = float(np.clip(g.sum() / counts.sum(), 0.01, 0.99))
        model = LabelModel(prior, *(np.clip(r, 1e-3, 1 - 1e-3).tolist() for r in rates))
        now = model.posterior(patterns)
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


_CLASSES = ((re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"0"))


def word_features(word: bytes) -> list[int]:
    """Buckets of a word: itself in lower case, its shape, its last two characters."""
    shape = word
    for pattern, mark in _CLASSES:
        shape = pattern.sub(mark, shape)
    return [zlib.crc32(x) % BUCKETS for x in (b"w" + word.lower(), b"s" + shape, b"e" + word[-2:])]


_REPEAT = zlib.crc32(b"r") % BUCKETS


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and their mean number per word."""
    words = text.split()
    counts: dict[int, float] = {}
    for word in words:
        for f in word_features(word):
            counts[f] = counts.get(f, 0) + 1
    counts[_REPEAT] = counts.get(_REPEAT, 0) + sum(map(eq, words, words[1:]))
    ids = np.fromiter(counts, np.int64, len(counts))
    return ids, np.fromiter(counts.values(), float, len(counts)) / max(1, len(words))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (bias last) of a logistic scorer, both classes weighing the same; full-batch Adam."""
    weights = np.zeros(BUCKETS + 1)
    if not len(rows):
        return weights
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    ids, values = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    balance = soft / max(soft.sum(), 1) + (1 - soft) / max((1 - soft).sum(), 1)
    balance /= balance.sum()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        z = np.bincount(at, weights[ids] * values, len(rows)) + weights[-1]
        off = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft)
        grad = np.append(np.bincount(ids, off[at] * values, BUCKETS), off.sum()) + 1e-6 * weights
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return weights


class Scorer:
    """Scores texts with fitted weights; remembers the sum of a word's weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()
        self.known: dict[bytes, float] = {}

    def __call__(self, text: bytes) -> float:
        """P(good); 0 for a text without words."""
        words = text.split()
        if not words:
            return 0.0
        known, weights = self.known, self.weights
        if len(known) > _CACHE:
            known.clear()
        total = 0.0
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = sum(weights[f] for f in word_features(word))
            total += value
        total += weights[_REPEAT] * sum(map(eq, words, words[1:]))
        return float(1 / (1 + np.exp(-np.clip(total / len(words) + weights[-1], -30, 30))))


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    threshold: float = 0.5


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Estimate the labellers from all of `docs` and train the scorer."""

    def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [list(votes(t.as_py())) for t in batch.column(0)]
            yield pa.record_batch([pa.array(cast, pa.list_(pa.int8()))], ["votes"])

    voted = _texts(docs).mapInArrow(vote_rows, "votes array<tinyint>").groupBy("votes").count().collect()
    patterns = np.array([r[0] for r in voted], float).reshape(-1, len(LABELLERS))
    counts = np.array([r[1] for r in voted], float)
    model = fit_labels(patterns, counts)

    def learn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, h in zip(batch.column(0), batch.column(1)):
                pattern = np.array([votes(t.as_py())], float)
                good = float(model.posterior(pattern)[0])
                # Only combinations the labellers are sure of teach.
                if pattern.any() and not 0.2 <= good <= 0.8:
                    ids, values = features(t.as_py())
                    row = ids.astype(np.int16).tobytes(), values.astype(np.float32).tobytes(), good, h.as_py()
                    yield pa.record_batch([pa.array([x]) for x in row], ["ids", "values", "good", "h"])

    share = min(1.0, 0.9 * train_rows / max(1.0, counts.sum()))
    hashed = _texts(docs).withColumn("h", F.xxhash64("t", F.lit("train")))
    hashed = hashed.where(F.col("h") / F.lit(2.0**64) + 0.5 <= share)
    rows = hashed.mapInArrow(learn_rows, "ids binary, values binary, good double, h long")
    sample = rows.dropDuplicates(["h"]).orderBy("h").limit(train_rows).toArrow()
    hashed_rows = [
        (np.frombuffer(i, np.int16).astype(np.int64), np.frombuffer(v, np.float32).astype(float))
        for i, v in zip(sample["ids"].to_pylist(), sample["values"].to_pylist())
    ]
    return Classifier(model, fit_scorer(hashed_rows, sample["good"].to_numpy()))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of `docs` with `_posterior` (of their votes), `_score` (of the scorer) and `_keep`."""
    kept = [c for c in docs.columns if c not in FOUND]
    return _scored(docs, model).select(*[F.col(f"row.`{c}`") for c in kept], *FOUND)


def _scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(row, _posterior, _score, _keep), whole rows of `docs` as structs."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = docs.withColumns({"_posterior": F.lit(0.0), "_score": F.lit(0.0), "_keep": F.lit(True)}).schema
    at = docs.schema["row"].dataType.names.index("text")
    labels, weights, threshold = model.labels, model.weights, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(0).field(at)]
            cast = np.array([votes(t) for t in texts], float).reshape(-1, len(LABELLERS))
            scores = np.array([scorer(t) for t in texts], float)
            found = [pa.array(labels.posterior(cast)), pa.array(scores), pa.array(scores >= threshold)]
            yield pa.record_batch([batch.column(0), *found], ["row", *FOUND])

    return docs.mapInArrow(run, out)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that a classifier fitted on them keeps."""
    return _scored(docs, fit(docs)).where("_keep").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select(
        "doc_id", F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_keep").alias("keep")
    )
