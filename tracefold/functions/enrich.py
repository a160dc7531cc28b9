"""KPI columns of processed traces.

Word counts are exact. Every other default here is this library's own simple
choice, replaceable per column: readability is the Flesch reading ease,
language and sentiment go by small word lists, tokens are estimated from
length, and no classifier runs. All defaults are column expressions; a model
plugs in as a `pandas_udf` on the same two text columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.numbers import ratio

Kpi = Callable[[Column, Column], Column]

# Frequent function words per language, and polar words.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "in", "that", "it"),
    "es": ("el", "la", "los", "de", "que", "y", "es", "en"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "que"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "zu"),
}
POSITIVE_WORDS = ("good", "great", "thanks", "perfect", "excellent", "love", "happy", "helpful")
NEGATIVE_WORDS = ("bad", "wrong", "error", "terrible", "hate", "useless", "angry", "fail")


def num_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))


def num_tokens(text: Column) -> Column:
    """Estimate: one token per four characters, rounded up."""
    return F.ceil(F.char_length(text) / F.lit(4)).cast("int")


def readability(text: Column, words: Column) -> Column:
    """Flesch reading ease; 0 for text without words."""
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.regexp_count(text, F.lit(r"[aeiouyAEIOUY]+"))
    score = F.lit(206.835) - F.lit(1.015) * ratio(words, sentences) - F.lit(84.6) * ratio(syllables, words)
    return F.coalesce(score, F.lit(0.0))


_LISTS = {**FUNCTION_WORDS, "positive": POSITIVE_WORDS, "negative": NEGATIVE_WORDS}


# Characters that end a word besides the space.
_BREAKS = ".,;:!?()[]{}<>\"'/\\|\t\n\r"


def listed_words(text: Column) -> Column:
    """The text's words that are on any list, in one pass over the text."""
    every = sorted({word for words in _LISTS.values() for word in words})
    spaced = F.translate(F.lower(text), _BREAKS, " " * len(_BREAKS))
    return F.filter(F.split(spaced, " "), lambda word: word.isin(*every))


def word_counts(hits: Column) -> Column:
    """Listed words per language and polarity."""

    def counted(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(hits, lambda word: word.isin(*words)))

    return F.struct(*[counted(words).alias(name) for name, words in _LISTS.items()])


def language(counts: Column) -> Column:
    """Language with most function words; '' when there are none."""
    best = F.greatest(*[F.struct(counts[code].alias("n"), F.lit(code).alias("code")) for code in FUNCTION_WORDS])
    return F.when(best["n"] > 0, best["code"]).otherwise("")


def sentiment(counts: Column) -> dict[str, Column]:
    """Label and scores by column suffix: shares of the polar words."""
    positive, negative = counts["positive"], counts["negative"]
    total = positive + negative
    share = lambda part: F.coalesce(ratio(part, total), F.lit(0.0))
    return {
        "": F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral"),
        "_POSITIVE": share(positive),
        "_NEGATIVE": share(negative),
        "_NEUTRAL": F.when(total == 0, 1.0).otherwise(0.0),
    }


def default_kpis() -> dict[str, Column]:
    """Columns over `input`, `output` and the staged counts of both."""
    prompt, response = F.col("input"), F.col("output")
    words = F.col("_words")
    kpis = {
        "OUTPUT_CLASSIFIERS": F.lit(""),
        "TOKENS_SPENT_PROMPT": num_tokens(prompt),
        "TOKENS_SPENT_RESPONSE": num_tokens(response),
        "READABILITY_RESPONSE": readability(response, words),
        "NUM_WORDS_PROMPT": num_words(prompt),
        "NUM_WORDS_RESPONSE": words,
    }
    for side in ("PROMPT", "RESPONSE"):
        counts = F.col(f"_{side}")
        kpis[f"LANG_{side}"] = language(counts)
        kpis |= {f"SENTIMENT_{side}{suffix}": value for suffix, value in sentiment(counts).items()}
    return kpis


def enrich_traces(traces: DataFrame, kpis: dict[str, Kpi] | None = None) -> DataFrame:
    """Raw traces to processed traces.

    `kpis` replaces single columns: name -> function of (prompt, response).
    """
    columns = default_kpis()
    columns |= {name: make(F.col("input"), F.col("output")) for name, make in (kpis or {}).items()}
    staged = traces.withColumns({
        "_words": num_words(F.col("output")),
        "_prompt_hits": listed_words(F.col("input")),
        "_response_hits": listed_words(F.col("output")),
    }).withColumns({
        "_PROMPT": word_counts(F.col("_prompt_hits")),
        "_RESPONSE": word_counts(F.col("_response_hits")),
    })
    base = [F.col(name).alias(name.upper()) for name in traces.columns]
    return staged.select(*base, *[value.alias(name) for name, value in columns.items()])
