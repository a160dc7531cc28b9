"""One row per conversation, whole or per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.numbers import ratio
from tracefold.functions.timeparts import minutes, second_of
from tracefold.operators.rollup import Kept, Rollup
from tracefold.operators.usage import messages, with_day

CONVERSATION = ("APP_ID", "CONVERSATION_ID")
CONVERSATION_DAY = (*CONVERSATION, "EVENT_DATE")

_LAST = ("USER_ID", "SESSION_ID", "DEVICE", "OS", "BROWSER", "LOCALE", "LOCATION", "CHANNEL_ID")
_SPREADS = {
    "NUM_WORDS_PROMPT": "NUM_WORDS_PROMPT",
    "NUM_WORDS_RESPONSE": "NUM_WORDS_RESPONSE",
    "TIME_LATENCY": "LATENCY",
    "TOKENS_SPENT_PROMPT": "TOKENS_SPENT_PROMPT",
    "TOKENS_SPENT_RESPONSE": "TOKENS_SPENT_RESPONSE",
    "COST": "COST",
}
_SETS = ("LANG_PROMPT", "LANG_RESPONSE", "SENTIMENT_PROMPT", "SENTIMENT_RESPONSE")
_PEAKS = tuple(
    f"SENTIMENT_{side}_{mood}" for side in ("PROMPT", "RESPONSE") for mood in ("POSITIVE", "NEGATIVE", "NEUTRAL")
)


def _priced(traces_processed: DataFrame, apps: DataFrame) -> DataFrame:
    """Messages of known apps with their cost.

    The smallest and largest cost of a conversation need the cost of every
    message, so apps are joined to the rows here. No broadcast is forced: Spark
    broadcasts apps while their size allows it and otherwise splits big apps
    with its skew join.
    """
    costs = apps.select(F.col("id").alias("APP_ID"), "inputCost", "outputCost")
    cost = F.col("TOKENS_SPENT_PROMPT") * F.col("inputCost") + F.col("TOKENS_SPENT_RESPONSE") * F.col("outputCost")
    return messages(traces_processed).join(costs, "APP_ID").withColumn("COST", cost)


def _at(*columns: str) -> str:
    """Rows ordered by time, then id, then the wanted values."""
    values = ", ".join(columns)
    return f"struct(START_TIMESTAMP, INTERACTION_ID, {values})"


CONVERSATIONS = Rollup(
    "conversations",
    CONVERSATION_DAY,
    {
        "n": ("count", "1"),
        "min_start": ("min", "START_TIMESTAMP"),
        "max_end": ("max", "END_TIMESTAMP"),
        "last": ("last", _at(*_LAST)),
        "first": ("first", _at("INPUT", "OUTPUT")),
        **{f"{out}_{kind}": (kind, column) for out, column in _SPREADS.items() for kind in ("sum", "min", "max")},
        **{name: ("set", name) for name in _SETS},
        **{name: ("max", name) for name in _PEAKS},
        "readability": ("sum", "READABILITY_RESPONSE"),
    },
    _priced,
)


def finish_conversations(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readable columns from merged conversation states."""
    span = F.col("max_end") - F.col("min_start")
    gap = F.when(
        F.col("n") > 1, span.cast("double") / F.lit(1000) / (F.col("n") - 1)
    ).otherwise(0.0)
    spreads = []
    for out in _SPREADS:
        total = f"{out}_SUM" if out == "TIME_LATENCY" else f"{out}_TOTAL"
        spreads += [
            F.col(f"{out}_sum").alias(total),
            ratio(f"{out}_sum", "n").alias(f"{out}_AVG"),
            F.col(f"{out}_min").alias(f"{out}_MIN"),
            F.col(f"{out}_max").alias(f"{out}_MAX"),
        ]
    return state.select(
        *keys,
        F.col("min_start").alias("FIRST_MESSAGE_TIMESTAMP"),
        F.col("max_end").alias("LAST_MESSAGE_TIMESTAMP"),
        *[F.col(f"last.{name}").alias(name) for name in _LAST],
        F.col("n").alias("DIALOGUE_VOLUME"),
        (F.col("n") == 1).cast("int").alias("ONE_INTERACTION"),
        minutes(span).alias("TIME_TOTAL"),
        gap.alias("TIME_BETWEEN_INTERACTIONS"),
        *spreads,
        *_SETS,
        *[F.col(name).alias(f"{name}_MAX") for name in _PEAKS],
        ratio("readability", "n").alias("READABILITY_RESPONSE"),
        F.col("first.INPUT").alias("FIRST_INPUT"),
        F.col("first.OUTPUT").alias("FIRST_OUTPUT"),
        second_of("min_start").alias("FIRST_MESSAGE_TIME"),
        second_of("max_end").alias("LAST_MESSAGE_TIME"),
    )


def _classifier_rows(traces_processed: DataFrame, apps: DataFrame) -> DataFrame:
    known = apps.select(F.col("id").alias("APP_ID"))
    return messages(traces_processed).join(known, "APP_ID", "left_semi")


#: The classifier list of a conversation at any length: one row per message, to
#: be read in (START_TIMESTAMP, INTERACTION_ID) order.
CLASSIFIERS = Kept(
    "conversation_classifiers",
    (*CONVERSATION_DAY, "START_TIMESTAMP", "INTERACTION_ID"),
    ("OUTPUT_CLASSIFIERS",),
    _classifier_rows,
)


def conversation_classifiers(traces_processed: DataFrame, apps: DataFrame) -> DataFrame:
    """Classifier text of every message, in long form (see `CLASSIFIERS`)."""
    return CLASSIFIERS.partial(traces_processed, apps)


def traces_conversations(traces_processed: DataFrame, apps: DataFrame) -> DataFrame:
    """Conversations per day; their classifier lists are `conversation_classifiers`."""
    return with_day(finish_conversations(CONVERSATIONS.partial(traces_processed, apps), CONVERSATION_DAY))


def traces_conversations_view(state: DataFrame) -> DataFrame:
    """Whole conversations from per-day states."""
    return finish_conversations(CONVERSATIONS.merge(state, CONVERSATION), CONVERSATION)
