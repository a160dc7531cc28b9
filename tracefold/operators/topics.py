"""Figures per classifier topic, from the nested classifier JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import json
from tracefold.functions.numbers import percent, ratio
from tracefold.functions.timeparts import minutes, second_of
from tracefold.operators.rollup import Rollup
from tracefold.operators.usage import messages

LABEL = ("EVENT_DATE", "APP_ID", "CLASSIFIER_ID", "CATEGORY_ID", "LABEL_ID")
TOPIC = (*LABEL, "SCORE")


def classifier_labels(traces_processed: DataFrame) -> DataFrame:
    """One row per message and classifier label.

    Messages without a classifier, and classifiers without a label, give no
    row. Word and token counts repeat on every label of a message.
    """
    labelled = messages(traces_processed).filter(F.col("OUTPUT_CLASSIFIERS") != "")
    items = labelled.withColumn(
        "item", F.explode(json.json_array(json.parse("OUTPUT_CLASSIFIERS")))
    )
    labels = items.withColumn("label", F.explode(json.json_array("item", "$.LABEL")))
    return labels.withColumns({
        "CLASSIFIER_ID": json.json_int("item", "$.ID"),
        "CATEGORY_ID": json.json_str("item", "$.CATEGORY"),
        "LABEL_ID": json.json_str("label"),
        "SCORE": json.json_int("item", "$.SCORE"),
    }).drop("item", "label")


def _flag(condition: str) -> tuple[str, str]:
    return ("max", f"cast({condition} as int)")


TOPIC_DAYS = Rollup(
    "topic_days",
    TOPIC,
    {
        "n": ("count", "1"),
        "lang_prompt": ("count", "LANG_PROMPT"),
        "lang_response": ("count", "LANG_RESPONSE"),
        "words_prompt": ("sum", "NUM_WORDS_PROMPT"),
        "words_response": ("sum", "NUM_WORDS_RESPONSE"),
        "tokens_prompt": ("sum", "TOKENS_SPENT_PROMPT"),
        "tokens_response": ("sum", "TOKENS_SPENT_RESPONSE"),
        "readability": ("sum", "READABILITY_RESPONSE"),
        "latency": ("sum", "LATENCY"),
        "min_start": ("min", "START_TIMESTAMP"),
        "max_end": ("max", "END_TIMESTAMP"),
    },
    classifier_labels,
)

# Any score above zero counts here; daily usage asks for more than one half.
TOPIC_MESSAGES = Rollup(
    "topic_messages",
    (*TOPIC, "INTERACTION_ID"),
    {
        "prompt_positive": _flag("SENTIMENT_PROMPT_POSITIVE > 0"),
        "prompt_negative": _flag("SENTIMENT_PROMPT_NEGATIVE > 0"),
        "response_positive": _flag("SENTIMENT_RESPONSE_POSITIVE > 0"),
        "response_negative": _flag("SENTIMENT_RESPONSE_NEGATIVE > 0"),
        "feedback_positive": _flag("FEEDBACK_TAG = 'positive'"),
        "feedback_negative": _flag("FEEDBACK_TAG = 'negative'"),
    },
    classifier_labels,
)
_FLAGS = tuple(TOPIC_MESSAGES.measures)

TOPIC_CONVERSATIONS = Rollup(
    "topic_conversations",
    (*TOPIC, "CONVERSATION_ID"),
    {
        "n": ("count", "1"),
        "min_start": ("min", "START_TIMESTAMP"),
        "max_end": ("max", "END_TIMESTAMP"),
    },
    classifier_labels,
)

TOPIC_ROLLUPS = (TOPIC_DAYS, TOPIC_MESSAGES, TOPIC_CONVERSATIONS)


def conversation_duration(topic_conversations: DataFrame) -> DataFrame:
    """Adds the length of each conversation, over its labelled messages.

    An aggregate and a join, not a window: the aggregate combines on the map side
    and the join can be split, so a conversation of very many topics and days (a
    blank id, say) does not gather in one task. The join is hinted, as there are as
    many lengths as conversations and Spark, which takes them for smaller than the
    files, would send all of them through the driver.
    """
    whole = topic_conversations.groupBy(F.col("APP_ID").alias("_app"), F.col("CONVERSATION_ID").alias("_id")).agg(
        (F.max("max_end") - F.min("min_start")).alias("duration_ms")
    )
    its_own = F.col("APP_ID").eqNullSafe(F.col("_app")) & F.col("CONVERSATION_ID").eqNullSafe(F.col("_id"))
    return topic_conversations.join(whole.hint("merge"), its_own).drop("_app", "_id")


def _topic_sums(days: DataFrame, per_message: DataFrame, per_conversation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per topic with its counts.

    Durations are added in whole milliseconds, weighted by rows, so their
    average does not depend on the order of addition.
    """
    counted = per_message.groupBy(*keys).agg(
        F.count("*").alias("messages"), *[F.sum(flag).alias(flag) for flag in _FLAGS]
    )
    timed = (
        conversation_duration(per_conversation)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("conversations"),
            F.sum(F.col("duration_ms") * F.col("n")).alias("duration_ms"),
        )
    )
    joined = days.join(counted, list(keys)).join(timed, list(keys))
    return joined.withColumn("duration", minutes(F.col("duration_ms").cast("double") / F.col("n")))


def finish_topics(days: DataFrame, per_message: DataFrame, per_conversation: DataFrame) -> DataFrame:
    sums = _topic_sums(days, per_message, per_conversation, TOPIC)
    return sums.select(
        F.col("EVENT_DATE").alias("day"),
        *TOPIC[1:],
        F.col("conversations").alias("conversations_count"),
        F.col("messages").alias("messages_count"),
        *[
            F.col(f"{side}_{mood}").alias(f"sentiment_{side}_{mood}")
            for side in ("prompt", "response")
            for mood in ("positive", "negative")
        ],
        F.col("lang_prompt").alias("lang_prompt_count"),
        F.col("lang_response").alias("lang_response_count"),
        F.col("words_prompt").alias("num_words_prompt"),
        F.col("words_response").alias("num_words_response"),
        F.col("tokens_prompt").alias("tokens_spent_prompt"),
        F.col("tokens_response").alias("tokens_spent_response"),
        ratio("readability", "n").alias("readability_response"),
        ratio("latency", "n").alias("time_latency"),
        second_of("min_start").alias("min_start_time"),
        F.col("max_end").alias("max_end_time"),
        F.col("feedback_positive").alias("feedback_positive_count"),
        F.col("feedback_negative").alias("feedback_negative_count"),
        F.col("duration").alias("conversation_duration"),
    )


def kpi_topics_1d(traces_processed: DataFrame) -> DataFrame:
    """Daily figures per app, classifier, category, label and score."""
    return finish_topics(*[rollup.partial(traces_processed) for rollup in TOPIC_ROLLUPS])


def kpi_topics_1d_view(
    days: DataFrame,
    per_message: DataFrame,
    per_conversation: DataFrame,
    apps: DataFrame,
    denominator: str = "messages",
) -> DataFrame:
    """Daily figures per label over all scores, with costs and rates.

    Takes the three topic states. `denominator='polarity'` relates a sentiment
    to the messages that carry either polarity instead of to all messages.
    """
    if denominator not in ("messages", "polarity"):
        raise ValueError(f"unknown denominator {denominator!r}")
    sums = _topic_sums(
        TOPIC_DAYS.merge(days, LABEL),
        TOPIC_MESSAGES.merge(per_message, (*LABEL, "INTERACTION_ID")),
        TOPIC_CONVERSATIONS.merge(per_conversation, (*LABEL, "CONVERSATION_ID")),
        LABEL,
    )
    costs = apps.select(F.col("id").alias("APP_ID"), "inputCost", "outputCost")
    priced = sums.join(costs, "APP_ID", "left")
    cost = (
        F.col("tokens_prompt") * F.coalesce("inputCost", F.lit(0.0))
        + F.col("tokens_response") * F.coalesce("outputCost", F.lit(0.0))
    )

    shares, rates = [], []
    for side in ("prompt", "response"):
        polar = F.col(f"{side}_positive") + F.col(f"{side}_negative")
        whole = F.col("messages") if denominator == "messages" else polar
        for mood in ("positive", "negative"):
            name = f"SENTIMENT_{side}_{mood}".upper()
            shares.append(F.coalesce(percent(f"{side}_{mood}", whole), F.lit(0.0)).alias(name))
            rates.append(percent(f"{side}_{mood}", "messages").alias(f"{name}_RATE"))

    return priced.select(
        F.col("EVENT_DATE").alias("day"),
        *LABEL[1:],
        F.col("duration").alias("TIME_TOTAL"),
        cost.alias("COST"),
        F.col("conversations").alias("CONVERSATIONS"),
        F.col("messages").alias("MESSAGES"),
        ratio("messages", "conversations").alias("DIALOGUE_VOLUME"),
        *shares,
        *rates,
        F.col("lang_prompt").alias("LANG_PROMPT"),
        F.col("lang_response").alias("LANG_RESPONSE"),
        F.col("words_prompt").alias("NUM_WORDS_PROMPT"),
        F.col("words_response").alias("NUM_WORDS_RESPONSE"),
        F.col("tokens_prompt").alias("TOKENS_SPENT_PROMPT"),
        F.col("tokens_response").alias("TOKENS_SPENT_RESPONSE"),
        ratio("readability", "n").alias("READABILITY_RESPONSE"),
        ratio("latency", "n").alias("TIME_LATENCY"),
        F.col("feedback_positive").alias("FEEDBACK_POSITIVE"),
        F.col("feedback_negative").alias("FEEDBACK_NEGATIVE"),
        percent("feedback_positive", "messages").alias("FEEDBACK_POSITIVE_RATE"),
        percent("feedback_negative", "messages").alias("FEEDBACK_NEGATIVE_RATE"),
    )
