"""Daily usage, language, device, user and engagement figures.

Every operator takes `traces_processed` and counts only rows with
TASK = 'message'. The `finish_*` functions take merged partial rows, so that
batch plans and stored incremental states share one definition of each figure.

Costs are applied after aggregation, on one row per app and day: the app
dimension never meets the raw rows, and no app can skew that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.numbers import or_zero, percent, ratio
from tracefold.operators.rollup import Rollup, sum_counters

DAY = ["APP_ID", "EVENT_DATE"]


def messages(traces_processed: DataFrame) -> DataFrame:
    return traces_processed.filter(F.col("TASK") == "message")


def _known_user(df: DataFrame) -> DataFrame:
    return messages(df).filter(F.col("USER_ID") != "")


def _flag(condition: str) -> tuple[str, str]:
    return ("max", f"cast({condition} as int)")


USAGE_DAYS = Rollup(
    "usage_days",
    (*DAY,),
    {
        "n": ("count", "1"),
        "min_start": ("min", "START_TIMESTAMP"),
        "max_end": ("max", "END_TIMESTAMP"),
        "words_prompt": ("sum", "NUM_WORDS_PROMPT"),
        "words_response": ("sum", "NUM_WORDS_RESPONSE"),
        "tokens_prompt": ("sum", "TOKENS_SPENT_PROMPT"),
        "tokens_response": ("sum", "TOKENS_SPENT_RESPONSE"),
        "latency": ("sum", "LATENCY"),
        "readability": ("sum", "READABILITY_RESPONSE"),
    },
    messages,
)

# One row per message: a message counts once per flag however often it is stored.
MESSAGE_DAYS = Rollup(
    "message_days",
    (*DAY, "INTERACTION_ID"),
    {
        "prompt_positive": _flag("SENTIMENT_PROMPT_POSITIVE > 0.5"),
        "prompt_negative": _flag("SENTIMENT_PROMPT_NEGATIVE > 0.5"),
        "response_positive": _flag("SENTIMENT_RESPONSE_POSITIVE > 0.5"),
        "response_negative": _flag("SENTIMENT_RESPONSE_NEGATIVE > 0.5"),
        "feedback_positive": _flag("FEEDBACK_TAG = 'positive'"),
        "feedback_negative": _flag("FEEDBACK_TAG = 'negative'"),
    },
    messages,
)
MESSAGE_FLAGS = tuple(MESSAGE_DAYS.measures)

CONVERSATION_DAYS = Rollup(
    "conversation_days", (*DAY, "CONVERSATION_ID"), {"n": ("count", "1")}, messages
)
USER_DAYS = Rollup(
    "user_days",
    (*DAY, "USER_ID"),
    {"n": ("count", "1")},
    _known_user,
)
# The day a user came first, over the whole history. Late rows lower it.
FIRST_SEEN = Rollup("first_seen", ("APP_ID", "USER_ID"), {"first_day": ("min", "EVENT_DATE")}, _known_user)
SESSION_DAYS = Rollup("session_days", (*DAY, "SESSION_ID"), {"n": ("count", "1")}, _known_user)
LOCATION_DAYS = Rollup("location_days", (*DAY, "LOCATION"), {"n": ("count", "1")}, _known_user)
LANGUAGE_DAYS = Rollup("language_days", (*DAY, "LANG_PROMPT"), {"n": ("count", "1")}, messages)
COUNTRY_DAYS = Rollup(
    "country_days",
    (*DAY, "LOCATION"),
    {"n": ("count", "1")},
    lambda df: messages(df).filter(F.col("LOCATION") != ""),
)


def _sessions_by(name: str, column: str, keep: str) -> Rollup:
    return Rollup(
        name,
        (*DAY, column, "SESSION_ID"),
        {"n": ("count", "1")},
        lambda df: messages(df).filter(keep),
    )


DEVICE_SESSIONS = _sessions_by("device_sessions", "DEVICE", "DEVICE != ''")
BROWSER_SESSIONS = _sessions_by("browser_sessions", "BROWSER", "BROWSER != ''")
OS_SESSIONS = _sessions_by("os_sessions", "OS", "OS != ''")
# An empty channel is a channel of its own; only NULL is left out.
CHANNEL_SESSIONS = _sessions_by("channel_sessions", "CHANNEL_ID", "CHANNEL_ID is not null")

# Bounded-size alternative to the id-level states: distinct counts within the
# sketch's relative error (about 1.6 % at the default size), one row per day.
APPROX_DAYS = Rollup(
    "approx_days",
    (*DAY,),
    {
        "messages": ("approx_distinct", "INTERACTION_ID"),
        "conversations": ("approx_distinct", "CONVERSATION_ID"),
        "users": ("approx_distinct", "nullif(USER_ID, '')"),
        "sessions": ("approx_distinct", "SESSION_ID"),
    },
    messages,
)


def with_day(df: DataFrame) -> DataFrame:
    """`day` repeats the date right after it, as readers expect both."""
    at = df.columns.index("EVENT_DATE") + 1
    return df.select(*df.columns[:at], F.col("EVENT_DATE").alias("day"), *df.columns[at:])


# --- usage -----------------------------------------------------------------


def finish_usage(
    usage_days: DataFrame, message_days: DataFrame, conversation_days: DataFrame, apps: DataFrame
) -> DataFrame:
    per_day = message_days.groupBy(*DAY).agg(
        F.count("*").alias("messages_count"),
        *[F.sum(flag).alias(flag) for flag in MESSAGE_FLAGS],
    )
    conversations = conversation_days.groupBy(*DAY).agg(F.count("*").alias("conversations_count"))
    costs = apps.select(F.col("id").alias("APP_ID"), "inputCost", "outputCost")
    prompt_cost = F.col("tokens_prompt") * F.col("inputCost")
    response_cost = F.col("tokens_response") * F.col("outputCost")
    joined = usage_days.join(per_day, DAY).join(conversations, DAY).join(costs, "APP_ID")
    return with_day(joined.select(
        *DAY,
        "messages_count",
        "conversations_count",
        F.col("min_start").alias("min_start_timestamp"),
        F.col("max_end").alias("max_end_timestamp"),
        ratio("words_prompt", "n").alias("avg_prompt_words"),
        ratio("words_response", "n").alias("avg_response_words"),
        F.col("tokens_prompt").alias("prompt_tokens"),
        F.col("tokens_response").alias("response_tokens"),
        ratio("tokens_prompt", "n").alias("avg_prompt_tokens"),
        ratio("tokens_response", "n").alias("avg_response_tokens"),
        prompt_cost.alias("prompt_cost"),
        response_cost.alias("response_cost"),
        (prompt_cost + response_cost).alias("total_cost"),
        ratio("latency", "n").alias("avg_latency"),
        F.col("prompt_positive").alias("sentiment_prompt_positive"),
        F.col("prompt_negative").alias("sentiment_prompt_negative"),
        F.col("response_positive").alias("sentiment_response_positive"),
        F.col("response_negative").alias("sentiment_response_negative"),
        ratio("readability", "n").alias("readability"),
        "feedback_positive",
        "feedback_negative",
    ))


def traces_usage_metrics(traces_processed: DataFrame, apps: DataFrame) -> DataFrame:
    """Messages, conversations, words, tokens, cost, sentiment per app and day."""
    return finish_usage(
        USAGE_DAYS.partial(traces_processed),
        MESSAGE_DAYS.partial(traces_processed),
        CONVERSATION_DAYS.partial(traces_processed),
        apps,
    )


# --- users -----------------------------------------------------------------


def finish_users(
    user_days: DataFrame,
    session_days: DataFrame,
    location_days: DataFrame | None = None,
    first_seen: DataFrame | None = None,
) -> DataFrame:
    """A user is new on the first of their days in the app's whole history.

    The window holds the days of one user, never their messages. With the merged
    `FIRST_SEEN` state the other states may hold a range of days only, and users
    are counted by their first day, without a window or a join on users.
    """
    if first_seen is not None:
        users = _users_by_first_day(user_days, first_seen)
    else:
        history = Window.partitionBy("APP_ID", "USER_ID")
        users = (
            user_days.withColumn("is_new", F.col("EVENT_DATE") == F.min("EVENT_DATE").over(history))
            .groupBy(*DAY)
            .agg(F.count("*").alias("users_count"), F.count_if("is_new").alias("new_users_count"))
        )
    sessions = session_days.groupBy(*DAY).agg(F.count("*").alias("sessions_count"))
    joined = users.join(sessions, DAY)
    return with_day(joined.join(_countries(location_days), DAY) if location_days is not None else joined)


def _users_by_first_day(user_days: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Users and new users a day. A user's first day is one of their days, so days only need to be added up."""
    seen = user_days.groupBy(*DAY).agg(F.count("*").alias("users_count"))
    came = first_seen.groupBy("APP_ID", F.col("first_day").alias("EVENT_DATE")).agg(F.count("*").alias("new_users_count"))
    return seen.join(came, DAY, "left").withColumn("new_users_count", or_zero("new_users_count"))


def _countries(location_days: DataFrame) -> DataFrame:
    """Countries with their message counts: the list of all locations of a day,
    held as (value, multiplicity) so that its size follows the countries, not
    the messages."""
    return location_days.groupBy(*DAY).agg(
        F.count("*").alias("countries_count"),
        F.sort_array(F.collect_list(F.struct(F.col("LOCATION").alias("country"), "n"))).alias("countries"),
    )


def traces_user_metrics(traces_processed: DataFrame) -> DataFrame:
    """Users, new users, sessions and countries per app and day."""
    return finish_users(
        USER_DAYS.partial(traces_processed),
        SESSION_DAYS.partial(traces_processed),
        LOCATION_DAYS.partial(traces_processed),
    )


def users_countries_daily(traces_processed: DataFrame) -> DataFrame:
    """Countries of the day's known users, with message counts."""
    return with_day(_countries(LOCATION_DAYS.partial(traces_processed)))


# --- combined daily and total figures ---------------------------------------


def finish_metrics(usage: DataFrame, users: DataFrame) -> DataFrame:
    users = users.select(*DAY, "users_count", "new_users_count", "sessions_count")
    rate = lambda name: percent(name, "messages_count").alias(f"{name}_rate")
    sentiments = [
        f"sentiment_{side}_{mood}" for side in ("prompt", "response") for mood in ("positive", "negative")
    ]
    per_user = F.when(F.col("users_count") > 0, ratio("sessions_count", "users_count")).otherwise(0.0)
    return usage.join(users, DAY, "left").select(
        *DAY,
        "day",
        "messages_count",
        "conversations_count",
        ratio("messages_count", "conversations_count").alias("dialogue_volume"),
        "avg_prompt_words",
        "avg_response_words",
        "prompt_tokens",
        "response_tokens",
        "avg_prompt_tokens",
        "avg_response_tokens",
        "avg_latency",
        "prompt_cost",
        "response_cost",
        "total_cost",
        or_zero("users_count").alias("users_count"),
        or_zero("new_users_count").alias("new_users_count"),
        or_zero("sessions_count").alias("sessions_count"),
        per_user.alias("sessions_per_user"),
        *sentiments,
        *[rate(name) for name in sentiments],
        "readability",
        "feedback_positive",
        "feedback_negative",
        rate("feedback_positive"),
        rate("feedback_negative"),
    )


def traces_metrics(traces_processed: DataFrame, apps: DataFrame) -> DataFrame:
    """Daily usage joined with daily users, with rates."""
    users = finish_users(USER_DAYS.partial(traces_processed), SESSION_DAYS.partial(traces_processed))
    return finish_metrics(traces_usage_metrics(traces_processed, apps), users)


def traces_metrics_total(daily: DataFrame) -> DataFrame:
    """Per app: sums of the daily counts and plain averages of the daily rates."""
    total = lambda source, out: F.sum(source).alias(out)
    average = lambda source, out=None: F.avg(source).alias(out or source)
    return daily.groupBy("APP_ID").agg(
        total("messages_count", "total_messages"),
        total("conversations_count", "total_conversations"),
        average("dialogue_volume", "avg_dialogue_volume"),
        average("avg_prompt_words"),
        average("avg_response_words"),
        total("prompt_tokens", "total_prompt_tokens"),
        total("response_tokens", "total_response_tokens"),
        average("avg_latency"),
        total("prompt_cost", "prompt_cost"),
        total("response_cost", "response_cost"),
        total("total_cost", "total_cost"),
        total("users_count", "total_users"),
        total("new_users_count", "total_new_users"),
        total("sessions_count", "total_sessions"),
        average("sessions_per_user", "avg_sessions_per_user"),
        average("sentiment_prompt_positive"),
        average("sentiment_prompt_negative"),
        average("sentiment_response_positive"),
        average("sentiment_response_negative"),
        average("readability"),
        average("feedback_positive_rate"),
        average("feedback_negative_rate"),
    )


# --- counts by one dimension -------------------------------------------------


def traces_language_metrics(traces_processed: DataFrame) -> DataFrame:
    """Messages per prompt language."""
    return with_day(LANGUAGE_DAYS.partial(traces_processed).withColumnRenamed("n", "language_count"))


def traces_language_daily(language_metrics: DataFrame) -> DataFrame:
    """Language counters added up, most used first."""
    keys = (*DAY, "day", "LANG_PROMPT")
    return (
        sum_counters(language_metrics, keys, ["language_count"])
        .withColumnsRenamed({"LANG_PROMPT": "language", "language_count": "count"})
        .orderBy(*DAY, F.desc("count"), "language")
    )


def traces_country_metrics(traces_processed: DataFrame) -> DataFrame:
    """Messages per country, most active first."""
    return (
        with_day(COUNTRY_DAYS.partial(traces_processed))
        .withColumnsRenamed({"LOCATION": "country", "n": "count"})
        .orderBy(*DAY, F.desc("count"), "country")
    )


def _finish_sessions(rollup: Rollup, state: DataFrame, name: str | None = None) -> DataFrame:
    column = rollup.keys[2]
    counted = state.groupBy(*DAY, column).agg(F.count("*").alias("count"))
    return with_day(counted.withColumnRenamed(column, name) if name else counted)


def traces_device_metrics(traces_processed: DataFrame) -> DataFrame:
    """Sessions per device."""
    return _finish_sessions(DEVICE_SESSIONS, DEVICE_SESSIONS.partial(traces_processed))


def traces_browser_metrics(traces_processed: DataFrame) -> DataFrame:
    """Sessions per browser."""
    return _finish_sessions(BROWSER_SESSIONS, BROWSER_SESSIONS.partial(traces_processed))


def traces_os_metrics(traces_processed: DataFrame) -> DataFrame:
    """Sessions per operating system."""
    return _finish_sessions(OS_SESSIONS, OS_SESSIONS.partial(traces_processed))


def traces_channel_metrics(traces_processed: DataFrame) -> DataFrame:
    """Sessions per channel."""
    return _finish_sessions(CHANNEL_SESSIONS, CHANNEL_SESSIONS.partial(traces_processed), "channel")


# --- conversations per day ---------------------------------------------------


def conversation_message_counts(traces_processed: DataFrame) -> DataFrame:
    """Messages per conversation and day."""
    return with_day(CONVERSATION_DAYS.partial(traces_processed).withColumnRenamed("n", "message_count"))


def single_message_rate(message_counts: DataFrame) -> DataFrame:
    """Share of a day's conversations with one message only."""
    return message_counts.groupBy(*DAY, "day").agg(
        F.count_if(F.col("message_count") == 1).alias("single_message_conversations"),
        F.count("*").alias("total_conversations"),
    ).withColumn(
        "single_message_rate", percent("single_message_conversations", "total_conversations")
    )


# --- user engagement ---------------------------------------------------------


def traces_user_engagement(traces_processed: DataFrame) -> DataFrame:
    """Messages per user and day."""
    return with_day(
        USER_DAYS.partial(traces_processed).withColumnRenamed("n", "interaction_count")
    )


def traces_engagement_metrics(engagement: DataFrame) -> DataFrame:
    """Active users with average and largest number of calls.

    Counters of one user are added up first, so that unmerged counter rows
    give the same answer as merged ones.
    """
    per_user = sum_counters(engagement, (*DAY, "day", "USER_ID"), ["interaction_count"])
    return per_user.groupBy(*DAY, "day").agg(
        F.count("*").alias("active_users"),
        ratio(F.sum("interaction_count"), F.count("*")).alias("avg_calls_per_user"),
        F.max("interaction_count").alias("max_calls_per_user"),
    )


def traces_top_users(traces_processed: DataFrame) -> DataFrame:
    """Requests per user and day."""
    return with_day(
        USER_DAYS.partial(traces_processed).withColumnRenamed("n", "request_count")
    )


def top_users(requests: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest users of every app and day.

    The rank is limited inside each task before the shuffle, so an app with
    very many users sends k rows per task to the ranking task.
    """
    order = Window.partitionBy(*DAY).orderBy(F.desc("request_count"), "USER_ID")
    return requests.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def approx_usage(approx_days: DataFrame) -> DataFrame:
    """Estimated distinct counts per app and day from merged sketches."""
    estimate = lambda name: F.hll_sketch_estimate(name).alias(f"{name}_estimate")
    return with_day(approx_days.select(*DAY, *[estimate(name) for name in APPROX_DAYS.measures]))


# Five standard errors of the sketch at its default size.
APPROX_BOUND = 0.08


def approx_usage_checked(approx_days: DataFrame, traces_processed: DataFrame) -> DataFrame:
    """Exact counts, and whether each estimate is within `APPROX_BOUND` of them."""
    ids = {name: expr for name, (_, expr) in APPROX_DAYS.measures.items()}
    exact = messages(traces_processed).groupBy(*DAY).agg(
        *[F.count_distinct(F.expr(expr)).alias(name) for name, expr in ids.items()]
    )
    both = approx_usage(approx_days).join(exact, DAY)
    off = lambda name: F.abs(F.col(f"{name}_estimate") - F.col(name)) <= F.col(name) * APPROX_BOUND
    return both.select(*DAY, "day", *ids, *[off(name).alias(f"{name}_within") for name in ids])


DAILY_ROLLUPS: tuple[Rollup, ...] = (
    USAGE_DAYS,
    MESSAGE_DAYS,
    CONVERSATION_DAYS,
    USER_DAYS,
    SESSION_DAYS,
    LOCATION_DAYS,
    LANGUAGE_DAYS,
    COUNTRY_DAYS,
    DEVICE_SESSIONS,
    BROWSER_SESSIONS,
    OS_SESSIONS,
    CHANNEL_SESSIONS,
)
