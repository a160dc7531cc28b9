"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query. The index holds a
posting (trigram, text) for every trigram the rules ask for; the postings of an
alternative are intersected by counting them per text. Texts that answer a rule's
query are verified with its expression; rules without mandatory trigrams (runs of
hex digits) scan all texts.

Spans count code points, end exclusive. A rule's matches are the leftmost ones
that do not overlap; its check drops some of them afterwards. NULL text counts as
empty. Texts are keyed by a hash of doc_id and text, so repeated rows and ids get
the same result for the same text; the hash only selects candidates. Other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_id, table
from .trigrams import query


@dataclass(frozen=True)
class Rule:
    kind: str
    expression: str
    group: int = 0  # the group whose length counts
    least: int = 0  # characters
    base: bool = False


RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 8, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    # A run of 32 or more is what is left of all runs after dropping the shorter ones.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, key): postings of the trigrams that the rules ask for."""
    asked = sorted({t for r in rules for alternative in query(r.expression) for t in alternative})
    # transform binds the lower-case text to a variable, so it is made once per text
    held = F.transform(
        F.array(F.lower("text")), lambda s: F.filter(F.lit(asked).cast("array<string>"), lambda t: F.contains(s, t))
    )[0]
    return docs.select(_key().alias("key"), F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the rules whose query a text answers; rules that scan all texts are left out."""
    asked = [
        (rule.kind, n, len(alternative), trigram)
        for rule in rules
        for n, alternative in enumerate(sorted(map(sorted, query(rule.expression))))
        for trigram in alternative
    ]
    # As many rows as the rules have trigrams, whatever the data.
    asked = postings.sparkSession.createDataFrame(asked, "kind string, n int, size int, trigram string")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "n", "size")
    met = met.agg(F.count_distinct("trigram").alias("found")).where("found = size")
    return met.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("rules"))


_PLACED = "array<struct<start:int,size:int,counted:int>>"


def _bound(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.transform(F.array(value), use)[0]


def matches(rule: Rule, order: int, text: str = "text") -> Column:
    """Array of (start, order, kind, end) of a rule's matches.

    The texts between matches and the matches alternate, so their lengths add up to positions.
    Appending copies an array, so spans are gathered in blocks of the root of their number.
    """
    expression = F.lit(rule.expression)
    found = F.regexp_extract_all(text, expression, F.lit(0))
    checked = F.regexp_extract_all(text, expression, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.expression, -1), F.char_length).alias("gap"),
        F.transform(found, F.char_length).alias("size"),
        F.transform(checked, F.char_length).alias("counted"),
    )
    none = F.array().cast(_PLACED)

    def place(done: Column, part: Column) -> Column:
        span = F.struct((done["at"] + part["gap"]).alias("start"), part["size"], part["counted"])
        return F.struct(
            (done["at"] + part["gap"] + F.coalesce(part["size"], F.lit(0))).alias("at"),
            F.when(part["size"].isNull(), done["spans"]).otherwise(F.concat(done["spans"], F.array(span))).alias("spans"),
        )

    def place_block(done: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(done["at"].alias("at"), none.alias("spans")), place)
        return _bound(inner, lambda new: F.struct(
            new["at"].alias("at"), F.concat(done["blocks"], F.array(new["spans"])).alias("blocks"),
        ))

    def place_all(parts: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(parts))).cast("int")  # of at least one part, the text without matches
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / width).cast("int")),
            lambda i: F.slice(parts, i * width + 1, width),
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACED}>").alias("blocks"))
        return F.flatten(F.aggregate(blocks, start, place_block, lambda done: done["blocks"]))

    placed = _bound(parts, place_all)
    long_enough = F.filter(placed, lambda m: m["counted"] >= rule.least)
    return F.transform(
        long_enough,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
            (m["start"] + m["size"]).alias("end"),
        ),
    )


_SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): array of (start, order, kind, end), a row per row of `docs`."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(index(docs, rules), rules)
    joined = join_by_id(docs.withColumn("key", _key()), found, "left", "key")
    none = F.array().cast(_SPANS)
    spans = []
    for order, rule in enumerate(rules):
        free = frozenset() in query(rule.expression)
        wanted = F.col("text").rlike(rule.expression) if free else F.array_contains("rules", rule.kind)
        spans.append(F.when(wanted, matches(rule, order).cast(_SPANS)).otherwise(none))
    return joined.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then rule, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
