"""Line dedup: an edit-distance self-join of the corpus' lines, in DataFrame functions only.

Two lines are linked if the shorter one's length allows the edits between them: one
edit per PER_EDIT code points, TAU at most, so lines under PER_EDIT code points are
linked to equal lines only. A line is cut into as many segments as its edits and one
more; of two linked lines the longer has a segment of the shorter as a substring, near
the segment's own place. So each line is indexed under its own segments and probes, for
its own length and the TAU lengths below, the few substrings that can match. Lines that
meet under a key are candidates; keys that many lines probe are joined in shares. A
banded bit-parallel automaton (one bit per diagonal, one band per number of errors)
verifies candidates on the full texts.

An occurrence of a line is removed if the same line or a linked line occurs earlier, by
(doc_id, line number); what is judged is the input. Blank lines, of whatever length,
separate paragraphs and stay.

NULL text has no lines; empty text has one empty line. NULL doc_ids come first. Lines
at equal positions, in rows that repeat a doc_id or have none, are not earlier than
each other, so all of them stay; what is removed is told apart by the rows' texts,
of which `tk` is a hash. Other columns, of any names, are ignored or, in `dedup`,
passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, join_by_id, same, saved, table

TAU = 2
PER_EDIT = 16
#: Probes of a key, or occurrences of a line, in one share of a join.
SHARE = 2000


def budget(length: Column, tau: int = TAU, per_edit: int = PER_EDIT) -> Column:
    """Edits that a line of this length allows."""
    return F.least(F.lit(tau), F.floor(length / per_edit)).cast("int")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, line_no, line)."""
    # hashed below the generator, once a text
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    return keyed.select("doc_id", "tk", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _identity(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("id"), F.xxhash64(F.lit(7), F.col(line)).alias("id2")]


def segments(base: Column, longer: Column, parts: int) -> list[tuple[Column, Column]]:
    """(start from 1, size) of the segments of a line of base * parts + longer characters, short ones first."""
    return [
        (base * i + F.greatest(F.lit(0), longer - (parts - i)) + 1, base + (longer >= parts - i).cast("int"))
        for i in range(parts)
    ]


def keys(found: DataFrame, tau: int, per_edit: int) -> DataFrame:
    """(id, k) from (id, line): hashes of the line's own segments, odd, and of the substrings it probes with, even.

    The line is cut in UTF-16, two bytes a code point, so that a substring is found by its
    place and not by reading the line from its start. Code points that take four count as
    one that takes two: keys may then meet more often, never less, and what meets is verified.

    A probe for length n - d and segment i starts within i edits of the segment's
    start on the left, and within `edits - i` edits of it, shifted by d, on the right:
    no alignment needs others. A line's own segments serve as probes too.
    """
    n = F.char_length("line")
    cut = found.select("id", "line", F.encode("line", "UTF-16BE").alias("chars"), n.alias("n"))
    narrow = F.encode(F.regexp_replace("line", "[\\x{10000}-\\x{10FFFF}]", "\ufffd"), "UTF-16BE")
    cut = cut.select("id", F.when(F.length("chars") > F.col("n") * 2, narrow).otherwise(F.col("chars")).alias("chars"), "n")
    # Numbers that several keys share are columns of their own: inside conditions nothing is
    # shared, and a method beyond 8,000 bytes of bytecode is not compiled by the JVM.
    numbers = {f"e{d}": F.least(F.lit(tau), F.expr(f"cast((n - {d}) div {per_edit} as int)")) for d in range(tau + 1)}
    for d in range(tau + 1):
        for i in range(tau + 1):
            numbers[f"m{d}_{i}"] = (F.col("n") - d) * (tau + 1) + i
        for parts in range(max(2, d + 1), tau + 2):
            base, longer = F.expr(f"cast((n - {d}) div {parts} as int)"), F.expr(f"cast((n - {d}) % {parts} as int)")
            for i, (start, size) in enumerate(segments(base, longer, parts)):
                numbers[f"s{d}_{parts}_{i}"], numbers[f"z{d}_{parts}_{i}"] = start * 2, size * 2
    cut = cut.select("id", "chars", *(column.alias(name) for name, column in numbers.items()))
    none = F.array().cast("array<bigint>")
    out = [none]
    for edits in range(1, tau + 1):
        for d in range(edits + 1):
            made, parts = [], edits + 1
            for i in range(parts):
                low, high = max(-i, d - (edits - i)), min(i, d + (edits - i))
                for shift in range(low, high + 1):
                    part = F.substring("chars", F.col(f"s{d}_{parts}_{i}") + (2 * shift - 1), F.col(f"z{d}_{parts}_{i}"))
                    key = F.shiftleft(F.xxhash64(f"m{d}_{i}", part), 1)
                    made.append(key + F.lit(int(d == 0 and shift == 0)).cast("long"))
            out.append(F.when(F.col(f"e{d}") == edits, F.array(*made)).otherwise(none))
    return cut.select("id", F.explode(F.concat(*out)).alias("k"))


def within(a: Column, b: Column, tau: int, edits: Column | None = None) -> Column:
    """Whether strings a and b are within `tau` edits, or within `edits` of at most `tau`.

    Bit k of band e says that a prefix of `a`, k - tau longer than the prefix of
    `b` read so far, is within e edits of it. Reading a character moves all bands
    at once: along the diagonal where it matches or is replaced, one diagonal
    down where it is inserted, one up where a character of `a` is left out.
    The bands lie side by side in one long.
    """
    # transform binds what it is given to a variable; else every step would make it again
    both = F.array(F.struct(a.alias("a"), b.alias("b")))
    rest = F.transform(both, lambda s: _without_prefix(s["a"], s["b"]))
    chars = F.transform(rest, lambda s: F.struct(_chars(s["a"]).alias("a"), _chars(s["b"]).alias("b")))
    return F.transform(chars, lambda c: _within(c["a"], c["b"], tau, F.lit(tau) if edits is None else edits))[0]


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _without_prefix(a: Column, b: Column) -> Column:
    """Two strings without the characters they start with alike, found by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    shorter = F.least(F.char_length(a), F.char_length(b))
    common = F.aggregate(
        F.filter(steps, lambda w: w <= shorter),
        F.lit(0),
        lambda n, w: F.when(
            (n + w <= shorter) & (F.substring(a, n + 1, w) == F.substring(b, n + 1, w)), n + w
        ).otherwise(n),
    )
    rest = F.transform(F.array(common), lambda n: F.struct(
        F.substring(a, n + 1, F.char_length(a)).alias("a"), F.substring(b, n + 1, F.char_length(b)).alias("b")
    ))
    return rest[0]


def _within(a: Column, b: Column, tau: int, edits: Column) -> Column:
    width = 2 * tau + 1
    full = (1 << width) - 1
    start = sum((((1 << (e + 1)) - 1) << tau & full) << (e * width) for e in range(tau + 1))

    def step(state: Column, j: Column) -> Column:
        here = F.get(b, j)
        match = F.lit(0).cast("long")
        for k in range(width):
            at = j + (k - tau)
            match = match.bitwiseOR(F.when(F.get(a, at) == here, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(state.alias("s"), match.alias("m"))

    def advance(both: Column) -> Column:
        bands, before, moved = [], None, None
        for e in range(tau + 1):
            old = F.shiftrightunsigned(both["s"], e * width).bitwiseAND(F.lit(full).cast("long"))
            now = old.bitwiseAND(both["m"])
            if e:
                now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(moved, 1))
                now = now.bitwiseAND(F.lit(full).cast("long"))
            bands.append(F.shiftleft(now, e * width))
            before, moved = old, now
        out = bands[0]
        for band in bands[1:]:
            out = out.bitwiseOR(band)
        return out

    def read(state: Column, j: Column) -> Column:
        # transform + [0] binds the pair to a variable, so it is computed once
        pair = F.transform(F.array(step(state, j)), advance)[0]
        return F.when(state == 0, state).otherwise(pair)

    over = F.sequence(F.lit(0), F.size(b) - 1)
    last = F.when(F.size(b) == 0, F.lit(start).cast("long")).otherwise(
        F.aggregate(over, F.lit(start).cast("long"), read)
    )
    wanted = F.get(F.array(*(F.lit(1 << k).cast("long") for k in range(width))), F.size(a) - F.size(b) + tau)
    band = F.call_function("shiftright", last, (edits * width).cast("int"))
    return F.coalesce(band.bitwiseAND(wanted) != 0, F.lit(False))


#: Characters whose numbers a sketch holds, two bits each.
SKETCHED = "etaoinshrdlucmfwypvbgk .,0123"


def sketch(line: str) -> Column:
    """Numbers of some characters modulo 4, in a code where one more or less changes one bit.

    An edit adds one character, drops one or does both, so two bits a line at most.
    """
    size, out = F.char_length(line), F.lit(0).cast("long")
    code = F.array(*(F.lit(x).cast("long") for x in (0, 1, 3, 2)))
    for k, char in enumerate(SKETCHED):
        number = size - F.char_length(F.replace(F.col(line), F.lit(char), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(F.get(code, number % 4), 2 * k))
    return out


def _shares(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with their key's number of shares as column `name`; `counts` (key, shares) has the keys with several."""
    return join_by_id(rows, counts.withColumnRenamed("shares", name), "left", key).withColumn(name, F.coalesce(name, F.lit(1).cast("long")))


def _all_shares(shares: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(shares) - 1))


def links(found: DataFrame, tau: int = TAU, per_edit: int = PER_EDIT) -> DataFrame:
    """(id, id2, other, other2): different lines within their edits, both ways round, from (line, ...)."""
    long_lines = found.where(F.char_length("line") >= per_edit).select(*_identity("line"), "line")
    signed = keys(long_lines, tau, per_edit).select("id", F.shiftright("k", 1).alias("key"), F.col("k").bitwiseAND(F.lit(1).cast("long")).alias("indexed"))
    # Few keys are met by different lines, so the keys are made twice rather than kept.
    met = signed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("indexed").alias("any"))
    held = join_by_id(signed, met.where("any = 1 and low <> high").select("key"), key="key")
    held = saved(held.groupBy("key", "id").agg(F.max("indexed").alias("indexed")), "segments")
    wanted = join_by_id(long_lines, held.select("id").distinct(), key="id")
    texts = saved(wanted.groupBy("id", "id2").agg(F.min("line").alias("line")).withColumn("sketch", sketch("line")), "texts")
    crowded = held.groupBy("key").agg(F.ceil(F.count("*") / SHARE).alias("shares")).where("shares > 1")
    held = _shares(held.join(texts.select("id", "sketch").distinct(), "id"), crowded, "key", "shares")
    probe = held.select(
        "key", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"), F.col("id").alias("x"), F.col("sketch").alias("p")
    )
    index = held.where("indexed = 1").select(
        F.col("key").alias("same"), _all_shares("shares").alias("part"), F.col("id").alias("y"), F.col("sketch").alias("q")
    )
    alike = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 2 * tau
    met = (F.col("key") == F.col("same")) & (F.col("share") == F.col("part")) & (F.col("x") != F.col("y")) & alike
    pairs = probe.join(index, met)
    pairs = saved(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "candidates")
    left = texts.select(F.col("id").alias("x"), F.col("id2").alias("x2"), F.col("line").alias("a"))
    right = texts.select(F.col("id").alias("y"), F.col("id2").alias("y2"), F.col("line").alias("b"))
    edits = budget(F.least(F.char_length("a"), F.char_length("b")), tau, per_edit)
    close = (
        pairs.join(left, "x").join(right, "y")
        .where(within(F.col("a"), F.col("b"), tau, edits)).select("x", "x2", "y", "y2")
    )
    close = saved(close, "close")
    names = ["id", "id2", "other", "other2"]
    return close.toDF(*names).union(close.select("y", "y2", "x", "x2")).toDF(*names)


def duplicates(docs: DataFrame, tau: int = TAU, per_edit: int = PER_EDIT) -> DataFrame:
    """(doc_id, tk, line_no) of the occurrences to remove."""
    found = lines(docs).where(F.col("line").rlike(WORD))
    held = found.select("doc_id", "tk", "line_no", *_identity("line"))
    place = F.struct("doc_id", "line_no")
    first = saved(held.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first")
    other = first.select(F.col("id").alias("other"), F.col("id2").alias("other2"), F.col("first").alias("theirs"))
    earlier = links(found, tau, per_edit).join(other, ["other", "other2"]).groupBy("id", "id2").agg(F.min("theirs").alias("theirs"))
    bound = first.join(earlier, ["id", "id2"], "left").withColumn("bound", F.least("first", F.coalesce("theirs", "first")))
    bound = bound.where((F.col("n") > 1) | (F.col("bound") < F.col("first")))
    bound = saved(bound.select("id", "id2", "bound", F.ceil(F.col("n") / SHARE).alias("shares")), "bounds")
    # The occurrences of a common line are dealt over as many tasks as they need.
    common = bound.where("shares > 1").groupBy("id").agg(F.max("shares").alias("shares"))
    held = _shares(held, common, "id", "shares").withColumn("share", F.pmod(F.xxhash64("doc_id", "tk", "line_no"), F.col("shares")))
    bound = _shares(bound.drop("shares"), common, "id", "shares").withColumn("share", _all_shares("shares")).drop("shares")
    removed = held.join(bound, ["id", "id2", "share"]).where(place > F.col("bound"))
    return removed.select("doc_id", "tk", "line_no").distinct()


def removed_lines(docs: DataFrame, tau: int = TAU, per_edit: int = PER_EDIT) -> DataFrame:
    """(doc_id, tk, removed): sorted numbers of the lines to remove, for documents that have any."""
    return duplicates(docs, tau, per_edit).groupBy("doc_id", "tk").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))


def _with_removed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` (row, doc_id, tk) with `removed`, NULL where nothing goes; both sides may be large, so none is broadcast."""
    found = gone.select(F.col("doc_id").alias("id"), F.col("tk").alias("of"), "removed")
    return rows.join(found, same(rows["doc_id"], F.col("id")) & (rows["tk"] == F.col("of")), "left").drop("id", "of")


def without(text: Column, removed: Column) -> Column:
    """`text` without the lines of the sorted numbers `removed`; in time that grows with the text alone."""
    # transform binds what it is given, so each step is made once
    given = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), removed.alias("removed")))

    def flags(s: Column) -> Column:
        before = lambda i: F.coalesce(F.get(s["removed"], i - 1), F.lit(-1))
        runs = F.transform(
            s["removed"], lambda at, i: F.concat(F.array_repeat(F.lit(True), at - before(i) - 1), F.array(F.lit(False)))
        )
        return F.struct(s["lines"].alias("lines"), F.flatten(runs).alias("kept"))

    flagged = F.transform(given, flags)
    left = F.transform(flagged, lambda s: F.filter(s["lines"], lambda _, i: F.coalesce(F.get(s["kept"], i), F.lit(True))))
    return F.array_join(left[0], "\n")


def dedup(docs: DataFrame, tau: int = TAU, per_edit: int = PER_EDIT) -> DataFrame:
    """`docs` without repeated lines, all columns; documents of which nothing but blanks is left go.

    A document that had no text to begin with stays as it is.
    """
    gone = removed_lines(docs, tau, per_edit)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("tk"))
    rows = _with_removed(rows, gone)
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(without(F.col("row.text"), F.col("removed")))
    rows = rows.select("row", F.col("removed").isNull().alias("whole"), text.alias("left"))
    rows = rows.where(F.col("whole") | F.col("left").rlike(WORD))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("left").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.greatest(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), F.lit(0))
    counted = docs.select("doc_id", F.xxhash64("text").alias("tk"), n.alias("n"))
    return _with_removed(counted, removed_lines(docs)).select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("removed", F.array().cast("array<int>")).cast("array<string>"), ",").alias("removed"),
    )
