"""Quality rules with thresholds that follow the data (operator 4), in DataFrame functions alone.

Counts of every text are row-local array expressions. Each measure goes into a quantile sketch per language and source: a
histogram whose buckets keep the six leading bits of a value, so a quantile is right to 1/32 of itself. Sketches of
parts add up to the sketch of the whole, which makes them mergeable twice over: partial ones of the tasks meet
in one aggregation, and those of small sources merge into the sketch of their language, then of all rows. A row is
kept if its measures lie within fences around the quartiles of its own language and source.

The thresholds are joined by language, source and a salt, so a source with a third of the rows is dealt to many tasks.

Defined results: null and empty texts have no words and fail the base rule; null language or source is a group of its
own; repeated rows give repeated rows; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed

WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Rows that a sketch needs to give thresholds of its own.
LEAST_ROWS = 100
#: Fences lie this many quartile distances outside the quartiles.
REACH = 4
SALTS = 32


class Measure(NamedTuple):
    """A measure of a text: what is counted for each so many, and how far fences stay off at least."""

    name: str
    part: str
    whole: str
    scale: int
    slack: int
    both_sides: bool


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 100, 60, True),
    Measure("symbols", "n_symbols", "n_words", 1000, 150, False),
    Measure("equal_lines", "n_dup_lines", "n_lines", 1000, 400, False),
    Measure("repeated", "n_repeat_words", "n_words", 1000, 280, False),
)


def text_counts(docs: DataFrame) -> DataFrame:
    """Each row's ``doc_id``, ``lang``, ``source``, ``text_hash`` and the counts of its text.

    Every step names what later steps use more than once, so that no array is worked out twice.
    """
    rows = docs.select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("body")
    )
    words = F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source", "text_hash",
        words.alias("words"), lines.alias("lines"), F.regexp_count("body", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "text_hash", "n_symbols",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
    )
    begins = F.when(
        F.col("n_words") >= WINDOW_WORDS, F.sequence(F.lit(0), F.greatest(F.col("n_words") - WINDOW_WORDS, F.lit(0)))
    ).otherwise(F.array().cast("array<int>"))
    window = F.transform(begins, lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW_WORDS)]))
    rows = rows.withColumn("windows", window).drop("hashes")
    # Only texts with a repeated window go on to sort theirs.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered).drop("windows")
    twin = F.expr(
        "filter(transform(ordered, (w, j) -> if(w.h <=> get(ordered, j - 1).h OR w.h <=> get(ordered, j + 1).h, w.i, NULL)),"
        " i -> i IS NOT NULL)"
    )
    rows = rows.withColumn("twins", F.sort_array(twin)).drop("ordered")
    covered = F.expr(
        f"aggregate(transform(twins, (p, j) -> least({WINDOW_WORDS}, coalesce(get(twins, j + 1) - p, {WINDOW_WORDS}))),"
        " 0, (sum, n) -> sum + n)"
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("twins")


def base_failed() -> Column:
    # Products in 64 bits: a text of a few million repeated words or symbols would overflow 32.
    words, repeated = F.col("n_words").cast("bigint"), F.col("n_repeat_words").cast("bigint")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * words)


def measure(of: Measure) -> Column:
    """The measure as a whole number; 0 for texts without words."""
    part = F.col(of.part).cast("bigint") * F.lit(of.scale).cast("bigint")
    return F.when(F.col(of.whole) > 0, F.floor(part / F.col(of.whole)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def bucket(value: str) -> Column:
    """The lower end of the sketch bucket of a whole number: its six leading bits."""
    return F.expr(f"shiftleft(shiftright({value}, greatest(length(bin({value})) - 6, 0)), greatest(length(bin({value})) - 6, 0))")


def group_key(name: str) -> Column:
    """A text for a language or source that tells null from all values."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def sketches(rows: DataFrame) -> DataFrame:
    """Bucket counts per measure: of each language and source (level 2), language (1) and all rows (0)."""
    values = F.explode(
        F.array(*[F.struct(F.lit(m.name).alias("name"), measure(m).alias("value")) for m in MEASURES])
    )
    counted = (
        rows.select(group_key("lang").alias("l"), group_key("source").alias("s"), values.alias("m"))
        .select("l", "s", F.col("m.name").alias("name"), F.col("m.value").alias("value"))
        .groupBy("l", "s", "name", bucket("value").alias("low"))
        .agg(F.count("*").alias("n"))
    )
    levels = F.explode(
        F.array(
            F.struct(F.lit(2).alias("level"), F.col("l"), F.col("s")),
            F.struct(F.lit(1).alias("level"), F.col("l"), F.lit("").alias("s")),
            F.struct(F.lit(0).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
        )
    )
    return (
        counted.select(levels.alias("g"), "name", "low", "n")
        .groupBy("g.level", "g.l", "g.s", "name", "low")
        .agg(F.sum("n").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """``lang_key``, ``source_key`` and for each measure the least and most that is kept."""
    summed = sketch.selectExpr(
        "*",
        "sum(n) OVER (PARTITION BY level, l, s, name ORDER BY low) AS upto",
        "sum(n) OVER (PARTITION BY level, l, s, name) AS total",
    )
    quartiles = []
    for m in MEASURES:
        of = F.col("name") == m.name
        quartiles.append(F.min(F.when(of & (4 * F.col("upto") >= F.col("total")), F.col("low"))).alias(f"{m.name}_q1"))
        quartiles.append(F.min(F.when(of & (4 * F.col("upto") >= 3 * F.col("total")), F.col("low"))).alias(f"{m.name}_q3"))
    limits = summed.groupBy("level", "l", "s").agg(F.max("total").alias("total"), *quartiles)
    columns = []
    for m in MEASURES:
        q1, q3 = F.col(f"{m.name}_q1"), F.col(f"{m.name}_q3")
        off = REACH * (q3 - q1) + m.slack
        columns.append((q1 - off if m.both_sides else F.lit(-1).cast("bigint")).alias(f"{m.name}_least"))
        columns.append((q3 + off).alias(f"{m.name}_most"))
    limits = checkpointed(limits.select("level", "l", "s", "total", *columns))
    # The finest level with enough rows, for every language and source.
    groups = limits.where("level = 2").select(F.col("l").alias("lang_key"), F.col("s").alias("source_key"))
    candidates = groups.select(
        "lang_key",
        "source_key",
        F.explode(
            F.array(
                F.struct(F.lit(2).alias("level"), F.col("lang_key").alias("l"), F.col("source_key").alias("s")),
                F.struct(F.lit(1).alias("level"), F.col("lang_key").alias("l"), F.lit("").alias("s")),
                F.struct(F.lit(0).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
            )
        ).alias("g"),
    ).select("lang_key", "source_key", "g.*")
    names = [n for m in MEASURES for n in (f"{m.name}_least", f"{m.name}_most")]
    chosen = (
        candidates.join(limits, ["level", "l", "s"])
        .where((F.col("total") >= LEAST_ROWS) | (F.col("level") == 0))
        .groupBy("lang_key", "source_key")
        .agg(F.max(F.struct("level", *names)).alias("limits"))
    )
    return chosen.select("lang_key", "source_key", "limits.*").drop("level")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """For each row ``doc_id``, its counts, ``base_failed`` and ``kept``; ``text_hash`` and the measures follow."""
    counts = checkpointed(text_counts(docs).withColumn("base_failed", base_failed()))
    limits = fences(sketches(counts.where("NOT base_failed")))
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "text_hash",
        group_key("lang").alias("lang_key"), group_key("source").alias("source_key"),
        F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt"),
        *[measure(m).alias(m.name) for m in MEASURES],
    )
    within = F.lit(True)
    for m in MEASURES:
        within &= F.col(m.name).between(F.col(f"{m.name}_least"), F.col(f"{m.name}_most"))
    judged = rows.join(salted, ["lang_key", "source_key", "salt"], "left")
    return judged.select(
        "doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
        "text_hash",
        *[m.name for m in MEASURES],
    )
