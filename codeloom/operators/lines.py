"""The line model: one row per source line, with what later operators need of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexis
from codeloom.functions.text import detect_language, repaired_text
from codeloom.session import placed_by


def text_files(files: DataFrame) -> DataFrame:
    """FILE rows as ``(path, text)``; accepts bytes in ``content`` or ready ``text``."""
    text = F.col("text") if "text" in files.columns else repaired_text(F.col("content"))
    return files.select("path", text.alias("text"))


def by_path(files: DataFrame, languages: list[str]) -> DataFrame:
    """The files of ``languages``, shuffled once as whole rows on ``path``.

    It is the only exchange of the extraction: every later window and join needs the
    rows of one file together, and ``(path, ...)`` is satisfied by ``path``. A file is
    one row, so a partition key never holds more than one file.
    """
    return placed_by(text_files(files).where(detect_language(F.col("path")).isin(languages)), "path")


def line_model(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """1-based line number, indent, blank flag of every line of ``text``."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "txt"))
    return lines.select(
        key,
        (F.col("pos") + 1).alias("ln"),
        "txt",
        lexis.indent_width(lexis.plain_blanks(F.col("txt"))).alias("ind"),
        (F.trim(lexis.plain_blanks(F.col("txt")), F.lit(lexis.BLANKS)) == "").alias("blank"),
    )


def masked_lines(partitioned: DataFrame, languages: list[str]) -> DataFrame:
    """Non-blank masked lines ``(path, language, ln, mask, code)`` plus one end-of-file row.

    The end-of-file row lets every span end at *some* later row.
    """
    files = partitioned.select("path", detect_language(F.col("path")).alias("language"), "text")
    lines = F.split(lexis.masked(F.col("text"), F.col("language"), languages), "\n", -1)
    rows = files.select(
        "path",
        "language",
        F.posexplode(F.concat(lines, F.array(F.lit(lexis.END_OF_FILE)))).alias("pos", "mask"),
    )
    rows = rows.select(
        "path",
        "language",
        (F.col("pos") + 1).alias("ln"),
        lexis.right_trimmed(F.col("mask")).alias("mask"),
    ).where(F.col("mask") != "")
    return rows.withColumn("code", lexis.uncommented(F.col("mask")))


def line_facts(partitioned: DataFrame, languages: list[str]) -> DataFrame:
    """Per non-blank line: does it start inside a string, at which bracket depth, and where its code ends."""
    change = lexis.bracket_change(F.col("code"))
    running = Window.partitionBy("path").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = masked_lines(partitioned, languages).where(F.col("mask") != lexis.END_OF_FILE)
    return rows.select(
        "path",
        "language",
        "ln",
        F.col("code").startswith(lexis.STRING_FILL).alias("in_string"),
        (F.sum(change).over(running) - change).alias("depth"),
        F.length("code").alias("code_end"),
    )
