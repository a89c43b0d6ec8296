"""From source files to declaration chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import chunk_id, detect_language
from codeloom.operators import extract_brace, extract_python
from codeloom.operators.lines import by_path
from codeloom.operators.patterns import PATTERNS, Pattern, compiling, in_mode

CHUNK_COLUMNS = [
    "id", "content", "file_path", "function_name", "class_name", "start_line", "end_line", "language", "chunk_type",
]


def rejects(files: DataFrame) -> DataFrame:
    """Files of an unsupported type with the message that reading them gives."""
    unsupported = files.where(detect_language(F.col("path")).isNull())
    return unsupported.select("path", F.concat(F.lit("unsupported file type: "), "path").alias("message"))


def spans(partitioned: DataFrame, mode: str, patterns: Sequence[Pattern]) -> DataFrame:
    """Spans and owners of the files of one pattern family. ``partitioned`` comes from ``by_path``."""
    if patterns[0].language == "python":
        return extract_python.with_owner(extract_python.spans(partitioned, patterns, mode))
    return extract_brace.spans(partitioned, patterns).withColumn("owner", F.lit(None).cast("string"))


def with_content(found: DataFrame, partitioned: DataFrame) -> DataFrame:
    """Flat chunk rows from spans and the files they lie in.

    Both sides are already placed by ``path``. The content is a slice of the file's line
    array, so it costs the length of the chunk, not the length of the file.
    """
    joined = found.join(partitioned.select("path", F.split("text", "\n", -1).alias("lines")), "path")
    taken = F.slice("lines", F.col("s"), F.col("e") - F.col("s") + 1)
    text = F.array_join(taken, "\n")
    dropped = F.length(F.element_at("lines", F.col("e"))) - F.col("ecol")
    content = text.substr(F.col("scol"), F.length(text) - F.col("scol") + 1 - dropped)
    if "style" in found.columns:
        joined = joined.withColumn("content", content)
        names = extract_brace.declared_names(F.col("content"), F.col("language"), F.col("chunk_type"))
        names = F.when(F.col("style") == "names", names).otherwise(F.array("name"))
        joined = joined.withColumn("name", F.explode(names))
        content = F.col("content")
    is_class = F.col("chunk_type") == "classes"
    return joined.select(
        chunk_id(F.col("path"), F.col("name"), F.col("chunk_type"), F.col("s")).alias("id"),
        content.alias("content"),
        F.col("path").alias("file_path"),
        F.when(is_class, "").otherwise(F.col("name")).alias("function_name"),
        F.when(is_class, F.col("name")).otherwise(F.coalesce("owner", F.lit(""))).alias("class_name"),
        F.col("s").cast("int").alias("start_line"),
        F.col("e").cast("int").alias("end_line"),
        "language",
        F.when(F.col("owner").isNotNull(), "methods").otherwise(F.col("chunk_type")).alias("chunk_type"),
    )


def chunks(
    files: DataFrame,
    mode: str = "effective",
    patterns: Sequence[Pattern] = PATTERNS,
    arrows: bool = False,
) -> DataFrame:
    """Chunk rows (flat ``CHUNK``) of ``files``: a set, order it with ``ordered``.

    Indented and braced languages are separate branches over disjoint files. In each one
    whole files are shuffled once; the span side and the content side share that exchange.
    """
    active = compiling(files.sparkSession, in_mode(patterns, mode, arrows))
    families = [
        [p for p in active if p.language == "python"],
        [p for p in active if p.language in extract_brace.LANGUAGES],
    ]
    branches = []
    for family in filter(None, families):
        partitioned = by_path(files, sorted({p.language for p in family}))
        branches.append(with_content(spans(partitioned, mode, family), partitioned))
    if not branches:
        raise ValueError("no active pattern")
    return reduce(DataFrame.unionByName, branches)


def ordered(found: DataFrame) -> DataFrame:
    """The deterministic order of chunks (a global sort: for output, not inside a plan)."""
    return found.orderBy("file_path", "start_line", "chunk_type", "id")
