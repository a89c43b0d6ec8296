"""The declaration pattern table and its compilation into Column expressions.

A pattern says how the first line of a declaration looks and how its end is found:

``indent``     the block that is indented deeper than its header
``block``      up to the closing brace of the block that the header opens
``statement``  up to the end of the statement
``inline``     like ``statement``, but anywhere in a line, and every name that the statement declares
               is a chunk of its own
``assignment`` Python assignments to plain names
``arrow``      an arrow function with a parenthesized parameter list

``mode`` is ``effective`` for declarations that are indexed by default and
``declared`` for the ones that are configured but only extracted on request.
Users add their own rows: every function that takes ``patterns`` accepts a longer
tuple.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = r"[\p{L}_][\p{L}\p{N}_]*"
SCRIPT_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"


class Pattern(NamedTuple):
    language: str
    chunk_type: str
    lead: str  # modifiers in front of the declaration that are not part of it
    head: str  # the declaration; group 1 is the name
    style: str
    mode: str = "declared"
    named: bool = True
    hint: str = ""  # text that every match contains: a cheap test in front of the expression


_EXPORT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_VISIBLE = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
# Attributes in front of a Rust item belong to the line, not to the item.
_ATTRIBUTES = r"(?:#\[(?:[^\[\]]|\[[^\[\]]*\])*\]\s*)*"

_PYTHON = (
    Pattern("python", "functions", "", rf"(?:async\s+)?def\s+({NAME})", "indent", "effective", True, "def"),
    Pattern("python", "classes", "", rf"class\s+({NAME})", "indent", "effective", True, "class"),
    Pattern("python", "variables", "", rf"({NAME})\s*[:=]", "assignment", "effective"),
    Pattern("python", "imports", "", r"(?:import\s|from\s+\S+\s+import\b)", "statement", "declared", False, "import"),
)


def _declaring(word: str) -> str:
    """``word`` in front of a name or of a group of declarations."""
    return rf"(?<![\p{{L}}\p{{N}}_.]){word}(?=\s+{NAME}|\s*\()"


_GO = (
    Pattern("go", "functions", "", rf"func\s+(?:\([^)]*\)\s*)?({NAME})\s*[\[(]", "block", "declared", True, "func"),
    Pattern("go", "types", "", _declaring("type"), "inline", "declared", True, "type"),
    Pattern("go", "variables", "", _declaring("var"), "inline", "declared", True, "var"),
    Pattern("go", "constants", "", _declaring("const"), "inline", "declared", True, "const"),
)


def _script(language: str) -> tuple[Pattern, ...]:
    return (
        Pattern(language, "functions", _EXPORT, rf"(?:async\s+)?function\s+({SCRIPT_NAME})\s*[<(]", "block", "declared", True, "function"),
        Pattern(language, "functions", "", r"=>", "arrow", "arrow", False),
        Pattern(language, "classes", _EXPORT, rf"class\s+({SCRIPT_NAME})", "block", "declared", True, "class"),
        Pattern(language, "variables", "", rf"(?<![\p{{L}}\p{{N}}_$.])(?:const|let|var)(?=\s+[^\s(])", "inline"),
    )


_TYPESCRIPT = _script("typescript") + (
    Pattern("typescript", "interfaces", _EXPORT, rf"interface\s+({SCRIPT_NAME})", "block", "declared", True, "interface"),
    Pattern("typescript", "types", _EXPORT, rf"type\s+({SCRIPT_NAME})\s*(?:<[^=]*>)?\s*=", "statement", "declared", True, "type"),
)
_RUST = (
    Pattern(
        "rust",
        "functions",
        _ATTRIBUTES,
        rf"{_VISIBLE}(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\S+\s+)?)*fn\s+({NAME})",
        "block",
        hint="fn",
    ),
    Pattern("rust", "structs", _ATTRIBUTES, rf"{_VISIBLE}struct\s+({NAME})\s*(?:<|\{{|where\b|\z)", "block", "declared", True, "struct"),
    Pattern("rust", "enums", _ATTRIBUTES, rf"{_VISIBLE}enum\s+({NAME})", "block", "declared", True, "enum"),
    Pattern("rust", "impls", _ATTRIBUTES, rf"(?:unsafe\s+)?impl\b(?:[^{{;]*\sfor\s+|\s+){NAME}\s*(?:\{{|where\b|\z)", "block", "declared", False, "impl"),
    Pattern("rust", "traits", _ATTRIBUTES, rf"{_VISIBLE}(?:unsafe\s+)?trait\s+({NAME})", "block", "declared", True, "trait"),
    Pattern("rust", "constants", _ATTRIBUTES, rf"{_VISIBLE}const\s+({NAME})\s*:", "statement", "declared", True, "const"),
    Pattern("rust", "statics", _ATTRIBUTES, rf"{_VISIBLE}static\s+(?:mut\s+)?({NAME})\s*:", "statement", "declared", True, "static"),
)

PATTERNS: tuple[Pattern, ...] = _PYTHON + _GO + _script("javascript") + _TYPESCRIPT + _RUST

MODES = {"effective": ("effective",), "declared": ("effective", "declared")}


def in_mode(patterns: Sequence[Pattern], mode: str, arrows: bool = False) -> tuple[Pattern, ...]:
    """The rows that are active in ``mode``; arrow functions have their own switch."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    wanted = MODES[mode] + (("arrow",) if arrows and mode == "declared" else ())
    return tuple(p for p in patterns if p.mode in wanted)


def compiling(spark: SparkSession, patterns: Sequence[Pattern]) -> tuple[Pattern, ...]:
    """The patterns whose expressions the JVM compiles; any other is reported as a warning and skipped.

    A failing pattern of one's own then costs its own chunks only, not the whole job.
    """
    kept = []
    for p in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(rf"^(\s*{p.lead}){p.head}")
        except Exception as error:  # noqa: BLE001 - the JVM's syntax error, reported and skipped
            warnings.warn(f"pattern skipped ({p.language}, {p.chunk_type}): {str(error).splitlines()[0]}", stacklevel=2)
            continue
        kept.append(p)
    return tuple(kept)


def of_language(language: str, patterns: Sequence[Pattern] = PATTERNS) -> tuple[Pattern, ...]:
    """The rows of one language: files of the others are then not even shuffled."""
    return tuple(p for p in patterns if p.language == language)


def pattern_table(spark: SparkSession, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    schema = T.StructType(
        [T.StructField(name, T.BooleanType() if name == "named" else T.StringType()) for name in Pattern._fields]
    )
    return spark.createDataFrame([tuple(p) for p in patterns], schema)


def matches(code: Column, patterns: Sequence[Pattern]) -> Column:
    """Array of the patterns that a line starts, as structs (chunk_type, style, name, col).

    Each pattern is a literal, so that the regular expression is compiled once per task.
    """
    found = []
    for p in patterns:
        lead = rf"^(\s*{p.lead})"
        full = lead + p.head
        name = F.regexp_extract(code, full, 2) if p.named else F.lit("")
        is_match = code.contains(p.hint) & code.rlike(full) if p.hint else code.rlike(full)
        found.append(
            F.when(
                is_match,
                F.struct(
                    F.lit(p.chunk_type).alias("chunk_type"),
                    F.lit(p.style).alias("style"),
                    name.alias("name"),
                    (F.length(F.regexp_extract(code, full, 1)) + 1).alias("col"),
                ),
            )
        )
    return F.array_compact(F.array(*found))
