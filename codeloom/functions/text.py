"""Scalar building blocks on paths and text, all of them plain Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that a tree scan never enters.
SKIPPED_DIRECTORIES = (".venv", ".git", "node_modules", "venv", "__pycache__", ".idea", ".vscode")

# File suffix, language name and the pattern group that reads it.
EXTENSIONS = (
    (".py", "python"),
    (".go", "go"),
    (".js", "javascript"),
    (".ts", "typescript"),
    (".tsx", "typescript"),
    (".rs", "rust"),
)

SPACE_CLASS = r"[ \t\n\f\r]+"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text from the last dot of the base name, '' when there is no dot."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def in_skipped_directory(path: Column, skipped: Iterable[str] = SKIPPED_DIRECTORIES) -> Column:
    """True when any directory part of ``path`` (not the file name) is skipped."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(directories, F.array(*[F.lit(name) for name in skipped]))


def detect_language(path: Column) -> Column:
    """Language by case-sensitive suffix, null for an unsupported file."""
    chain = None
    for suffix, language in EXTENSIONS:
        hit = F.endswith(path, F.lit(suffix))
        chain = F.when(hit, language) if chain is None else chain.when(hit, language)
    return chain


def repaired_text(content: Column) -> Column:
    """Bytes as text with invalid sequences replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def normalized(text: Column) -> Column:
    """Surrounding white space removed, inner runs collapsed to one space."""
    return F.trim(F.regexp_replace(text, SPACE_CLASS, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+\z", "")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, name: Column, chunk_type: Column, start_line: Column) -> Column:
    return F.concat_ws("_", path, F.when(name != "", name).otherwise(chunk_type), start_line.cast("string"))


def joined_words(words: Column) -> Column:
    return F.array_join(words, " ")
