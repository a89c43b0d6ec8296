"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from codeloom.session import shared_folder

#: Texts are worked on in pieces of about this many characters, so that memory does not follow the longest text.
PIECE_CHARS = 1 << 16

#: A space between two characters that are not white space.
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written once below the shared folder, with their lineage cut.

    Lost executors cost no recomputation, and Spark's cleaner removes the files when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def map_texts(
    rows: DataFrame, columns: list[str], schema: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]
) -> DataFrame:
    """One Arrow pass over ``columns``; ``work()`` runs once in each task and gives the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_batch = work()
        for batch in batches:
            if batch.num_rows:
                yield of_batch(batch)

    return rows.select(*columns).mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """The column's values, null as the empty text."""
    return [value or "" for value in column.to_pylist()]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut in front of single spaces between words, at least ``size`` characters apart."""
    begin = 0
    while len(text) - begin > size:
        cut = _BETWEEN_WORDS.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


_BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")


@cache
def _members(name: str, end: int) -> str:
    """The characters of a class below ``end``, written as ranges of a bracket expression."""
    found = regex.findall(f"[{name}]+", "".join(map(chr, range(end))))
    out = []
    for run in found:
        begin = previous = ord(run[0])
        for code in [*map(ord, run[1:]), -1]:
            if code != previous + 1:
                out.append(f"\\U{begin:08x}-\\U{previous:08x}")
                begin = code
            previous = code
    return "".join(out)


def _spelled_out(pattern: str, end: int) -> re.Pattern:
    """``pattern`` for ``re``, with its character classes as ranges."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part.startswith(("\\p", "\\s")):
            out.append(_members(part, end) if inside else f"[{_members(part, end)}]")
        elif part == "\\S":
            out.append(f"[^{_members('\\s', end)}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return re.compile("".join(out))


class Splitter:
    """Finds all matches of a pattern with Unicode classes (``\\p{..}``, ``\\s``).

    The standard library matches several times faster than ``regex`` but lacks such classes, so they are
    spelled out: for ASCII texts, and for texts within the basic plane. Others go to ``regex``.
    """

    def __init__(self, pattern: str) -> None:
        self.all = regex.compile(pattern).findall
        self.ascii = _spelled_out(pattern, 0x80).findall
        self.basic = _spelled_out(pattern, 0x10000).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.all(text) if _BEYOND_BMP.search(text) else self.basic(text)
