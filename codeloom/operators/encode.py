"""Encoders: text to vectors.

The built-in encoder is lexical, deterministic and offline: character trigrams of the
words, hashed into a fixed number of buckets, weighted by ``1 + ln(tf)`` and brought to
unit length. A model of your own can take its place through ``model_encoder``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import placed_by

BUCKETS = 4096
BUILT_IN = "trigrams-4096"
_MULTIPLIER = 2654435761

# Words that say nothing about a piece of code or a question.
STOP_WORDS = "function def return if else to is this where class self the a".split()


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, camel case split; may hold '' and stop words."""
    return F.split(F.lower(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")), r"[^\p{L}\p{N}]+")


def bucket(framed: Column, at: Column) -> Column:
    """Bucket of the three characters of ``framed`` from ``at`` on.

    The code points make one number of 24 bits; a multiplicative hash keeps its top 12 bits.
    """
    code = F.lit(0).cast("long")
    for offset in range(3):
        code = code * 128 + F.ascii(framed.substr(at + offset, F.lit(1)))
    return F.shiftright(code.bitwiseAND((1 << 24) - 1) * _MULTIPLIER % (1 << 32), 20).cast("int")


def postings(texts: DataFrame, key: str, text: str, placed: bool = False) -> DataFrame:
    """Term weights ``(key, bucket, raw)``, not yet of unit length.

    ``key`` must be unique. Whole texts are shuffled on it once, unless the rows are
    ``placed`` by it already; the aggregations by bucket here and by key in ``encoded``
    keep that placement.
    """
    rows = texts.select(key, text)
    rows = rows if placed else placed_by(rows, key)
    found = rows.select(key, F.explode(words(F.col(text))).alias("word"))
    found = found.where((F.col("word") != "") & ~F.col("word").isin(*STOP_WORDS))
    # A word is cut into trigrams once, however often it occurs.
    counted = found.groupBy(key, "word").agg(F.count("*").alias("n"))
    framed = counted.select(
        key,
        "n",
        F.concat(F.lit("^"), "word", F.lit("$")).alias("framed"),
        F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"),
    )
    hashed = framed.select(key, "n", bucket(F.col("framed"), F.col("at")).alias("bucket"))
    return hashed.groupBy(key, "bucket").agg((F.log(F.sum("n").cast("double")) + 1).alias("raw"))


def encoded(texts: DataFrame, key: str, text: str, placed: bool = False) -> DataFrame:
    """``(key, vector)`` of every text that has a word; at most ``BUCKETS`` entries each."""
    listed = postings(texts, key, text, placed).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw"))).alias("entries"),
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
    )
    return listed.select(
        key,
        F.struct(
            F.col("entries.bucket").alias("buckets"),
            F.transform("entries.raw", lambda raw: raw / F.col("norm")).alias("weights"),
        ).alias("vector"),
    )


def as_postings(vectors: DataFrame, key: str) -> DataFrame:
    pairs = F.arrays_zip(F.col("vector.buckets").alias("bucket"), F.col("vector.weights").alias("weight"))
    return vectors.select(key, F.inline(pairs).alias("bucket", "weight"))


def model_encoder(load: Callable[[], object]) -> Callable[[Column], Column]:
    """A vectorized function from text to a dense vector.

    ``load`` runs once per Python worker and returns an object with
    ``encode(list of texts) -> list of vectors``; a failing load fails the job.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in vector] for vector in model.encode(texts.tolist())])

    return encode


class Encoder(NamedTuple):
    """A named way from text to vectors: the built-in one, or a model by its loader."""

    name: str
    load: Callable[[], object] | None = None

    def add_vectors(self, rows: DataFrame, key: str, text: str, placed: bool = False) -> DataFrame:
        """``rows`` (unique by ``key``) with their vector, null where a text has no word, and ``encoder``.

        With the built-in encoder on rows that were grouped by ``key`` (``placed``), the text
        side and the vector side read the one exchange that grouped them: whatever made the
        rows runs once and nothing is shuffled again.
        """
        if self.load is None:
            rows = rows.join(encoded(rows, key, text, placed), key, "left")
        else:
            rows = rows.withColumn("embedding", model_encoder(self.load)(F.col(text)))
        return rows.withColumn("encoder", F.lit(self.name))


TRIGRAMS = Encoder(BUILT_IN)
