"""The two end-to-end plans: index a set of files, ask a collection."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import joined_words
from codeloom.operators import encode, search
from codeloom.operators.extract import chunks
from codeloom.operators.incremental import store_manifest, stored_manifest, with_change
from codeloom.operators.patterns import PATTERNS, Pattern
from codeloom.operators.store import Collection, latest
from codeloom.session import placed_by, shared_folder
from codeloom.sources.tree import source_tree
from codeloom.streaming.index_stream import COLLECTION, DESCRIPTION


def indexed(
    files: DataFrame,
    mode: str = "effective",
    patterns: Sequence[Pattern] = PATTERNS,
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> DataFrame:
    """INDEXED rows of source files: chunk columns, vector, encoder name.

    Ids can collide when two declarations of one name share a line; the later type wins,
    as it does when both are upserted one after the other.
    """
    found = chunks(files, mode, patterns).withColumnRenamed("content", "document")
    # Ids hold path and line, so none is frequent: placing rows first loses nothing, and the
    # explicit partition number keeps the encoder on all tasks.
    unique = latest(placed_by(found, "id"), order=("chunk_type", "document"))
    return encoder.add_vectors(unique, "id", "document", placed=True)


def index_files(
    files: DataFrame,
    collection: Collection,
    mode: str = "effective",
    patterns: Sequence[Pattern] = PATTERNS,
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> int:
    """Extract, encode and upsert the chunks of ``files``; returns the number of the batch."""
    collection.get_or_create(DESCRIPTION)
    names = ("file_path", "function_name", "class_name", "start_line", "end_line", "language", "chunk_type")
    pairs = [part for name in names for part in (F.lit(name), F.col(name).cast("string"))]
    rows = indexed(files, mode, patterns, encoder)
    rows = rows.withColumn("metadata", F.create_map(*pairs)).drop(*names)
    # The layout of rows that come from requests.
    at = F.struct(
        F.lit(None).cast("timestamp").alias("modified"), F.lit("").alias("session"), F.lit(0).alias("line_no")
    )
    rows = rows.withColumn("position", F.struct(at.alias("at"), F.lit(0).alias("place")))
    return collection.upsert(rows, unique=True)


def index_directory(
    spark: SparkSession,
    root: str,
    store: str,
    extensions: tuple[str, ...] = (".py",),
    mode: str = "effective",
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> Collection:
    """Scan a tree and index it into the ``code_chunks`` collection of ``store``."""
    collection = Collection(spark, store, COLLECTION)
    index_files(source_tree(spark, root, extensions), collection, mode, encoder=encoder)
    return collection


def question(words: Column) -> Column:
    """The text of a question given as words."""
    return joined_words(words)


def refresh_directory(
    spark: SparkSession,
    root: str,
    store: str,
    extensions: tuple[str, ...] = (".py",),
    mode: str = "effective",
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> Collection:
    """Like ``index_directory``, but only for files whose checksum is new.

    The manifest is a collection of its own: reading it is a scan of digests, renewing it
    writes the changed ones. The changed files are written once below the shared folder, so that what is
    indexed and what is recorded are the same reading of the tree.
    """
    manifest = Collection(spark, store, "manifest").get_or_create("Checksums of indexed files")
    collection = Collection(spark, store, COLLECTION)
    files = source_tree(spark, root, extensions)
    folder = f"{shared_folder(spark).rstrip('/')}/changed-{uuid.uuid4().hex}"
    with_change(files, stored_manifest(manifest)).where("changed").write.parquet(folder)
    changes = spark.read.parquet(folder)
    index_files(changes.select("path", "content"), collection, mode, encoder=encoder)
    store_manifest(manifest, changes)
    return collection


def ask(
    corpus: DataFrame,
    queries: DataFrame,
    threshold: float = search.THRESHOLD,
    shown: int = search.SHOWN,
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> DataFrame:
    """HIT rows for text queries ``(query_id, text)`` on rows with ``id``, ``document`` and a vector."""
    if "encoder" in corpus.columns:
        search.check_encoder(corpus, encoder.name)
    asked = encoder.add_vectors(queries.select("query_id", "text"), "query_id", "text")
    return search.hits(corpus, asked, threshold, shown)
