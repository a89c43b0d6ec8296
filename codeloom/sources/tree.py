"""Directory trees as FILE rows, names starting with ``_`` or ``.`` included.

Spark's own file sources skip such names, and ``__init__.py`` is one of them. The tree is
listed by Spark stages, one for each level; the listed paths are then spread evenly before
any content is read, so a subtree with a large share of the files costs one task its listing only.
Skipped directories are never entered, other extensions are never opened, and a failing
listing or read fails the query.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import SKIPPED_DIRECTORIES
from codeloom.schemas import FILE
from codeloom.session import placed_by, shared_folder

_BYTES_PER_BATCH = 32 << 20


def _extension(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:] if dot >= 0 else ""


def _lister(extensions: set[str], skipped: set[str]):
    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For every path of the frontier: its subdirectories to enter and its files to take; links not followed."""
        for frame in frames:
            kinds, paths, lengths = [], [], []
            for path in frame["path"]:
                if not os.path.isdir(path):
                    os.stat(path)  # a missing path fails the query
                    if _extension(os.path.basename(path)) in extensions:
                        kinds.append("file"), paths.append(path), lengths.append(os.path.getsize(path))
                    continue
                with os.scandir(path) as entries:
                    for entry in entries:
                        if entry.is_dir(follow_symlinks=False):
                            if entry.name not in skipped:
                                kinds.append("dir"), paths.append(entry.path), lengths.append(None)
                        elif _extension(entry.name) in extensions:
                            kinds.append("file"), paths.append(entry.path), lengths.append(os.path.getsize(entry.path))
            yield pd.DataFrame({"kind": kinds, "path": paths, "length": pd.array(lengths, "Int64")})

    return listed


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` written once below the shared folder, lineage cut."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def tree_listing(
    spark: SparkSession,
    root: str,
    extensions: Iterable[str] = (".py",),
    skipped: Iterable[str] = SKIPPED_DIRECTORIES,
) -> DataFrame:
    """``(path, length)`` of the files below ``root``, without opening them.

    The tree is walked level by level: the frontier of directories is a table, each level is listed by the tasks
    (the directories spread over the shuffle partitions) and written below the shared folder, and the next frontier is
    the directories it found. The driver lists nothing; it only asks whether a frontier is empty. A directory with
    very many entries is one task's listing. On a cluster the tree lies on a file system that the executors mount.
    """
    wanted, skip = set(extensions), set(skipped)
    found = []
    frontier = spark.createDataFrame([(root,)], "path string")
    if os.path.basename(root.rstrip("/")) in skip:
        frontier = frontier.where("false")
    while True:
        level = _written(placed_by(frontier, "path").mapInPandas(_lister(wanted, skip), "kind string, path string, length bigint"))
        found.append(level.where(F.col("kind") == "file").select("path", "length"))
        frontier = level.where(F.col("kind") == "dir").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    paths: list[str] = []
    contents: list[bytes] = []
    held = 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as file:
                data = file.read()
            paths.append(path)
            contents.append(data)
            held += len(data)
            if held >= _BYTES_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=schema)
                paths, contents, held = [], [], 0
    if paths:
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=schema)


def read_files(listing: DataFrame) -> DataFrame:
    """FILE rows of listed paths, read whole, the reading spread over all tasks."""
    return placed_by(listing.select("path"), "path").mapInArrow(_read_batches, FILE)


def source_tree(spark: SparkSession, root: str, extensions: Iterable[str] = (".py",)) -> DataFrame:
    """FILE rows below ``root``."""
    return read_files(tree_listing(spark, root, extensions))
