"""Counts and sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEGABYTE = 1024 * 1024


def collection_report(rows: DataFrame, collection: str = "collection") -> DataFrame:
    """Documents per collection and the number of collections."""
    counted = rows.groupBy(collection).agg(F.count("*").alias("documents"))
    total = counted.agg(F.count("*").alias("collections"))
    return counted.withColumn("collections", total.scalar())


def run_report(files: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Files found before any processing, and files whose request succeeded."""
    found = files.agg(F.count("*").alias("files_found"))
    ok = acknowledged.agg(F.count_if(F.col("status") == "success").alias("files_ok"))
    return found.withColumn("files_ok", ok.scalar())


def footprint(entries: DataFrame, names: Sequence[str]) -> DataFrame:
    """Megabytes below the directories whose name contains ``name``; null when none does.

    ``entries`` are ``(directory, length)`` rows; ``/`` in a name stands for ``_`` or ``--``.
    All names are summed in one pass, without a join.
    """
    sums = []
    for number, name in enumerate(names):
        hit = F.contains(F.col("directory"), F.lit(name.replace("/", "_"))) | F.contains(F.col("directory"), F.lit(name.replace("/", "--")))
        sums.append(F.sum(F.when(hit, F.col("length"))).alias(f"n{number}"))
    total = entries.agg(*sums)
    rows = [F.struct(F.lit(name).alias("name"), (F.col(f"n{i}") / MEGABYTE).alias("megabytes")) for i, name in enumerate(names)]
    return total.select(F.inline(F.array(*rows)).alias("name", "megabytes"))
