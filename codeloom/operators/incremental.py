"""Incremental refresh by checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import checksum
from codeloom.operators.store import Collection
from codeloom.schemas import MANIFEST


def manifest_of(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return files.select(key, checksum(F.col(content)).alias("sha256"))


def with_change(files: DataFrame, manifest: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Adds ``sha256`` and ``changed``: no stored checksum, or another one.

    Only digests take part in the join, so its shuffle does not carry file contents
    when the caller drops them.
    """
    stored = manifest.select(key, F.col("sha256").alias("stored"))
    rows = files.withColumn("sha256", checksum(F.col(content)))
    joined = rows.join(stored, key, "left")
    changed = F.col("stored").isNull() | (F.col("stored") != F.col("sha256"))
    return joined.withColumn("changed", changed).drop("stored")


def refresh_groups(rows: DataFrame, group: str) -> DataFrame:
    """All members of every group with at least one changed member.

    The flag is aggregated before it is joined back, so a group that holds a large part
    of all rows is neither sorted nor collected in one task.
    """
    touched = rows.where("changed").select(group).distinct()
    return rows.join(touched, group, "left_semi")


def refreshed_manifest(manifest: DataFrame, written: DataFrame, key: str = "path") -> DataFrame:
    """The manifest after ``written`` files were stored."""
    kept = manifest.join(written.select(key), key, "left_anti")
    return kept.unionByName(written.select(key, "sha256"))


def stored_manifest(manifest: Collection) -> DataFrame:
    """MANIFEST rows of a manifest collection; no rows before the first write."""
    if manifest.last_seq() < 0:
        return manifest.spark.createDataFrame([], MANIFEST)
    return manifest.rows().select(F.col("id").alias("path"), "sha256")


def store_manifest(manifest: Collection, written: DataFrame) -> int:
    """Record the checksums of ``written`` files; the others keep theirs."""
    rows = written.select(F.col("path").alias("id"), "sha256", F.lit(0).alias("position"))
    return manifest.upsert(rows, unique=True)
