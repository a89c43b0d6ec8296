"""Request sources: whole text files as sessions, bounded or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.requests import session_lines


def _sessions(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("session"),
        F.col("value").alias("text"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(modified, session, line_no, value)`` of the request files in ``path``."""
    return session_lines(_sessions(spark.read.option("wholetext", True).text(path)))


def stream_requests(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same lines as a stream; ``files_per_batch`` is the flow control."""
    raw = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return session_lines(_sessions(raw))
