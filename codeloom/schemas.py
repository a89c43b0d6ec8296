"""Fixed record layouts. Nothing in this library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())])

ACK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("indexed_count", T.LongType()),
    ]
)
