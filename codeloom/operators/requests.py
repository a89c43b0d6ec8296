"""Index requests: JSON lines in, one acknowledgement per request out.

A request is ``{"meta": {"id": ...}, "chunks": [{"id", "content", "metadata"}, ...]}``.
It is good or bad as a whole: one bad chunk fails all of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import stripped

STOP = "exit"

# What an operation on the wrong JSON type answers.
_TYPE_NAMES = {"VOID": "NoneType", "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "DOUBLE": "float"}

CHUNKS_DDL = "array<struct<id: string, content: string, metadata: map<string, string>>>"


def request_lines(found: DataFrame) -> DataFrame:
    """One JSON line per file from flat chunk rows: ``(file_path, n_chunks, value)``.

    Files without chunks give no line; empty names are left out of the JSON.
    """
    optional = [F.nullif(F.col(name), F.lit("")).alias(name) for name in ("function_name", "class_name")]
    metadata = F.struct("file_path", *optional, "start_line", "end_line", "language", "chunk_type")
    chunk = F.struct("start_line", "chunk_type", F.struct("id", "content", metadata.alias("metadata")).alias("chunk"))
    grouped = found.groupBy("file_path").agg(F.array_sort(F.collect_list(chunk)).alias("sorted"))
    return grouped.select(
        "file_path",
        F.size("sorted").alias("n_chunks"),
        F.col("sorted.chunk.id").alias("chunk_ids"),
        F.to_json(F.struct(F.col("sorted.chunk").alias("chunks"))).alias("value"),
    )


def session_lines(sessions: DataFrame, session: str = "session", text: str = "text") -> DataFrame:
    """Lines of whole sessions up to the first empty line or ``exit``: ``(session, line_no, value)``."""
    lines = F.transform(F.split(text, "\n", -1), stripped)
    ends = F.array_position(F.transform(lines, lambda line: line.isin("", STOP)), F.lit(True))
    kept = F.when(ends > 0, F.slice(lines, F.lit(1), (ends - 1).cast("int"))).otherwise(lines)
    return sessions.select(
        *[c for c in sessions.columns if c != text], F.posexplode(kept).alias("line_no", "value")
    )


def _type_of(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = None
    for sql_type, name in _TYPE_NAMES.items():
        named = (F.when if named is None else named.when)(kind == sql_type, name)
    return named.when(kind.startswith("ARRAY"), "list").when(kind.startswith("DECIMAL"), "float").otherwise("dict")


def parsed(requests: DataFrame) -> DataFrame:
    """Adds ``request_id``, ``generated_id``, ``chunks`` and ``error`` (null when good) to ``value`` rows.

    A request without an id of its own gets a digest of its text: unlike a random id it
    is the same when a lost task runs again.
    """
    rows = requests.withColumn("doc", F.try_parse_json("value"))
    part = lambda path: F.expr(f"try_variant_get(doc, '{path}', 'variant')")
    rows = (
        rows.withColumn("doc_type", F.when(F.col("doc").isNotNull(), _type_of(F.col("doc"))))
        .withColumn("meta", part("$.meta"))
        .withColumn("chunk_part", part("$.chunks"))
        .withColumn("given_id", F.expr("try_variant_get(doc, '$.meta.id', 'string')"))
        .withColumn("null_id", F.coalesce(F.is_variant_null(part("$.meta.id")), F.lit(False)))
    )
    meta_type = F.when(F.col("meta").isNotNull(), _type_of(F.col("meta")))
    chunk_type = F.when(F.col("chunk_part").isNotNull(), _type_of(F.col("chunk_part")))
    rows = rows.withColumn("items", F.expr("try_variant_get(chunk_part, '$', 'array<variant>')"))
    rows = rows.withColumn(
        "chunks",
        F.transform(
            "items",
            lambda item: F.struct(
                F.try_variant_get(item, "$.id", "string").alias("id"),
                F.try_variant_get(item, "$.content", "string").alias("content"),
                F.coalesce(
                    F.try_variant_get(item, "$.metadata", "map<string,string>"), F.expr("cast(map() AS map<string,string>)")
                ).alias("metadata"),
                F.when(_type_of(item) != "dict", "chunk is not an object")
                .when(F.try_variant_get(item, "$.id", "variant").isNull(), "'id'")
                .when(F.try_variant_get(item, "$.content", "variant").isNull(), "'content'")
                .when(~(F.schema_of_variant(F.try_variant_get(item, "$.id", "variant")) == "STRING"), "id is not a string")
                .when(
                    ~(F.schema_of_variant(F.try_variant_get(item, "$.content", "variant")) == "STRING"),
                    "content is not a string",
                )
                .alias("problem"),
            ),
        ),
    )
    problems = F.filter("chunks.problem", lambda problem: problem.isNotNull())
    ids = F.col("chunks.id")
    no_attribute = lambda kind: F.concat(F.lit("'"), kind, F.lit("' object has no attribute 'get'"))
    text = F.expr("try_variant_get(chunk_part, '$', 'string')")
    falsy = (
        F.col("chunk_part").isNull()
        | chunk_type.isin("NoneType")
        | ((chunk_type == "list") & (F.coalesce(F.size("items"), F.lit(0)) <= 0))
        | ((chunk_type == "dict") & (F.to_json("chunk_part") == "{}"))
        | ((chunk_type == "str") & (text == ""))
        | ((chunk_type == "bool") & (text == "false"))
        | (chunk_type.isin("int", "float") & (text.try_cast("double") == 0))
    )
    error = (
        F.when(F.col("doc").isNull(), "Invalid JSON: the line is not a JSON document")
        .when(F.col("doc_type") != "dict", no_attribute(F.col("doc_type")))
        .when(meta_type.isNotNull() & (meta_type != "dict"), no_attribute(meta_type))
        .when(falsy, "No chunks provided")
        .when(chunk_type != "list", "chunks is not a list")
        .when(F.size(problems) > 0, problems[0])
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate ids in one request")
    )
    has_id = F.col("given_id").isNotNull() & (F.col("doc_type") == "dict")
    generated = ~has_id & ~F.col("null_id")
    return rows.select(
        *requests.columns,
        F.when(has_id, F.col("given_id")).when(generated, F.sha2("value", 256)).alias("request_id"),
        generated.alias("generated_id"),
        F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), c["content"].alias("content"), c["metadata"].alias("metadata"))).alias("chunks"),
        error.alias("error"),
    )


def acks(rows: DataFrame) -> DataFrame:
    """ACK rows of parsed requests; ``indexed_count`` is the number of chunks received."""
    good = F.col("error").isNull()
    kept = [c for c in rows.columns if c not in ("value", "request_id", "chunks", "error")]
    return rows.select(
        *kept,
        F.col("request_id").alias("id"),
        F.when(good, "success").otherwise("error").alias("status"),
        F.col("error").alias("message"),
        F.when(good, F.size("chunks").cast("long")).alias("indexed_count"),
    )


def accepted_chunks(rows: DataFrame, position: Column) -> DataFrame:
    """Chunks of the good requests: ``(id, document, metadata, position)``.

    ``position`` orders requests; the place of a chunk in its request decides further.
    """
    good = rows.where(F.col("error").isNull()).withColumn("at", position)
    listed = good.select("at", F.posexplode("chunks").alias("place", "chunk"))
    return listed.select(
        F.col("chunk.id").alias("id"),
        F.col("chunk.content").alias("document"),
        F.col("chunk.metadata").alias("metadata"),
        F.struct("at", "place").alias("position"),
    )


def ack_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("requests"), F.sum("indexed_count").alias("chunks"))
