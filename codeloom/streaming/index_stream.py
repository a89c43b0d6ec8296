"""Continuous indexing: request lines in, upserted rows and acknowledgements out."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import encode
from codeloom.operators.requests import accepted_chunks, acks, parsed
from codeloom.operators.store import Collection, latest

DESCRIPTION = "Declarations of source files, encoded for nearest-neighbour questions"
COLLECTION = "code_chunks"
#: Characters of documents that one task encodes.
CHARS_PER_TASK = 1 << 20


def _tasks(rows: DataFrame) -> int:
    """Tasks to encode the chunks of parsed requests in, so that one has about ``CHARS_PER_TASK`` characters of them.

    Words and trigrams take a few hundred bytes for each character, and all of a task's chunks are counted together;
    merged by their size in bytes, the tasks would take on more with every larger batch.
    """
    chars = F.aggregate("chunks", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.coalesce(F.length(c["content"]), F.lit(0)))
    total = rows.where(F.col("error").isNull()).agg(F.sum(chars)).first()[0] or 0
    # Into the session's own number the rows are placed already: Spark would leave the step out, and merge.
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, math.ceil(total / CHARS_PER_TASK))


def index_batch(
    requests: DataFrame,
    collection: Collection,
    batch: tuple[str, int],
    ack_path: str,
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> None:
    """Index one bounded set of request lines and write its acknowledgements. ``batch`` names the writer and its batch.

    Both writes replace what an interrupted try of the same batch left behind. The
    acknowledgements come last: a request is never acknowledged before it is stored.
    """
    order = F.struct("modified", "session", "line_no")
    rows = parsed(requests).persist()
    try:
        newest = latest(accepted_chunks(rows, order), order=("position",))
        newest = newest.repartition(_tasks(rows), "id")
        seq = collection.upsert(encoder.add_vectors(newest, "id", "document", placed=True), batch, unique=True)
        acks(rows).write.mode("overwrite").parquet(f"{ack_path}/batch_seq={seq}")
    finally:
        rows.unpersist()


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """The stream's name as a writer, kept with its checkpoint so that a restart finds it."""
    path = f"{checkpoint.rstrip('/')}/writer"
    hadoop = spark._jvm.org.apache.hadoop.fs
    marker = hadoop.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        name = f"stream-{uuid.uuid4().hex}"
        spark.range(1).select(F.lit(name).alias("writer")).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["writer"]


def start(
    requests: DataFrame,
    collection: Collection,
    checkpoint: str,
    ack_path: str,
    available_now: bool = False,
    encoder: encode.Encoder = encode.TRIGRAMS,
) -> StreamingQuery:
    """Start the stream over ``stream_requests``. Bad requests only cost an error acknowledgement."""
    collection.get_or_create(DESCRIPTION)
    writer_name = _writer(requests.sparkSession, checkpoint)

    def handle(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch, collection, (writer_name, batch_id), ack_path, encoder)

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
