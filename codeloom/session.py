"""Session helpers: defaults for local runs and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Folders of sessions on a local master that name none.
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(app: str, cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. Clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cores))
    builder = builder.config("spark.driver.memory", memory)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is a cluster."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Executors must all be able to write to it, so a machine-local folder is only
    ever chosen on a local master; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="codeloom-")
    return _LOCAL_FOLDERS[application]


def placed_by(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled on ``keys`` into the session's number of shuffle partitions.

    The explicit number keeps adaptive execution from merging partitions by their size in
    bytes: what follows is heavy on computation, so small partitions are still worth a task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
