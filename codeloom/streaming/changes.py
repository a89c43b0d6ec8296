"""Keyed streaming state: the rows of a key are emitted only when what the key holds has changed.

Each row carries a ``digest``. For every key the state keeps one version: the digest of the sorted distinct row
digests that the key had in the last batch that held it. A batch emits a key's rows (one per distinct digest) only
if their version differs from the stored one, and stores the new version. A replayed request therefore writes
nothing, an edited one writes the rows of its key again. The state lives in the checkpoint, so a restart, or a lost
executor, continues from the last committed batch.

A call to the state costs about a millisecond, so keys share it: they are dealt by hash into ``BUCKETS`` buckets, and one
value holds the versions of all keys of a bucket, read once and written at most once a batch. A batch costs at most
``BUCKETS`` such calls however many keys it has; a task holds the rows and the versions of one bucket at a time.

State in value columns needs a state store with column families; the session's provider is set to RocksDB when it
names another. Rows with a null key form one key of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets that the keys share. The state of a stream depends on it: keep it with the checkpoint.
BUCKETS = 2_048
#: Not with an underscore in front: pandas rows lose such names on their way to the state.
_KEY, _BUCKET = "changes_key", "changes_bucket"


class _Versions(StatefulProcessor):
    """Versions of the keys of one bucket, as a JSON object."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getValueState("versions", "versions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Pieces without rows come without columns.
        pieces = [piece.drop_duplicates([_KEY, "digest"]) for piece in rows if len(piece)]
        if not pieces:
            return
        held = pd.concat(pieces, ignore_index=True).drop_duplicates([_KEY, "digest"]).sort_values([_KEY, "digest"], kind="stable")
        digests: dict[str, list[str]] = {}
        for name, digest in zip(held[_KEY].to_list(), held["digest"].to_list(), strict=True):
            digests.setdefault(name, []).append(digest)
        stored = self.versions.get()
        versions = json.loads(stored[0]) if stored else {}
        new = {name: hashlib.sha256(",".join(of).encode()).hexdigest() for name, of in digests.items()}
        new = {name: version for name, version in new.items() if versions.get(name) != version}
        if not new:
            return
        self.versions.update((json.dumps(versions | new, separators=(",", ":")),))
        yield held[held[_KEY].isin(new.keys())].drop(columns=[_KEY, _BUCKET], errors="ignore")

    def close(self) -> None:
        pass


def _key_digest(rows: DataFrame, keys: list[str]) -> Column:
    """A digest that is the same for two rows exactly if ``groupBy(keys)`` puts them together (null with null, -0.0 with 0.0)."""
    parts = []
    for name in keys:
        value, kind = F.col(name), rows.schema[name].dataType
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)
        elif isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        text = value.cast("string")
        parts.append(F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.md5(F.concat(*parts))


def changed(stream: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """The rows of ``stream`` (with ``digest``) of every key whose held rows changed since its last batch."""
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER, None) != ROCKSDB:
        spark.conf.set(_PROVIDER, ROCKSDB)
    rows = stream.withColumn("digest", digest)
    # Whole numbers travel as text: beside a null of another key, pandas would make them floating point numbers.
    whole = [f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)]
    columns = [F.col(f.name).cast("string").alias(f.name) if f.name in whole else F.col(f.name) for f in rows.schema]
    key = _key_digest(rows, keys)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    placed = rows.select(*columns, key.alias(_KEY), bucket.alias(_BUCKET))
    found = placed.groupBy(_BUCKET).transformWithStateInPandas(
        _Versions(), outputStructType=placed.drop(_KEY, _BUCKET).schema, outputMode="Append", timeMode="None"
    )
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns' texts, null as empty, joined by U+0001."""
    parts = []
    for i, name in enumerate(columns):
        parts += ([F.lit("\u0001")] if i else []) + [F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.sha2(F.concat(*parts), 256)
