"""Keyed collections: pure table operations and their storage as parquet segments.

A collection is a folder with one ``delta/batch_seq=N`` segment per write and, after a
compaction, ``base/v=N`` with everything up to batch N. A write costs the size of its
batch, never the size of the collection. A writer that may repeat a batch names itself and the batch;
the number of the segment is fixed at the first try, so replays after a lost executor or driver
change nothing, and no other writer can take that number. One write at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of columns that can be hashed.
_PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType)


def latest(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("batch_seq", "position")) -> DataFrame:
    """The last row of every key. An aggregate, so copies of a hot key shrink before the shuffle.

    Rows that are equal in ``order`` are told apart by a hash of their plain columns, so that a run gives
    the same row as any other. The key itself stays a grouping column: later steps by key then need no exchange.
    """
    rest = F.struct(*[name for name in rows.columns if name != key])
    plain = [f.name for f in rows.schema if f.name != key and isinstance(f.dataType, _PLAIN)]
    place = F.struct(*order, F.xxhash64(*plain).alias("tie")) if plain else F.struct(*order)
    picked = rows.groupBy(key).agg(F.max_by(rest, place).alias("row"))
    return picked.select(key, "row.*").select(*rows.columns)


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` with every key of ``incoming`` replaced or added."""
    newest = latest(incoming, key)
    kept = stored.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest)


def added(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` plus the rows of ``incoming`` whose key is new; stored rows stay as they are."""
    return stored.unionByName(without(latest(incoming, key), stored, key))


def members(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the set ``of``."""
    return rows.join(of.select(key), key, "left_semi")


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``removed``."""
    return rows.join(removed.select(key), key, "left_anti")


def as_set(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct()


def newest_segment(rows: DataFrame, key: str = "id", segment: str = "batch_seq") -> DataFrame:
    """Rows of the newest segment of every key; a key occurs once per segment.

    Only keys that occur again take part in the join: usually a small side.
    """
    again = rows.groupBy(key).agg(F.max(segment).alias("newest"), F.count("*").alias("times"))
    again = again.where("times > 1").select(key, "newest")
    joined = rows.join(again, key, "left")
    return joined.where(F.col("newest").isNull() | (F.col(segment) == F.col("newest"))).drop("newest")


class CollectionNotFound(LookupError):
    pass


class LayoutMismatch(ValueError):
    """Rows with other columns or types than those that the collection holds."""


class Collection:
    """A keyed collection below ``root``. Rows need ``id``, ``batch_seq`` and ``position``."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.name = spark, name
        self.path = f"{root.rstrip('/')}/{name}"

    def _fs(self) -> tuple[object, object]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the finished writes below ``folder``."""
        fs, hadoop = self._fs()
        parent = hadoop.Path(f"{self.path}/{folder}")
        if not fs.exists(parent):
            return []
        found = []
        for status in fs.listStatus(parent):
            name = status.getPath().getName()
            if name.startswith(prefix) and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name[len(prefix) :]))
        return sorted(found)

    def exists(self) -> bool:
        fs, hadoop = self._fs()
        return fs.exists(hadoop.Path(f"{self.path}/about/_SUCCESS"))

    def get_or_create(self, description: str = "") -> Collection:
        if not self.exists():
            about = self.spark.range(1).select(F.lit(self.name).alias("name"), F.lit(description).alias("description"))
            about.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")
        return self

    def get(self) -> Collection:
        if not self.exists():
            raise CollectionNotFound(self.name)
        return self

    def drop(self) -> None:
        """Remove the collection; a missing one is not an error."""
        fs, hadoop = self._fs()
        fs.delete(hadoop.Path(self.path), True)

    def last_seq(self) -> int:
        """The highest number of a finished write."""
        return max([-1, *self._numbers("delta", "batch_seq="), *self._numbers("base", "v=")])

    def _claims(self) -> list[tuple[str, int]]:
        """Batches of named writers with the numbers they have taken."""
        fs, hadoop = self._fs()
        folder = hadoop.Path(f"{self.path}/claims")
        names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
        return [(batch, int(seq)) for batch, seq in (name.rsplit("=", 1) for name in names)]

    def _claimed(self, batch: str) -> tuple[int, bool]:
        """The number of a writer's batch, fixed at its first try, and whether its rows are part of a base already."""
        claims, finished, bases = self._claims(), set(self._numbers("delta", "batch_seq=")), self._numbers("base", "v=")
        folded = max(bases, default=-1)
        own = [seq for name, seq in claims if name == batch]
        for seq in own:
            if seq in finished or seq > folded:
                return seq, seq <= folded
        # New, or an unfinished try that a compaction has passed by.
        seq = max([self.last_seq(), *(seq for _, seq in claims)]) + 1
        fs, hadoop = self._fs()
        fs.mkdirs(hadoop.Path(f"{self.path}/claims/{batch}={seq}"))
        return seq, False

    def _check_layout(self, rows: DataFrame) -> None:
        """All segments have the columns and types of the first write, kept beside it."""
        path = f"{self.path}/layout"
        layout = ", ".join(sorted(f"{name} {kind}" for name, kind in rows.dtypes if name != "batch_seq"))
        fs, hadoop = self._fs()
        if not fs.exists(hadoop.Path(f"{path}/_SUCCESS")):
            self.spark.range(1).select(F.lit(layout).alias("layout")).coalesce(1).write.mode("overwrite").parquet(path)
            return
        stored = self.spark.read.parquet(path).first()["layout"]
        if stored != layout:
            raise LayoutMismatch(f"{self.name} holds rows of ({stored}), not ({layout})")

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None, unique: bool = False) -> int:
        """Write one batch; within it the highest position of an id wins. Returns its number.

        ``batch`` names a writer and the writer's own number of the batch, for writes that may be tried
        again: every try writes the same segment. ``unique`` says that no id occurs twice in ``rows``.
        """
        self._check_layout(rows)
        if batch is None:
            seq, done = max([self.last_seq(), *(seq for _, seq in self._claims())]) + 1, False
        else:
            seq, done = self._claimed(f"{batch[0]}-{batch[1]}")
        if not done:
            newest = rows if unique else latest(rows, order=("position",))
            newest.write.mode("overwrite").parquet(f"{self.path}/delta/batch_seq={seq}")
        return seq

    def add(self, rows: DataFrame) -> int:
        """Write only the rows whose id is not stored yet."""
        if self.last_seq() < 0:
            return self.upsert(rows)
        return self.upsert(without(rows, self.rows(), "id"))

    def _segments(self, folder: str, prefix: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.path}/{folder}/{prefix}{n}" for n in numbers]
        return self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(*paths)

    def rows(self) -> DataFrame:
        """The current rows, one per id.

        Ids are unique within a segment. So only ids are compared across segments, a
        single segment is read as it is, and columns nobody asks for are not read.
        """
        self.get()
        bases = self._numbers("base", "v=")[-1:]
        newer = [n for n in self._numbers("delta", "batch_seq=") if not bases or n > bases[0]]
        if not bases and not newer:
            raise CollectionNotFound(f"{self.name} has no rows yet")
        if not newer:
            return self._segments("base", "v=", bases).drop("v")
        delta = self._segments("delta", "batch_seq=", newer)
        delta = delta.withColumn("batch_seq", F.col("batch_seq").cast("long"))
        current = delta if len(newer) == 1 else newest_segment(delta)
        if not bases:
            return current
        base = self._segments("base", "v=", bases).drop("v")
        return without(base, delta, "id").unionByName(current)

    def count(self) -> int:
        return self.rows().count() if self.last_seq() >= 0 else 0

    def compact(self) -> None:
        """Fold all segments into a new base; readers of older files are not disturbed."""
        seq = self.last_seq()
        if seq >= 0 and seq not in self._numbers("base", "v="):
            self.rows().write.mode("overwrite").parquet(f"{self.path}/base/v={seq}")

