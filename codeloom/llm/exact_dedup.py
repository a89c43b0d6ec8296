"""Exact duplicates by progressive refinement (operator 11).

Texts are equal when they are identical after lower-casing A-Z only; of equal texts the row with the largest
doc_id stays. Equal texts have equal byte lengths (lower-casing A-Z keeps them), equal heads and equal digests,
so the rows are refined in three levels, each deciding only among the rows the level before left open:

1. by byte length: a length held by one row settles it as alone;
2. by (length, hash of the first ``HEAD_CHARS`` characters): again, a key of one row settles it;
3. by (length, head, SHA-256 of the whole text): the groups of equal texts.

Only the rows that survive both cheaper levels have their whole text read and hashed. The decision "survives"
reaches the scan as a broadcast set of keys when the set's size is counted and found within ``MOST_KEYS``;
beyond it, the scan hashes the rows of the coarser level instead (never texts moved through a shuffle): more
hashing, the same result. Every level is an aggregate with map-side combination, so a group of copies that
holds a third of all rows is counted in every task before anything moves, and the join back to the rows is an
equi-join on keys of one row a key. Groups larger than a task's share of the rows (at most as many as there are
shuffle partitions) are joined where the rows lie, by a broadcast, so a hot group never lands in one task. The narrow rows of the
third level (no text) are written below the shared folder once, so a lost executor costs no second scan.

Defined results: a null text counts as the empty text; rows with equal doc_id and equal text are all kept if their
id is the one that stays; rows without doc_id never stay while a group has an id (``kept`` compares with
``<=>``, so in a group of null ids only, those rows stay); very long texts are hashed whole, in the JVM; an empty
table gives an empty one; further columns are not carried (the result has its own names only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Characters of the head that the second level hashes.
HEAD_CHARS = 1024
#: Keys of a level that are sent to every task as a set; a larger set leaves the scan to hash more.
MOST_KEYS = 2_000_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _open_keys(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``keyed`` held by two rows or more."""
    return keyed.groupBy(*keys).count().where("count > 1").drop("count")


def _marked(rows: DataFrame, open_keys: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether their key is open; a broadcast of the counted, bounded set, else all true."""
    if open_keys.count() <= MOST_KEYS:
        return rows.join(F.broadcast(open_keys.withColumn(name, F.lit(True))), keys, "left").fillna(False, [name])
    return rows.withColumn(name, F.lit(True))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their group's ``group_keep`` and ``group_n`` (null where they have none).

    A group of more rows than one task's share (rows / shuffle partitions) is hot. There are at most as many hot
    groups as shuffle partitions, so they are sent to every task and joined where the rows are; only the other
    groups meet their rows in a shuffle, where no key holds more than a task's share.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-rows.count() // parts))
    hot = groups.where(F.col("group_n") >= share)
    first = rows.join(F.broadcast(hot), keys, "left")
    settled = first.where(F.col("group_n").isNotNull())
    rest = first.where(F.col("group_n").isNull()).drop("group_keep", "group_n")
    return settled.unionByName(rest.join(groups.where(F.col("group_n") < share), keys, "left"))


def exact_duplicates(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size (long), kept, text_hash.

    ``text_hash`` is the lowercase hex SHA-256 of the normalised text where the third level read it, else null;
    with ``digest_all`` it is computed for every row (in the same scan, and used by the third level).
    """
    norm = normalised(F.col("text"))
    keyed = docs.select(
        F.col("doc_id"),
        F.octet_length(norm).cast("long").alias("length"),
        F.xxhash64(F.substring(norm, 1, HEAD_CHARS)).alias("head"),
        norm.alias("norm"),
    )
    level1 = _marked(keyed, _open_keys(keyed.select("length"), ["length"]), ["length"], "open1")
    level2_keys = _open_keys(level1.where("open1").select("length", "head"), ["length", "head"])
    level2 = _marked(level1, level2_keys, ["length", "head"], "open2")
    whole = F.sha2(F.col("norm"), 256)
    hashed = checkpointed(level2.select(
        "doc_id",
        "length",
        "head",
        (F.col("open1") & F.col("open2")).alias("open"),
        (whole if digest_all else F.when(F.col("open1") & F.col("open2"), whole)).alias("text_hash"),
    ))
    keys = ["length", "head", "text_hash"]
    groups = checkpointed(
        hashed.where("open").groupBy(*keys).agg(F.max("doc_id").alias("group_keep"), F.count(F.lit(1)).alias("group_n"))
    )
    joined = _joined(hashed, groups, keys)
    open_row = F.col("open")
    keep_id = F.when(open_row, F.col("group_keep")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(open_row, F.col("group_n")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_hash",
    )
