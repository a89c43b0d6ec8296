"""Byte-level BPE encoding and decoding over a file of merge ranks (operator 10).

Every match of the splitting pattern is merged on its own. The pairs of a match wait in a queue with
one bucket of linked-list positions for each merge rank; a bitmap of two levels says which buckets
hold something, so the next rank is two find-first-set steps away. A merge leaves the entries
of the pairs that it destroyed in their buckets; they are recognised as stale when taken.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated
rows; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Splitter, map_texts, pieces, strings

#: Encoded matches of a generation that a task remembers; two generations at most.
REMEMBERED = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class RankQueue:
    """Positions by merge rank; the lowest rank and in it the leftmost position comes first.

    Bucket ``r`` holds its one position as a number or several as a heap. Bit ``r % WIDTH`` of leaf ``r // WIDTH`` says
    that it holds something, bit ``g`` of the root that leaf ``g`` does.
    """

    SHIFT = 8
    WIDTH = 1 << SHIFT

    def __init__(self, ranks: int) -> None:
        self.root = 0
        self.leaves = [0] * ((ranks >> self.SHIFT) + 1)
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = position
            leaf = rank >> 8
            self.leaves[leaf] |= 1 << (rank & 255)
            self.root |= 1 << leaf
        elif type(held) is int:
            self.buckets[rank] = [held, position] if held < position else [position, held]
        else:
            heapq.heappush(held, position)

    def pop(self) -> tuple[int, int]:
        """Takes an entry out. Only for queues that hold one."""
        root = self.root
        leaf = (root & -root).bit_length() - 1
        bits = self.leaves[leaf]
        rank = (leaf << 8) + (bits & -bits).bit_length() - 1
        held = self.buckets[rank]
        if type(held) is int:
            del self.buckets[rank]
            self.leaves[leaf] = bits = bits & (bits - 1)
            if not bits:
                self.root = root & (root - 1)
            return rank, held
        position = heapq.heappop(held)
        if len(held) == 1:
            self.buckets[rank] = held[0]
        return rank, position


class ByteBPE:
    """Encoder and decoder for one rank file. Remembers encoded matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.findall = Splitter(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0))
        #: Ids of matches, in two generations: what is met again while the older one lasts moves to the newer.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def merged(self, data: bytes) -> list[int]:
        """The ids of one match."""
        ranks, queue, n = self.ranks, self.queue, len(data)
        if data in ranks:
            return [ranks[data]]
        rank_of, push, pop = ranks.get, queue.push, queue.pop
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        #: Rank of the pair that begins at a position, None without one.
        pair = [rank_of(data[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for position, rank in enumerate(pair):
            if rank is not None:
                push(rank, position)
        while queue.root:
            rank, left = pop()
            if pair[left] != rank:
                continue
            right = after[left]
            after[left] = end = after[right]
            pair[right] = None
            if end < n:
                before[end] = left
                pair[left] = rank = rank_of(data[left : after[end]])
                if rank is not None:
                    push(rank, left)
            else:
                pair[left] = None
            if left:
                first = before[left]
                pair[first] = rank = rank_of(data[first:end])
                if rank is not None:
                    push(rank, first)
        ids, begin = [], 0
        while begin < n:
            end = after[begin]
            ids.append(ranks[data[begin:end]])
            begin = end
        return ids

    def remembered(self, match: str) -> bytes:
        """The ids of a match that is not in the newer generation."""
        ids = self.older.get(match)
        if ids is None:
            ids = np.array(self.merged(match.encode("utf-8", "replace")), "<u4").tobytes()
        if len(match) < 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        out = []
        for piece in pieces(text):
            matches = self.findall(piece)
            known = self.known
            ids = list(map(known.get, matches))
            if None in ids:
                ids = [found or known.get(match) or self.remembered(match) for found, match in zip(ids, matches, strict=True)]
            out.append(b"".join(ids))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def bpe_of(path: str, pattern: str) -> ByteBPE:
    """One for all tasks of a Python worker, so that later tasks begin with what earlier ones remember."""
    return ByteBPE(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``: the token ids of each row's ``text``, four bytes each, little-endian."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = bpe_of(path, pattern)

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(text) for text in strings(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return of_batch

    return map_texts(docs, ["doc_id", "text"], "doc_id bigint, ids binary", work)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``: the bytes that the ids stand for."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = bpe_of(path, "")

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            decoded = [bpe.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

        return of_batch

    return map_texts(rows, ["doc_id", "ids"], "doc_id bigint, ids binary, decoded binary", work)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What ``decode`` gives of what ``encode`` gives, in one pass, so that a task keeps one set of tables."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = bpe_of(path, pattern)

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(text) for text in strings(batch.column(1))]
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

        return of_batch

    return map_texts(docs, ["doc_id", "text"], "doc_id bigint, ids binary, decoded binary", work)


def digests(rows: DataFrame) -> DataFrame:
    """Counts and checksums of what ``decode`` or ``round_trip`` gives."""
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
