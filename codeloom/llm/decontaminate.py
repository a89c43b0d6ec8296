"""Benchmark decontamination with one Aho-Corasick automaton (operator 3).

Items and texts are brought to the same normal form (A-Z lower-cased, words joined by single spaces), all
windows of the items become patterns of one automaton, and each text is scanned once. Matches are
carried back to words, and to characters of the original text.

The benchmark goes to the tasks in shards of at most ``SHARD_BYTES``, so what a task holds is bounded however
large the benchmark is; nearly always there is one. With more, every shard scans the texts and the hits are merged.

Defined results: null and empty texts have no words and no hits; an item without words has no window; an item
without id marks words but is not listed; items with the same id count once; repeated rows give repeated rows; with an
empty benchmark nothing is hit; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, map_texts, strings

WINDOW_WORDS = 10
SHARD_BYTES = 16 << 20

#: Letters, digits and everything outside ASCII; all else becomes a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: The same words in a text as it stands.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = "doc_id bigint, text_hash bigint, row bigint, n_words bigint, hits array<int>, items array<string>, spans array<struct<begin:int,end:int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> Iterator[bytes]:
    """All windows of an item; a shorter item is one window."""
    for at in range(max(1, len(words) - size + 1) if words else 0):
        yield b" ".join(words[at : at + size])


def item_shards(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The items in lists of bounded size, read as a stream; ``contamination`` keeps all of them on the driver while it
    plans one scan for each (the benchmark is a query set: its size, not the corpus's, decides the driver's share)."""
    shard, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if not text:
            continue
        if shard and size + len(text) > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard.append((item, text))
        size += len(text)
    if shard:
        yield shard


def automaton_of(items: list[tuple[str | None, str]]) -> tuple[ahocorasick.Automaton | None, list[tuple[int, tuple[str, ...]]]]:
    """The automaton, and for each pattern its number of words and the ids of its items."""
    of_window: dict[bytes, set[str | None]] = {}
    for item, text in items:
        for window in windows(words_of(text)):
            of_window.setdefault(window, set()).add(item)
    automaton, patterns = ahocorasick.Automaton(), []
    for window, ids in of_window.items():
        # Bytes as characters: matching needs no decoding.
        automaton.add_word(f" {window.decode('latin-1')} ", len(patterns))
        patterns.append((window.count(b" ") + 1, tuple(i for i in ids if i is not None)))
    if not patterns:
        return None, patterns
    automaton.make_automaton()
    return automaton, patterns


def scan(docs: DataFrame, items: list[tuple[str | None, str]]) -> DataFrame:
    """For each row its words, the numbers of those that are hit, the items, and the hit runs as code points."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        automaton, patterns = automaton_of(shared.value)

        def of_text(text: str) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
            words = words_of(text)
            if automaton is None or not words:
                return len(words), [], [], []
            normal = f" {b' '.join(words).decode('latin-1')} "
            found = list(automaton.iter(normal))
            if not found:
                return len(words), [], [], []
            # Number of the word that ends before each matched closing space.
            ends = np.cumsum(np.array([len(w) + 1 for w in words]))
            last = np.searchsorted(ends, [end for end, _ in found])
            hit = np.zeros(len(words) + 1, np.int32)
            for word, (_, pattern) in zip(last.tolist(), found, strict=True):
                hit[word + 1 - patterns[pattern][0]] += 1
                hit[word + 1] -= 1
            hits = np.flatnonzero(np.cumsum(hit[:-1]))
            ids = sorted({i for pattern in {p for _, p in found} for i in patterns[pattern][1]})
            places = [m.span() for m in _WORD.finditer(text)]
            runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
            spans = [(places[run[0]][0], places[run[-1]][1]) for run in runs]
            return len(words), hits.tolist(), ids, spans

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [of_text(text) for text in strings(batch.column(3))]
            n, hits, ids, spans = zip(*rows, strict=True)
            columns = [
                *batch.columns[:3], pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                pa.array(ids, pa.list_(pa.string())),
                pa.array(
                    [[{"begin": b, "end": e} for b, e in s] for s in spans],
                    pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])),
                ),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "row", "n_words", "hits", "items", "spans"])

        return of_batch

    return map_texts(docs, ["doc_id", "text_hash", "row", "text"], SCHEMA, work)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row ``doc_id``, ``n_words``, ``hits`` (word numbers), ``items`` (ids) and ``spans`` of the original text.

    ``spans`` are runs of hit words, begin and end in code points, end exclusive; with several shards runs may overlap.
    ``text_hash`` tells rows with the same id apart.
    """
    shards = list(item_shards(benchmark)) or [[]]
    text_hash = F.xxhash64("text").alias("text_hash")
    if len(shards) == 1:
        return scan(docs.select("doc_id", text_hash, F.lit(0).cast("bigint").alias("row"), "text"), shards[0]).drop("row")
    # Row numbers must agree between the scans.
    numbered = checkpointed(docs.select("doc_id", text_hash, F.monotonically_increasing_id().alias("row"), "text"))
    parts = scan(numbered, shards[0])
    for shard in shards[1:]:
        parts = parts.union(scan(numbered, shard))
    merged = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    return merged.drop("row")


def contamination_digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
