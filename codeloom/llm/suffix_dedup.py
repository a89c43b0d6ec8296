"""Repeated passages through a sparse suffix array (operator 1).

Words are hashed, and of all suffixes of a text only those are retained that begin at a minimiser: a place whose
hash of ``GRAM`` words is the least of ``SPAN`` neighbouring places. Every window of ``LEAST`` words owns the one in its
first ``SPAN`` places. The choice follows from the window's content alone, so equal windows retain
the same suffix, and from there they agree for ``HEAD`` words at least.

1. The heads of the retained suffixes are hashed and grouped: those that stand alone begin no repeat.
2. Where a head repeats, all windows of ``LEAST`` words that have this
   suffix are hashed and grouped, each with its equals. Each window of a text owns
   one suffix, so nothing is compared twice and no repeated window is missed.
3. Repeated windows that overlap or touch are joined to maximal passages.
4. Every repeated window has one first place: the least ``doc_id``, then the least begin. What can be cut follows window by
   window, so a passage may stay in one part and go in another, and a repeat inside one document goes too.

Which heads repeat reaches the second pass as a bitmap of bounded size; a false positive costs some rows and
changes nothing. Copies of a whole text count as one text in the comparison, so neither they nor
a passage that all documents share gather in one task: everything before the join is a minimum, maximum or count.

Defined results: texts with fewer than ``LEAST`` words, null and empty ones too, have no passages, so no rows; rows with equal
text count as repeats of each other, also if their ids are equal or null (rows equal in both give equal result rows, so
both stay or go; make such rows distinct before); null ids come after all others;
an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, map_texts, strings

LEAST = 50
GRAM = 8
SPAN = 20
HEAD = LEAST - SPAN + 1
#: Bits of the bitmap for each repeated head, and bounds of its size as powers of two.
BITS_PER_HEAD, SMALLEST, LARGEST = 16, 20, 30

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_PLACE = (1 << 31) - 1
#: Bytes that separate words.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of words and of runs of words by differences of prefix sums; tables grow with the longest text."""

    def __init__(self) -> None:
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.word_inverse = pow(_STEP, -1, 1 << 64)
        self.up = self.down = self.word_up = self.word_down = np.zeros(0, np.uint64)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word, A-Z lower-cased."""
        data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(data)), _powers(self.inverse, 2 * len(data))
        inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[begins]) * self.down[begins])

    def runs(self, words: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
        """A hash of ``size`` words from each of ``begins``."""
        if len(words) > len(self.word_up):
            self.word_up, self.word_down = _powers(_STEP, 2 * len(words)), _powers(self.word_inverse, 2 * len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.word_up[: len(words)], out=sums[1:])
        return _mixed((sums[begins + size] - sums[begins]) * self.word_down[begins])


def owners(hasher: Hasher, words: np.ndarray) -> np.ndarray:
    """For each window of ``LEAST`` words its retained suffix: the minimiser of its first ``SPAN`` grams, the rightmost of equals.

    It follows from the window alone, wherever the window stands. For texts of ``LEAST`` words at least.
    """
    grams = hasher.runs(words, np.arange(len(words) - LEAST + SPAN), GRAM)
    runs = np.lib.stride_tricks.sliding_window_view(grams, SPAN)[:, ::-1]
    return np.arange(len(runs)) + SPAN - 1 - runs.argmin(axis=1)


def heads_of(hasher: Hasher, words: np.ndarray) -> np.ndarray:
    """Hashes of the heads of the retained suffixes, in the order of their places."""
    return hasher.runs(words, np.unique(owners(hasher, words)), HEAD)


def _order(doc_id: int | None, text_hash: int, places: np.ndarray) -> np.ndarray:
    """Places of a text as numbers of 128 bits (low and high halves) in the order of ``doc_id`` and place.

    Null ids come last; of texts with one id 31 bits of the hash decide. All fit a decimal of 38 digits.
    """
    base = ((1 << 63 if doc_id is None else doc_id) << 62) + ((text_hash & _PLACE) << 31)
    out = np.empty((len(places), 2), np.uint64)
    out[:, 0] = np.uint64(base & _MASK) + places.astype(np.uint64)
    out[:, 1] = np.uint64((base >> 64) & _MASK)
    return out


def _doc_id(order: np.ndarray) -> int | None:
    low, high = (int(x) for x in order)
    return None if high == 1 << 61 else int(np.uint64((high << 2 | low >> 62) & _MASK).astype(np.int64))


def repeated_heads(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (``doc_id``, ``text_hash``, ``n_words``) and the ``head`` values that occur in two places."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hasher = Hasher()

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, found = [], []
            for text in strings(batch.column(2)):
                words = hasher.words(text)
                sizes.append(len(words))
                heads = heads_of(hasher, words) if len(words) >= LEAST else np.zeros(0, np.uint64)
                found.append(heads)
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            values = np.concatenate(found).view(np.int64)
            heads = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            columns = [*batch.columns[:2], pa.array(sizes, pa.int32()), heads]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "heads"])

        return of_batch

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id bigint, text_hash bigint, n_words int, heads array<bigint>"
    texts = checkpointed(map_texts(rows, ["doc_id", "text_hash", "text"], schema, work))
    place = F.xxhash64("text_hash", "at")
    counted = (
        texts.select("text_hash", F.posexplode("heads").alias("at", "head"))
        .groupBy("head")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"))
    )
    return texts.drop("heads"), counted.where("low <> high").select("head")


def head_bitmap(heads: DataFrame) -> np.ndarray:
    """Bits of the given heads, of a size that follows their number up to a bound."""
    heads = checkpointed(heads)
    size = max(SMALLEST, min(LARGEST, (heads.count() * BITS_PER_HEAD).bit_length()))
    slot = F.expr(f"head & {(1 << size) - 1}L")
    cells = (
        heads.select(slot.alias("slot"))
        .groupBy(F.shiftrightunsigned("slot", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (size - 6), np.uint64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return bitmap


def windows(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """All windows of ``LEAST`` words whose first retained suffix has a head of the bitmap: ``window`` (hash), ``place``, ``at``.

    ``at`` orders the places of a window over all documents. A text occurs at least once with its smallest id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher, seen = shared.value, Hasher(), {}
        low = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            rows = []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, text in enumerate(strings(batch.column(2))):
                # Copies within a task need not be compared again, unless their id is smaller.
                rank = (ids[at] is None, ids[at] or 0)
                if hashes[at] in seen and seen[hashes[at]] <= rank:
                    continue
                seen[hashes[at]] = rank
                words = hasher.words(text)
                if len(words) < LEAST:
                    continue
                suffixes, of_window = np.unique(owners(hasher, words), return_inverse=True)
                heads = hasher.runs(words, suffixes, HEAD)
                slots = heads & low
                met = (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
                begins = np.flatnonzero(met[of_window])
                if len(begins):
                    rows.append((at, begins, hasher.runs(words, begins, LEAST), _order(ids[at], hashes[at], begins)))
            if not rows:
                continue
            index = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
            order = pa.py_buffer(np.concatenate([r[3] for r in rows]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)),
                    batch.column(1).take(index),
                    pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32)),
                    pa.Array.from_buffers(pa.decimal128(38, 0), len(index), [None, order]),
                ],
                ["window", "text_hash", "place", "at"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "window bigint, text_hash bigint, place int, at decimal(38,0)")


def passages(docs: DataFrame) -> DataFrame:
    """A row for each repeated passage of each document.

    ``doc_id``, ``begin`` and ``n_words`` (in words), ``first_doc_id``: the smallest id of a document that holds
    a part of it. ``parts`` splits the passage where the first document of its windows changes: ``begin`` and ``n_words``
    of the windows (neighbours overlap by less than ``LEAST`` words), their first place ``first_doc_id`` and
    ``first_begin`` (of the part's first window), and whether they ``stay``, being that place.

    ``cuts`` are the words that can be cut: those in a window whose first place is elsewhere and in none that stays. After
    cutting, every repeated window is still at its first place. Elsewhere it is left only where all its words belong to windows
    that stay there too, as in copies of a text around a passage of less than ``2 * LEAST - 1`` words from another text.
    """
    texts, heads = repeated_heads(docs)
    found = windows(docs, head_bitmap(heads))
    # One number for each place of a text: least and greatest differ if there are two places. Written before the
    # join, so that the rows of a window that many documents share can be split there.
    place = F.xxhash64("text_hash", "place")
    equal = checkpointed(
        found.groupBy("window")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"), F.min("at").alias("first"))
        .where("low <> high")
        .select(F.col("window").alias("of"), "first")
    )
    stays = (F.col("at") == F.col("first")).alias("stays")
    repeated = found.join(equal, found["window"] == equal["of"]).select("text_hash", "place", "first", stays)
    # A copy that is not the first one of its text has the same windows, which stay in the first one.
    of_text = repeated.groupBy("text_hash", "place").agg(F.min("first").alias("first"), F.max("stays").alias("stays"))
    lists = of_text.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("place", "first", "stays"))).alias("places"))
    # Copies of whole texts are repeats from end to end.
    copies = texts.groupBy("text_hash").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_copy"), F.max("n_words").alias("n_words")
    )
    copies = copies.where((F.col("copies") > 1) & (F.col("n_words") >= LEAST)).drop("copies")
    spans = checkpointed(_joined(copies.join(lists, "text_hash", "full")))
    named = texts.select("doc_id", F.col("text_hash").alias("of_text"))
    # Of a copied text the first copy and the others have spans of their own.
    meant = spans["first"].isNull() | (spans["first"] == named["doc_id"].eqNullSafe(spans["first_copy"]))
    return named.join(spans, (named["of_text"] == spans["text_hash"]) & meant).select(
        "doc_id", "begin", "n_words", "first_doc_id", "parts", "cuts"
    )


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _covered(at: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie in the windows that begin at ``at``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + LEAST, -1)
    return np.cumsum(steps[:-1]) > 0


def _passage(at: np.ndarray, first: np.ndarray, stays: np.ndarray) -> tuple[int, int, int | None, list, list]:
    """``begin``, ``n_words``, ``first_doc_id``, ``parts`` and ``cuts`` of the windows at ``at``."""
    begin, size = int(at[0]), int(at[-1] - at[0]) + LEAST
    whose = np.column_stack((first[:, 0] >> np.uint64(31), first[:, 1], stays))
    starts = np.concatenate(([0], np.flatnonzero((whose[1:] != whose[:-1]).any(axis=1)) + 1))
    ends = np.append(starts[1:], len(at)) - 1
    parts = [
        {
            "begin": int(at[a]),
            "n_words": int(at[b] - at[a]) + LEAST,
            "first_doc_id": _doc_id(first[a]),
            "first_begin": int(first[a, 0]) & _PLACE,
            "stays": bool(stays[a]),
        }
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
    ]
    cut = _covered(at[~stays] - begin, size) & ~_covered(at[stays] - begin, size)
    cuts = [{"begin": begin + a, "n_words": b - a} for a, b in _runs(cut)]
    least = min((p["first_doc_id"] for p in parts if p["first_doc_id"] is not None), default=None)
    return begin, size, least, parts, cuts


_PARTS = "parts array<struct<begin:int,n_words:int,first_doc_id:bigint,first_begin:int,stays:boolean>>"
_CUTS = "cuts array<struct<begin:int,n_words:int>>"


def _joined(lists: DataFrame) -> DataFrame:
    """Windows of each text joined to passages; a copied text is one passage, once for its first copy and once for the others."""
    span = [("begin", pa.int32()), ("n_words", pa.int32())]
    part = [*span, ("first_doc_id", pa.int64()), ("first_begin", pa.int32()), ("stays", pa.bool_())]
    schema = pa.schema(
        [
            ("text_hash", pa.int64()), ("first_copy", pa.int64()), ("first", pa.bool_()), *span, ("first_doc_id", pa.int64()),
            ("parts", pa.list_(pa.struct(part))), ("cuts", pa.list_(pa.struct(span))),
        ]
    )

    def spans_of(text_hash: int, first_copy: int | None, n_words: int | None, at: np.ndarray, first: np.ndarray, stays: np.ndarray) -> Iterator[tuple]:
        if n_words is None:
            for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > LEAST) + 1):
                yield text_hash, None, None, *_passage(at[group], first[group], stays[group])
            return
        every = np.arange(n_words - LEAST + 1)
        firsts, stay = _order(first_copy, text_hash, every), np.ones(len(every), bool)
        firsts[at], stay[at] = first, stays
        yield text_hash, first_copy, True, *_passage(every, firsts, stay)
        yield text_hash, first_copy, False, *_passage(every, firsts, np.zeros(len(every), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            keys = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            for key, places in zip(keys, batch.column(3), strict=True):
                values = places.values
                if values is None:
                    at, first, stays = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, bool)
                else:
                    columns = values.flatten()
                    at = columns[0].to_numpy(zero_copy_only=False).astype(np.int64)
                    halves = np.frombuffer(columns[1].buffers()[1], np.uint64)
                    first = halves[2 * columns[1].offset :][: 2 * len(at)].reshape(-1, 2)
                    stays = columns[2].to_numpy(zero_copy_only=False)
                out.extend(spans_of(*key, at, first, stays))
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return lists.select("text_hash", "first_copy", "n_words", "places").mapInArrow(
        run, f"text_hash bigint, first_copy bigint, first boolean, begin int, n_words int, first_doc_id bigint, {_PARTS}, {_CUTS}"
    )
