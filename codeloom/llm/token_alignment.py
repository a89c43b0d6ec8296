"""Alignment of two tokenizers' tokens by interval coalescing (operator 13).

Tokenizer A is a byte-level BPE (``tokenizers`` file, applied to ``" " + text``), B a sentencepiece model (applied to
``text``; it adds the space itself). Special strings inside texts are plain text for both. A token's bytes are A's
entry decoded from its byte-level letters, or B's piece in UTF-8 with U+2581 as space and ``<0xHH>`` as byte HH.
When both token sequences join to exactly the bytes of ``" " + text``, they tile the same byte range:

- groups: all A and B tokens are lexsorted by start, the running maximum of their ends is accumulated, and a
  group begins where a start reaches the running maximum, that is at byte offsets where an A and a B token
  both end;
- links: A-B occurrence pairs whose byte ranges overlap; in two tilings they are the elementary pieces between
  the union of all ends.

Where the two files allow it (``_words_apart``), a text is cut into units at spaces between two characters that are no white
space: both tokenizers end a token before such a space whatever stands around it, so groups and links never cross it. All
units of a batch that are not remembered are encoded and coalesced end to end in one pass; a text's groups and links are
those of its units in order. With other files a text is one unit.

Links are counted per document in the task; an id pair's count, the number of documents that hold it linked, is
an aggregate over all documents with map-side combination, so a pair that every document holds costs one row a
task. The per-document sums then look the counts up by a broadcast when the distinct pairs are counted and found
within ``MOST_PAIRS``, else by an equi-join; the document's links are summed before anything moves again.

Defined results: a null or empty text, or one whose joined A or B bytes differ from ``" " + text`` (for example where
sentencepiece normalises), has no tokens: zeros and an empty group string; very long texts are encoded whole;
repeated rows are separate documents (each counts for its pairs); rows without doc_id are kept; an empty table gives
an empty one; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, strings

#: Distinct id pairs that are sent to every task for the per-document sums; more are joined.
MOST_PAIRS = 4_000_000
#: Characters of texts handed to the tokenizers in one call: memory follows this, not the batch.
CHARS_AT_ONCE = 1 << 20
#: Units whose alignments a worker remembers, and characters of them for each; when more, it starts anew.
REMEMBERED = 300_000
#: Units that tokenizer A gets in one text.
UNITS_AT_ONCE = 64

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<struct<a:int,b:int,n:int>>"
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: Characters that are white space for neither tokenizer.
_SOLID = re.compile(r"[!-~\w]")
_BETWEEN_UNITS = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])").split
_INNER_SPACE = re.compile("[^▁]▁")


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 + their rank."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in kept}
    extra = 0
    for b in range(256):
        if b not in kept:
            letters[chr(256 + extra)] = b
            extra += 1
    return letters


class Encoders:
    """The two tokenizers and the bytes of every id, loaded once in a worker."""

    def __init__(self, a_path: str, b_path: str) -> None:
        # One thread per task, as Spark counts it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [bytes(letters[c] for c in (self.a.id_to_token(i) or "")) for i in range(self.a.get_vocab_size())]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE.fullmatch(piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(byte.group(1), 16)]) if byte else piece.replace("▁", " ").encode())
        self.a_lengths = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_lengths = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.decimals = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.b_bits = len(self.b_bytes).bit_length()
        self.key_bits = self.b_bits + len(self.a_bytes).bit_length()
        self.cuts = _words_apart(a_path, b_path)

    def cut(self, text: str) -> list[str]:
        """The units of ``text``: its parts between spaces where both tokenizers end a token, without the space before each."""
        return _BETWEEN_UNITS(text) if self.cuts else [text]

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a << self.b_bits) | b

    def pair(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The A and B ids of keys, whose bits above ``key_bits`` do not matter."""
        a, b = keys >> self.b_bits, keys & ((1 << self.b_bits) - 1)
        return (a & ((1 << self.key_bits - self.b_bits) - 1)).astype(np.int32), b.astype(np.int32)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of whole texts."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        return a, b

    def unit_ids(self, units: list[str]) -> tuple:
        """The units in the order in which they were encoded, their bytes, and for A and B all ids and each unit's number of them.

        A call of A costs more than a word, so units that may stand next to each other go to it ``UNITS_AT_ONCE`` together.
        """
        solid = _SOLID.match
        words, apart = [], []
        for u in units:
            (words if self.cuts and solid(u[0]) and solid(u[-1]) else apart).append(u)
        runs = [words[i : i + UNITS_AT_ONCE] for i in range(0, len(words), UNITS_AT_ONCE)] + [[u] for u in apart]
        units = words + apart
        found = self.a.encode_batch_fast([" " + " ".join(run) for run in runs], add_special_tokens=False)
        of_run = [e.ids for e in found]
        a = np.fromiter(chain.from_iterable(of_run), np.int64)
        last = np.cumsum(self.a_lengths[a])
        wholes = [(" " + u).encode("utf-8", "surrogatepass") for u in units]
        border = np.cumsum(np.fromiter(map(len, wholes), np.int64, len(units)))
        after = np.searchsorted(last, border, "left") + 1
        if after[-1] != len(a) or (last[after - 1] != border).any():
            # A's bytes differ from the texts': units are told apart by separate calls.
            of_run = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
            a, after = np.fromiter(chain.from_iterable(of_run), np.int64), np.cumsum(list(map(len, of_run)))
        of_unit = self.b.encode(units, num_threads=1)
        n_b = np.fromiter(map(len, of_unit), np.int64, len(units))
        return units, wholes, a, np.diff(after, prepend=0), np.fromiter(chain.from_iterable(of_unit), np.int64, n_b.sum()), n_b


def _words_apart(a_path: str, b_path: str) -> bool:
    """Whether the files say that no token spans a space between two printable ASCII characters, and none before
    such a space depends on what follows or the other way round.

    A: texts as they are, split by the byte-level pattern, where a space between such characters begins a match. B: texts
    as they are, merged from characters by pieces of which none has a space after another character.
    """
    with open(a_path, encoding="utf-8") as file:
        a = json.load(file)
    split, model = a.get("pre_tokenizer") or {}, a["model"]
    if (
        a.get("normalizer") or a.get("truncation") or a.get("padding") or model.get("dropout") or model.get("type") != "BPE"
        or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        or not all(token["special"] for token in a.get("added_tokens", []))
    ):
        return False
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    b = sentencepiece_model_pb2.ModelProto()
    with open(b_path, "rb") as file:
        b.ParseFromString(file.read())
    rules, trained = b.normalizer_spec, b.trainer_spec
    return (
        trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix
        and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        and rules.add_dummy_prefix and rules.escape_whitespaces
        and not any(p.type == p.USER_DEFINED or _INNER_SPACE.search(p.piece) for p in b.pieces)
    )


def _joined(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def coalesced(enc: Encoders, a: np.ndarray, b: np.ndarray, unit_end: np.ndarray) -> tuple:
    """Groups and links of units that lie end to end, each of which A's tokens ``a`` and B's tokens ``b`` tile.

    Gives the units' numbers of groups, their group strings, their numbers of links, and all links as keys ``enc.key(a, b)``.
    """
    a_end, b_end = np.cumsum(enc.a_lengths[a]), np.cumsum(enc.b_lengths[b])
    starts = np.concatenate((a_end - enc.a_lengths[a], b_end - enc.b_lengths[b]))
    ends = np.concatenate((a_end, b_end))
    side = np.concatenate((np.zeros(len(a), np.int8), np.ones(len(b), np.int8)))
    order = np.lexsort((side, ends, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    group_unit = np.searchsorted(unit_end, starts[order][opens], "right")
    # The group strings in one pass: tokens in (group, side, place) order, each followed by its separator.
    placed = np.argsort(2 * group + side, kind="stable")
    here_group, here_side = group[placed], side[placed]
    here_unit = group_unit[here_group]
    separators = np.where(here_group[1:] == here_group[:-1], np.where(here_side[1:] == here_side[:-1], ",", "|"), ";")
    separators[here_unit[1:] != here_unit[:-1]] = "\n"
    joined: list[str] = [""] * (2 * len(placed))
    joined[0::2] = map(enc.decimals.__getitem__, np.concatenate((a, b))[placed].tolist())
    joined[1:-1:2] = separators.tolist()
    groups = "".join(joined).split("\n")
    pieces = np.concatenate((a_end, b_end))
    pieces.sort(kind="stable")
    pieces = pieces[np.concatenate(([True], pieces[1:] != pieces[:-1]))]
    keys = enc.key(a[np.searchsorted(a_end, pieces, "left")], b[np.searchsorted(b_end, pieces, "left")])
    n_links = np.bincount(np.searchsorted(unit_end, pieces, "left"), minlength=len(unit_end))
    return np.bincount(group_unit, minlength=len(unit_end)), groups, n_links, keys


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[firsts], np.diff(np.append(firsts, len(keys)))


def align(text: str, enc: Encoders, a_ids: list[int], b_ids: list[int]) -> tuple:
    """n_a, n_b, n_groups, the group string and the linked id pairs (a, b, occurrences as arrays), for one text."""
    whole = (" " + text).encode("utf-8", "surrogatepass")
    if not text or _joined(a_ids, enc.a_bytes) != whole or _joined(b_ids, enc.b_bytes) != whole:
        none = np.zeros(0, np.int32)
        return 0, 0, 0, "", none, none, none
    a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
    n_groups, groups, _, keys = coalesced(enc, a, b, np.array([len(whole)]))
    pairs, counts = _counted(keys)
    return len(a_ids), len(b_ids), int(n_groups[0]), groups[0], *enc.pair(pairs), counts.astype(np.int32)


class Aligned(NamedTuple):
    """Texts' counts (rows of n_a, n_b, n_groups), group strings, and links as flat arrays with each text's number."""

    counts: np.ndarray
    groups: list[str]
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    sizes: np.ndarray


class Units:
    """Alignments of units (see ``Encoders.cut``), remembered up to ``REMEMBERED`` of them.

    Groups and links never cross a border of units, as both tokenizers end a token there. So a text's groups and links are
    those of its units one after the other, and a unit is encoded and coalesced once while it is remembered.
    """

    def __init__(self, enc: Encoders) -> None:
        self.enc = enc
        self.clear()

    def clear(self) -> None:
        #: Units, in the order of their rows.
        self.rows: dict[str, int] = {}
        self.characters = 0
        #: By row: group string, (n_a, n_b, n_groups, n_links), the place of the first link. No tokens: bytes that differ.
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.firsts = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the units that were met more than once since the last time, the most frequent ones if they are many."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: REMEMBERED // 2]])
        places, n_links = self._places(kept), self.counts[kept, 3]
        units, groups, counts = list(self.rows), self.groups, self.counts[kept]
        links = self.links[places]
        self.clear()
        self.rows = {units[i]: row for row, i in enumerate(kept.tolist())}
        self.characters = sum(map(len, self.rows))
        self.groups = [groups[i] for i in kept.tolist()]
        self.counts, self.firsts, self.links, self.uses = counts, np.cumsum(n_links) - n_links, links, np.zeros(len(kept), np.int64)
        if self.characters > 8 * REMEMBERED:
            self.clear()

    def _places(self, rows: np.ndarray) -> np.ndarray:
        """The places of all links of ``rows``."""
        n_links = self.counts[rows, 3]
        return np.arange(n_links.sum()) + np.repeat(self.firsts[rows] - (np.cumsum(n_links) - n_links), n_links)

    def add(self, units: list[str]) -> None:
        """Encodes units that are not remembered and remembers them."""
        enc = self.enc
        units, wholes, a, n_a, b, n_b = enc.unit_ids(units)
        size = np.fromiter(map(len, wholes), np.int64, len(wholes))
        holds = np.ones(len(units), bool)
        for ids, n, table, lengths in ((a, n_a, enc.a_bytes, enc.a_lengths), (b, n_b, enc.b_bytes, enc.b_lengths)):
            ends, begins = np.cumsum(n), np.cumsum(n) - n
            reached = np.concatenate(([0], np.cumsum(lengths[ids])))
            fits = reached[ends] - reached[begins] == size
            if fits.all() and _joined(ids.tolist(), table) == b"".join(wholes):
                continue
            for i in range(len(units)):
                holds[i] &= bool(fits[i]) and _joined(ids[begins[i] : ends[i]].tolist(), table) == wholes[i]
        counts = np.zeros((len(units), 4), np.int64)
        groups = [""] * len(units)
        if holds.any():
            a, b = a[np.repeat(holds, n_a)], b[np.repeat(holds, n_b)]
            n_groups, found, n_links, keys = coalesced(enc, a, b, np.cumsum(size[holds]))
            counts[holds] = np.column_stack((n_a[holds], n_b[holds], n_groups, n_links))
            for i, group in zip(np.flatnonzero(holds).tolist(), found, strict=True):
                groups[i] = group
            self.firsts = np.concatenate((self.firsts, len(self.links) + np.cumsum(counts[:, 3]) - counts[:, 3]))
            self.links = np.concatenate((self.links, keys))
        else:
            self.firsts = np.concatenate((self.firsts, np.zeros(len(units), np.int64)))
        self.rows.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += groups
        self.counts = np.concatenate((self.counts, counts))
        self.uses = np.concatenate((self.uses, np.zeros(len(units), np.int64)))
        self.characters += sum(map(len, units))

    def rows_of(self, texts: list[str]) -> list[list[int]]:
        """The rows of each text's units; none for a text whose joined bytes differ."""
        if len(self.rows) > REMEMBERED or self.characters > 16 * REMEMBERED:
            self.forget()
        units = [self.enc.cut(text) if text else [] for text in texts]
        if missing := [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self.rows]:
            self.add(missing)
        row = self.rows.__getitem__
        rows = [list(map(row, of_text)) for of_text in units]
        if not self.counts[:, 0].all():
            # Bytes of units differ: such a text is judged whole.
            differs = set(np.flatnonzero(self.counts[:, 0] == 0).tolist())
            doubtful = [i for i, of_text in enumerate(rows) if not differs.isdisjoint(of_text)]
            if missing := [t for t in dict.fromkeys(texts[i] for i in doubtful) if t not in self.rows]:
                self.add(missing)
            for i in doubtful:
                whole = row(texts[i])
                rows[i] = [whole] if self.counts[whole, 0] else []
        return rows

    def align(self, texts: list[str]) -> Aligned:
        """What the function ``align`` gives, for many texts."""
        rows = self.rows_of(texts)
        groups = [";".join(map(self.groups.__getitem__, of_text)) for of_text in rows]
        borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))))
        flat = np.fromiter(chain.from_iterable(rows), np.int64, borders[-1])
        self.uses += np.bincount(flat, minlength=len(self.uses))
        counts = self.counts[flat]
        totals = np.diff(np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(counts, 0)))[borders], axis=0)
        text = np.repeat(np.arange(len(rows)), totals[:, 3])
        keys, n = _counted((text << self.enc.key_bits) | self.links[self._places(flat)])
        sizes = np.bincount(keys >> self.enc.key_bits, minlength=len(rows))
        return Aligned(totals[:, :3], groups, *self.enc.pair(keys), n.astype(np.int32), sizes)


def _parts(texts: list[str]) -> Iterator[slice]:
    """Consecutive slices of ``texts`` of about ``CHARS_AT_ONCE`` characters, one text at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHARS_AT_ONCE:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _work(a_path: str, b_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(a_path, b_path)
        for batch in batches:
            texts = strings(batch.column("text"))
            # A batch's links take many times its texts: each part leaves before the next one is aligned.
            for part in _parts(texts):
                yield _rows(batch.column("doc_id")[part], units.align(texts[part]))

    return work


def _rows(doc_id: pa.Array, found: Aligned) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(found.sizes))).astype(np.int32)
    links = pa.StructArray.from_arrays([pa.array(found.a), pa.array(found.b), pa.array(found.n)], names=["a", "b", "n"])
    columns = [doc_id, *(pa.array(found.counts[:, k]) for k in range(3)), pa.array(found.groups, pa.string())]
    columns.append(pa.ListArray.from_arrays(pa.array(offsets), links))
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("groups", pa.string()),
        ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))),
    ]
)


@cache
def _units(a_path: str, b_path: str) -> Units:
    """One for all tasks of a Python worker."""
    return Units(Encoders(a_path, b_path))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;...``), links (a, b, n: occurrences)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInArrow(_work(a_path, b_path), ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (the highest count of the pair's A id)."""
    pairs = links.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count(F.lit(1)).alias("count"))
    best = pairs.groupBy("a").agg(F.max("count").alias("best"))
    return pairs.join(best, "a")


def link_sums(rows: DataFrame) -> DataFrame:
    """``rows`` (with a unique ``row`` and ``links``) with n_links, n_best, count_sum (long) in place of ``links``."""
    counts = checkpointed(pair_counts(rows))
    lookup = F.broadcast(counts) if counts.count() <= MOST_PAIRS else counts
    keys = [c for c in rows.columns if c != "links"]
    exploded = rows.select(*keys, F.explode_outer("links").alias("l")).select(*keys, "l.a", "l.b", F.col("l.n").cast("long").alias("n"))
    return (
        exploded.join(lookup, ["a", "b"], "left")
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_links"),
            F.coalesce(F.sum(F.when(F.col("count") == F.col("best"), F.col("n"))), F.lit(0)).cast("long").alias("n_best"),
            F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0)).cast("long").alias("count_sum"),
        )
    )


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum for every row of ``docs``."""
    rows = checkpointed(aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    return link_sums(rows).drop("row")
