"""Token counts with a word-end BPE vocabulary compiled to a finite-state transducer (operator 8).

A sequence of tokens is the BPE encoding of a word exactly if each token encodes to itself and each pair of neighbours
encodes to just that pair. So the last token of every prefix of a word can be told from the last tokens of
shorter prefixes, no further back than the longest token. A state of the transducer is that
bounded history: the bytes that a token may still reach back to, and for each border between them
the last token there and the number of tokens relative to now. A transition reads a byte and is annotated with
the change of the token count; a second kind of transition reads the last byte of a word. States
and transitions are made when first needed and kept, so each is worked out once in a task.

Words of a text come from the tokenizer's own splitting rule. A long text is cut anywhere into chunks. The state map of a chunk
is: the open piece up to its first separator, the count of what lies between its separators, and the open
piece after the last one. Two maps compose to the map of the joined chunk, and composing
is associative, so a scan over pairs yields the text's count.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import PIECE_CHARS, Splitter, map_texts, strings

#: Counts of words, and transitions, that a task remembers; when full, it starts anew.
REMEMBERED = 400_000
#: Characters that never are part of a token.
SEPARATORS = " \n"


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class Merges:
    """The merge rules of a vocabulary over symbols (byte letters, the last of a word with its mark)."""

    def __init__(self, model: dict) -> None:
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {pair: rank for rank, pair in reversed(list(enumerate(pairs)))}
        #: All beginnings of tokens, as strings of symbols without the mark.
        self.beginnings: set[str] = set()
        for token in model["vocab"]:
            bare = token.removesuffix(self.end) if self.end else token
            self.beginnings.update(bare[:n] for n in range(1, len(bare) + 1))
        self.vocabulary = set(model["vocab"])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    def symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.end) if self.end else token
        return [*bare[:-1], bare[-1:] + token[len(bare) :]]

    def encoded(self, symbols: list[str]) -> list[str]:
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min(
                ((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))),
            )
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]
        return symbols

    def stands(self, token: str) -> bool:
        """Whether the token's own symbols encode to it."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = token in self.vocabulary and self.encoded(self.symbols(token)) == [token]
        return known

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may come after ``left`` in an encoding."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.encoded([*self.symbols(left), *self.symbols(right)]) == [left, right]
            self.pairs[left, right] = known
        return known


class History(NamedTuple):
    """What the transducer knows after some bytes of a word. ``borders`` has one entry more than ``letters``:
    for each place between them, oldest first, the last token there (empty where the word begins) and its count
    relative to the count now."""

    letters: str
    borders: tuple[tuple[str, int], ...]


class Transducer:
    """Counts tokens of words, byte by byte. Both transition tables grow as they are used."""

    START = History("", (("", 0),))

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.states: dict[History, int] = {self.START: 0}
        self.histories = [self.START]
        #: For each state, by byte: state and change of the count; for a last byte only the change.
        self.inner: list[dict[int, tuple[int, int]]] = [{}]
        self.final: list[dict[int, int]] = [{}]
        self.made = 0

    def _last_token(self, history: History, letter: str, mark: str) -> tuple[str, int]:
        """The last token once ``letter`` is read, and the count then, relative to now."""
        letters = history.letters + letter
        for begin in range(len(letters)):
            before, count = history.borders[begin]
            token = letters[begin:] + mark
            if self.merges.stands(token) and (not before or self.merges.follows(before, token)):
                return token, count + 1
        raise ValueError(f"no token of the vocabulary ends at {letter!r}")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        history, letter = self.histories[state], self.letters[byte]
        token, change = self._last_token(history, letter, "")
        letters = history.letters + letter
        borders = [(t, c - change) for t, c in history.borders] + [(token, 0)]
        reach = next((b for b in range(len(letters)) if letters[b:] in self.merges.beginnings), len(letters))
        following = History(letters[reach:], tuple(borders[reach:]))
        number = self.states.get(following)
        if number is None:
            number = self.states[following] = len(self.histories)
            self.histories.append(following)
            self.inner.append({})
            self.final.append({})
        self.inner[state][byte] = number, change
        self.made += 1
        return number, change

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        if not word:
            return 0
        if self.made > REMEMBERED:
            self.clear()
        state = total = 0
        inner = self.inner
        for byte in word[:-1]:
            found = inner[state].get(byte) or self.step(state, byte)
            state = found[0]
            total += found[1]
        last = self.final[state].get(word[-1])
        if last is None:
            last = self._last_token(self.histories[state], self.letters[word[-1]], self.merges.end)[1]
            self.final[state][word[-1]] = last
            self.made += 1
        return total + last


class ChunkMap(NamedTuple):
    """How a chunk changes the count: ``head`` and ``tail`` are open; a chunk without separators has only a head."""

    head: str
    count: int
    tail: str | None


class TokenCounter(dict):
    """Counts of texts. As a dictionary: the counts of words met lately."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        self.transducer = Transducer(Merges(description["model"]))
        split = description["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = Splitter(split)
        special = [t["content"] for t in description["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = count = self.transducer.count(word.encode("utf-8", "replace"))
        return count

    def closed(self, text: str) -> int:
        """Tokens of a text that begins and ends between words."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        total = len(parts) - 1
        for part in parts:
            if not part.isascii():
                # The vocabulary's rule lower-cases each character by itself: no final form of sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            total += sum(map(self.__getitem__, self.words(part.lower())))
        return total

    def chunk_map(self, chunk: str) -> ChunkMap:
        cuts = [i for i in (chunk.find(c) for c in SEPARATORS) if i >= 0]
        if not cuts:
            return ChunkMap(chunk, 0, None)
        first, last = min(cuts), max(chunk.rfind(c) for c in SEPARATORS)
        return ChunkMap(chunk[:first], self.closed(chunk[first:last]), chunk[last + 1 :])

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        if left.tail is None:
            return ChunkMap(left.head + right.head, right.count, right.tail)
        if right.tail is None:
            return ChunkMap(left.head, left.count, left.tail + right.head)
        return ChunkMap(left.head, left.count + self.closed(left.tail + right.head) + right.count, right.tail)

    def text(self, text: str, size: int = PIECE_CHARS) -> int:
        """Tokens of a whole text: the maps of its chunks, composed pair by pair."""
        maps = [self.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[2 * len(pairs) :]
        if not maps:
            return 0
        (head, count, tail) = maps[0]
        return self.closed(head) + count + self.closed(tail or "")


@cache
def counter_of(path: str) -> TokenCounter:
    """One for all tasks of a Python worker, so that the transducer is compiled once."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """For each row ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counter = counter_of(path)

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column(1))
            columns = [
                batch.column(0),
                pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                pa.array([counter.text(t) for t in texts], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

        return of_batch

    rows = map_texts(docs, ["doc_id", "text"], "doc_id bigint, n_bytes bigint, n_tokens bigint", work)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
