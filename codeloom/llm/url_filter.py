"""URL filtering with a bit-parallel wildcard automaton (operator 5).

All glob rules are packed side by side into one mask of several 64-bit words, one bit for each
place in a rule. Reading a byte moves every rule at once: shift by one, keep the places whose
literal accepts the byte, and keep the places whose wildcard loops on it. Batches of
URLs go through the automaton together, longest first.

Rules are matched against the canonical URL: a dot, the host with A-Z lower-cased, and the path without query and
fragment. The leading dot lets ``*.org/**`` mean org and all its subdomains. In a rule ``*`` stands for
any run without a slash, ``**`` for any run, ``?`` for one byte other than a slash.

Defined results: a null URL or one without ``://`` has an empty host and path and is blocked; an empty host is
blocked unless a rule fits; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, strings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class SiteRule(NamedTuple):
    """Holds for ``host``, its subdomains and all paths that begin with ``path``. The longest that fits decides."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The given rules.
SITE_RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)

#: What decides where no site rule fits: pages without running text.
BLOCKED_GLOBS = (
    "**/login**", "**/signin**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/cgi-bin/**", "**/search/**",
    "**.exe", "**.zip", "**.jpg", "**.jpeg", "**.png", "**.gif", "**.mp4", "**.css", "**.js",
    "*.ads.*/**", "*.doubleclick.*/**", "**casino**", "**porn**",
)


class ShiftAnd:
    """Simulates all globs over batches of byte strings."""

    def __init__(self, globs: list[str]) -> None:
        places = []  # for each bit: the bytes that lead to it from the bit below, and those that keep it
        self.accepting = []
        first = []
        everything = set(range(256))
        for glob in globs:
            data, at = glob.encode(), 0
            first.append(len(places))
            places.append((set(), set()))
            while at < len(data):
                if data[at : at + 2] == b"**":
                    places[-1][1].update(everything)
                    at += 2
                    continue
                if data[at : at + 1] == b"*":
                    places[-1][1].update(everything - {ord("/")})
                else:
                    places.append(({data[at]} if data[at] != ord("?") else everything - {ord("/")}, set()))
                at += 1
            self.accepting.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.moves = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        for bit, (into, kept) in enumerate(places):
            word, mask = bit >> 6, np.uint64(1 << (bit & 63))
            for byte in into:
                self.moves[byte, word] |= mask
            for byte in kept:
                self.loops[byte, word] |= mask
        for bit in first:
            self.start[bit >> 6] |= np.uint64(1 << (bit & 63))

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        # How many texts are longer than a position.
        ascending = np.sort(lengths)
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        for position in range(int(lengths.max(initial=0))):
            running = len(texts) - int(np.searchsorted(ascending, position, "right"))
            byte = data[begins[:running] + position]
            now = state[:running]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (shifted & self.moves[byte]) | (now & self.loops[byte])
        found = np.zeros((len(texts), len(self.accepting)), bool)
        for rule, bit in enumerate(self.accepting):
            found[order, rule] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1
        return found


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(
    pages: DataFrame, rules: tuple[SiteRule, ...] = SITE_RULES, blocked: tuple[str, ...] = BLOCKED_GLOBS
) -> DataFrame:
    """For each row ``page_id``, ``host``, ``path``, ``rule`` (the site rule that decided, or null) and ``verdict``."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        # Of several rules that fit the last one set wins: shorter ones first, blocking ones last among equals.
        ordered = sorted(rules, key=lambda rule: (len(rule.name), rule.verdict == "block"))
        automaton = ShiftAnd([rule.glob for rule in ordered] + list(blocked))

        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths = strings(batch.column(1)), strings(batch.column(2))
            found = automaton.matches([f".{host}{path}".encode("utf-8", "replace") for host, path in zip(hosts, paths, strict=True)])
            refused = found[:, len(ordered) :].any(axis=1) | np.array([not host for host in hosts])
            verdict = np.where(refused, "block", "allow").astype(object)
            name = np.full(len(hosts), None, object)
            for at, rule in enumerate(ordered):
                verdict[found[:, at]] = rule.verdict
                name[found[:, at]] = rule.name
            columns = [*batch.columns, pa.array(name, pa.string()), pa.array(verdict, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

        return of_batch

    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return map_texts(
        urls, ["page_id", "host", "path"], "page_id bigint, host string, path string, rule string, verdict string", work
    )
