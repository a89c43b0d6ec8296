"""Spelling variants by k-d trees over letter counts (operator 12).

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the texts, A-Z lower-cased; a run whose
``crc32("<doc_id>:<run>")`` (unsigned) is divisible by 31 loses its code point at ``h % length``. The vocabulary is
the distinct results of at least ``LEAST_CHARS`` code points seen at least ``LEAST_SEEN`` times (``n``). Two words
are near when one inserted, deleted or replaced code point turns one into the other.

One edit changes a word's vector of letter counts by an L1 distance of at most two, so near words are found by
range searches of radius two in k-d trees over these vectors, box-pruned, and each candidate's letter order is
verified. Words are compared per length pair (L, L) and (L, L + 1); the words of each length are dealt by a hash
into trees of at most ``INDEX_BLOCK`` words and into query blocks of at most ``ASK_BLOCK``, and every pair of
(query block, tree) is one group: the tree is built over its words and searched with all queries of the block at
once. No group holds more than one tree and one query block, however many words share a length, and every pair
of lengths that can hold a near pair is compared whole. A search in a tree of n words takes at most two wrong
turns, so its cost grows with the square of log n: large trees cost less than many small ones.

A word's form is its near word of largest ``n`` (ties: smallest in code-point order) if that ``n`` is at least
``FORM_RATIO`` times its own; its root follows forms to the end (each step multiplies ``n`` by ten or more, so a
chain has at most about twenty steps; the loop runs until no root changes).

Defined results: null texts and texts without runs give no words; rows without doc_id take no deletion (their key
is null); repeated rows count again; ties of ``n`` take the smaller word; an empty table gives an empty result;
further columns are ignored; very long texts are split by the JVM's regular expressions, without a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_CHARS = 7
LONG_RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_CHARS},}}"
LEAST_SEEN = 2
FORM_RATIO = 10
#: Words of one length in one tree, and queries of one length asked in one group.
INDEX_BLOCK = 250_000
ASK_BLOCK = 100_000
#: Points in a leaf of a tree.
LEAF = 8
#: One edit moves a vector of letter counts by at most this much.
RADIUS = 2
_ASKS_AT_ONCE = 1024


def occurrences(docs: DataFrame) -> DataFrame:
    """One row (``word``) per run of every text, A-Z lower-cased and with the hashed deletion applied."""
    runs = docs.select(
        "doc_id",
        # Only runs of LEAST_CHARS or more can give a word (a deletion only shortens); matching from the left with
        # a greedy count still yields maximal runs.
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LONG_RUN), F.lit(0))).alias("run"),
    ).select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    return hashed.selectExpr(
        """CASE WHEN h % 31 = 0
                THEN concat(substring(run, 1, CAST(h % char_length(run) AS INT)), substring(run, CAST(h % char_length(run) AS INT) + 2))
                ELSE run END AS word"""
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n (long), length: the words kept, counted over all texts (an aggregate with map-side combination)."""
    return (
        occurrences(docs)
        .where(F.char_length("word") >= LEAST_CHARS)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_SEEN)
        .withColumn("length", F.char_length("word"))
    )


def _vectors(words: list[str], alphabet: dict[str, int]) -> np.ndarray:
    width = len(alphabet)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    cols = np.fromiter((alphabet[c] for w in words for c in w), np.int64, len(rows))
    counts = np.bincount(rows * width + cols, minlength=len(words) * width)
    return counts.astype(np.int16).reshape(len(words), width)


class KdTree:
    """A k-d tree over integer vectors: split on the widest coordinate at its median value.

    A node keeps its split (coordinate, value) and the interval that its ancestors' splits leave for that
    coordinate; a search keeps, for every query, the L1 distance from it to the node's box, and a step down
    changes only the split coordinate's share, so it costs one operation per query and not per coordinate.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.nodes: list[tuple] = []
        width = points.shape[1]
        top = int(points.max()) + 1 if len(points) else 1
        self.root = self._build(np.arange(len(points)), np.zeros(width, np.int64), np.full(width, top, np.int64))

    def _build(self, members: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        node = len(self.nodes)
        self.nodes.append((members,))
        if len(members) <= LEAF:
            return node
        here = self.points[members]
        spread = here.max(axis=0) - here.min(axis=0)
        if not spread.any():
            return node
        axis = int(spread.argmax())
        values = here[:, axis]
        cut = int(np.median(values))
        if cut >= values.max():
            cut = int(values.max()) - 1
        left = values <= cut
        low_hi, high_lo = hi.copy(), lo.copy()
        low_hi[axis], high_lo[axis] = cut, cut + 1
        first = self._build(members[left], lo, low_hi)
        second = self._build(members[~left], high_lo, hi)
        self.nodes[node] = (None, axis, cut, int(lo[axis]), int(hi[axis]), first, second)
        return node

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, point rows) of all pairs at L1 distance ``radius`` or less; all queries go down together."""
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while stack:
            node, active, bound = stack.pop()
            entry = self.nodes[node]
            if entry[0] is None:
                _, axis, cut, lo, hi, first, second = entry
                q = queries[active, axis].astype(np.int64)
                before = np.maximum(np.maximum(lo - q, q - hi), 0)
                for child, a, b in ((first, lo, cut), (second, cut + 1, hi)):
                    moved = bound - before + np.maximum(np.maximum(a - q, q - b), 0)
                    keep = moved <= radius
                    if keep.any():
                        stack.append((child, active[keep], moved[keep]))
                continue
            members = entry[0]
            points = self.points[members]
            for at in range(0, len(active), _ASKS_AT_ONCE):
                part = active[at : at + _ASKS_AT_ONCE]
                distance = np.abs(queries[part][:, None, :] - points[None, :, :]).sum(axis=2)
                qi, pi = np.nonzero(distance <= radius)
                yield part[qi], members[pi]


def _codes(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, one row each."""
    return np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)


def _one_edit_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether ``b`` is ``a`` with one code point replaced (equal widths) or inserted (one wider)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    width = a.shape[1]
    same = a == b[:, :width]
    first = np.where(same.all(axis=1), width, same.argmin(axis=1))
    behind = np.flip(np.logical_and.accumulate(np.flip(a == b[:, 1:], axis=1), axis=1), axis=1)
    behind = np.concatenate((behind, np.ones((len(a), 1), bool)), axis=1)
    return behind[np.arange(len(a)), first]


def _near_of_lengths(queries: list[str], index: list[str]) -> list[tuple[str, str]]:
    """Near pairs of queries of one length against index words of that length or one more."""
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(queries)) | set("".join(index))))}
    asked, points = _vectors(queries, alphabet), _vectors(index, alphabet)
    tree = KdTree(points)
    length, other = len(queries[0]), len(index[0])
    a_codes, b_codes = _codes(queries, length), _codes(index, other)
    # One replacement moves two counts by one, one insertion moves one count.
    exact = 2 if length == other else 1
    rank = {w: r for r, w in enumerate(sorted(set(queries) | set(index)))} if length == other else {}
    a_rank = np.fromiter((rank.get(w, 0) for w in queries), np.int64, len(queries))
    b_rank = np.fromiter((rank.get(w, 0) for w in index), np.int64, len(index))
    found = []
    for qs, vs in tree.within(asked, RADIUS):
        keep = np.abs(asked[qs] - points[vs]).sum(axis=1) == exact
        if length == other:
            keep &= a_rank[qs] < b_rank[vs]
        qs, vs = qs[keep], vs[keep]
        near = _one_edit_rows(a_codes[qs], b_codes[vs])
        found += [(queries[q], index[v]) for q, v in zip(qs[near].tolist(), vs[near].tolist(), strict=True)]
    return found


def near_pairs(queries: list[str], index: list[str]) -> list[tuple[str, str]]:
    """All pairs (q, v) one edit apart, q from ``queries``, v from ``index``; if the lengths are equal only q < v."""
    by_length: dict[int, list[str]] = {}
    for w in index:
        by_length.setdefault(len(w), []).append(w)
    asked: dict[int, list[str]] = {}
    for w in queries:
        asked.setdefault(len(w), []).append(w)
    found = []
    for length, words in sorted(asked.items()):
        for other in (length, length + 1):
            if other in by_length:
                found += _near_of_lengths(words, by_length[other])
    return found


def _pairs_of_group(rows: pd.DataFrame) -> pd.DataFrame:
    asks = rows["role"] == "q"
    found = near_pairs(rows.loc[asks, "word"].tolist(), rows.loc[~asks, "word"].tolist())
    return pd.DataFrame(found, columns=["a", "b"], dtype=object)


def near_words(vocab: DataFrame) -> DataFrame:
    """a, b: every near pair of the vocabulary once, ``len(a) < len(b)`` or ``a < b``."""
    lengths = vocab.groupBy("length").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(INDEX_BLOCK)).cast("int").alias("trees"),
        F.ceil(F.count(F.lit(1)) / F.lit(ASK_BLOCK)).cast("int").alias("asks"),
    )
    # One row for each length that words have: bounded by the longest word, counted before it is sent.
    sizes = F.broadcast(lengths) if lengths.count() <= 100_000 else lengths
    placed = (
        vocab.join(sizes, "length")
        .withColumn("tree", F.pmod(F.xxhash64("word"), F.col("trees")).cast("int"))
        .withColumn("ask", F.pmod(F.xxhash64("word", F.lit(1)), F.col("asks")).cast("int"))
    )
    target = sizes.select(F.col("length").alias("target"), F.col("trees").alias("target_trees"))
    asks = (
        placed.withColumn("target", F.explode(F.array(F.col("length"), F.col("length") + 1)))
        .join(target, "target")
        .select(
            F.col("length").alias("from_length"),
            "target",
            "ask",
            F.explode(F.sequence(F.lit(0), F.col("target_trees") - 1)).alias("tree"),
            F.lit("q").alias("role"),
            "word",
        )
    )
    source = sizes.select(F.col("length").alias("from_length"), F.col("asks").alias("from_asks"))
    index = (
        placed.withColumn("from_length", F.explode(F.array(F.col("length"), F.col("length") - 1)))
        .join(source, "from_length")
        .select(
            "from_length",
            F.col("length").alias("target"),
            F.explode(F.sequence(F.lit(0), F.col("from_asks") - 1)).alias("ask"),
            "tree",
            F.lit("i").alias("role"),
            "word",
        )
    )
    return (
        asks.unionByName(index)
        .groupBy("from_length", "target", "ask", "tree")
        .applyInPandas(_pairs_of_group, "a string, b string")
    )


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root (string); n, n_near, form_n (long) for every word of the vocabulary."""
    vocab = checkpointed(vocabulary(docs))
    pairs = checkpointed(near_words(vocab))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )
    scored = both.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = scored.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near"))).alias("best")
    )
    forms = vocab.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.neg") >= FORM_RATIO * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.neg") >= FORM_RATIO * F.col("n"), -F.col("best.neg")).cast("long").alias("form_n"),
    )
    forms = checkpointed(forms)
    links = forms.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("form").alias("next"))
    rooted = forms.withColumn("root", F.col("word"))
    while True:
        stepped = checkpointed(
            rooted.join(links, "root", "left").withColumn("moved", F.col("next").isNotNull())
            .withColumn("root", F.coalesce("next", "root")).drop("next")
        )
        if not stepped.where("moved").limit(1).count():
            return stepped.drop("moved").select("word", "form", "root", "n", "n_near", "form_n")
        rooted = stepped.drop("moved")
