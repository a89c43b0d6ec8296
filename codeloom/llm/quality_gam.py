"""Quality classifier: a generalised additive model with pairwise interactions (operator 7).

Each feature of a text is cut into bins, and the model is one lookup table per feature plus one per chosen
pair of features. Tables are learnt by boosting in cycles: shallow trees on one feature at a time, then on
one pair at a time, each fitted to what all tables together still get wrong. A score adds one entry of each table.

Features are counted once over whole texts. The model is learnt on at most about ``MOST_ROWS`` labelled rows, taken by a
hash of their ids; with fewer, on all. Rows whose crc32 is divisible by five are never learnt from.

Defined results: null and empty texts have features of zero and get a score like any other; without usable labels every
score is one half, with labels of one class near it; a null id is held out; repeated rows give repeated rows; of
several labels of an id each counts; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, map_texts, strings

MOST_ROWS = 100_000
FOLDS = 5
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 6
RATE, LEAST_WEIGHT, RIDGE = 0.15, 2.0, 1.0

FEATURES = (
    "log_words", "word_length", "upper", "marks", "bars", "shouts", "digits", "spaces", "beyond_ascii", "commas", "stops",
    "distinct", "stutter", "top_word", "equal_lines", "line_words", "at_signs",
)
_UPPER, _MARKS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>", b"0123456789"
_HIGH = bytes(range(128, 256))


def features(text: str) -> list[float]:
    """Measures of a whole text that do not know its language or source."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [line for line in data.split(b"\n") if line.strip()]

    def share(characters: bytes) -> float:
        return (size - len(data.translate(None, characters))) / size

    counts = Counter(words)
    return [
        math.log(n), sum(map(len, words)) / n, share(_UPPER), share(_MARKS), data.count(b"|") / n, data.count(b"!") / n,
        share(_DIGITS), 1 - sum(map(len, words)) / size, share(_HIGH), data.count(b",") / n, data.count(b".") / n,
        len(counts) / n, sum(map(operator.eq, words, words[1:])) / n, max(counts.values()) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), data.count(b"@") / n,
    ]


def feature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``: the features of each row's text."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array([features(text) for text in strings(batch.column(1))], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

        return of_batch

    return map_texts(docs, ["doc_id", "text"], "doc_id bigint, x array<double>", work)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


class Model(NamedTuple):
    """``edges`` and ``tables`` by feature; ``pairs`` with their tables, on the bins of ``coarse`` edges."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return g / (h + RIDGE)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def line_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over the bins of one feature, from their gradients and weights."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
        gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
        cut = int(gain.argmax())
        if gain[cut] > 1e-9:
            return np.concatenate([line_tree(g[: cut + 1], h[: cut + 1], depth - 1), line_tree(g[cut + 1 :], h[cut + 1 :], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of the best cut of a pair's bins into four quadrants, and its gain."""
    sums = []
    for values in (g, h):
        s = values.cumsum(0).cumsum(1)
        a = s[:-1, :-1]
        sums.append((a, s[:-1, -1:] - a, s[-1:, :-1] - a, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + a))
    gain = sum(_gain(a, b) for a, b in zip(*sums, strict=True)) - _gain(g.sum(), h.sum())
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    quarters = ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
                (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))
    for q in quarters:
        out[q] = _leaf(g[q].sum(), h[q].sum())
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns the tables. Rows are put in order first, so the result does not depend on how they arrive."""
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order].astype(float)
    start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for c in x.T]
    # Bins at the ends for rare values that quantiles pass over.
    edges = [np.unique(np.concatenate([e, np.quantile(c, [0.005, 0.995]), [np.nextafter(c.min(), np.inf)]])) if len(c) else e
             for e, c in zip(edges, x.T, strict=True)]
    coarse = [e[np.unique(np.linspace(0, len(e) - 1, PAIR_BINS - 1).round().astype(int))] if len(e) else e for e in edges]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    flat = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(start, edges, tables, coarse, [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = RATE * line_tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(flat[i] * shape[1] + flat[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = [(-plane_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(len(tables)) for j in range(i)]
    for _, i, j in sorted(gains)[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * plane_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            total += step[flat[i], flat[j]]
    return model


def learn(rows: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model from the features of ``rows`` and the ``quality`` of ``labels``, held-out rows left aside."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("id"), "quality")
    share = min(1.0, most_rows / max(1, usable.count()))
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    known = rows.join(usable, rows["doc_id"] == usable["id"]).select("x", "quality").toArrow()
    x = np.array(known.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, known.column("quality").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    rows = checkpointed(feature_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, labels))

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

        return of_batch

    scored = map_texts(rows, ["doc_id", "x"], "doc_id bigint, score double", work)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
