"""Nearest neighbours under a distance threshold.

The corpus is never joined with the queries. A set of query vectors of checked size
goes to every task, each task keeps its own k best rows per query, and only those meet
in the final ranking. One pass over the corpus serves a set; it is compared block by block.
Distances are rounded to six digits *before* ranking, so that the result does not
depend on the order in which floating point numbers were added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.vectors import similarity, squared_l2
from codeloom.session import shared_folder

CANDIDATES = 50
SHOWN = 5
THRESHOLD = 1.3
DIGITS = 6
#: Queries that are compared together with a batch of rows.
QUERIES_PER_BLOCK = 1024
#: Vector entries of the queries that go to the tasks at once: at most about 32 MB of them.
QUERY_VALUES = 4_000_000
#: Hits up to this number are sent to the scan of the documents; of more the join is left to Spark.
BROADCAST_HITS = 100_000
_SALTS = 64
#: Cells (or numbers of their vectors) that a task works on at once: about 8 MB for each array of them.
_CELLS = 1_000_000
_SEED = 7


class EncoderMismatch(ValueError):
    """The collection was written with another encoder than the one of the query."""


def check_encoder(collection: DataFrame, encoder: str) -> None:
    other = collection.where(~F.col("encoder").eqNullSafe(F.lit(encoder))).select("encoder").limit(1).collect()
    if other:
        raise EncoderMismatch(f"collection was encoded with {other[0][0]}, the query with {encoder}")


def nearest_to(corpus: DataFrame, query: Column, k: int = CANDIDATES, vector: str = "embedding") -> DataFrame:
    """The k rows of ``corpus`` nearest to one dense vector: ``(rank, id, distance)``.

    ``query`` is a literal or a scalar subquery. Only k rows per task reach the final merge.
    """
    scored = corpus.select("id", vector, query.alias("query")).select(
        "id", F.round(squared_l2(F.col(vector), F.col("query")), DIGITS).alias("distance")
    )
    best = scored.orderBy("distance", "id").limit(k)
    return best.select(F.row_number().over(Window.orderBy("distance", "id")).alias("rank"), "id", "distance")


def _first_k(
    query: np.ndarray, distances: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest (distance, id) pairs of every query, all ties decided by id."""
    order = np.lexsort((ids, distances, query))
    query, distances, ids = query[order], distances[order], ids[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    near = place < k
    return query[near], distances[near], ids[near]


class _Dense:
    """Exact distances to a block of dense query vectors.

    The product form finds the cells that can be among the best, within the bound of its rounding
    error; only those are computed from the differences.
    """

    def __init__(self, block: pd.DataFrame, k: int, threshold: float | None) -> None:
        self.queries = np.stack(block["v0"].to_list()).astype(np.float64)
        self.squares = (self.queries * self.queries).sum(axis=1)
        self.k, self.threshold = k, np.inf if threshold is None else threshold

    def cells(self, batch: pa.RecordBatch, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, distance) of the cells that matter: those that may lie within ``bound``, a distance per query.

        The caller may lower ``bound`` between two steps.
        """
        count, width = self.queries.shape
        rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        step = max(1, _CELLS // max(count, width))
        for start in range(0, len(rows), step):
            part = rows[start : start + step].astype(np.float64)
            own = (part * part).sum(axis=1)
            # Rounding of sums of ``width`` products, twice over; half a last digit for ties after rounding.
            slack = 8.0 * (width + 2) * np.finfo(np.float64).eps * (own.max() + self.squares) + 10.0**-DIGITS
            rough = self.queries @ part.T
            rough *= -2.0
            rough += self.squares[:, None]
            rough += own[None, :]
            apart = self.apart(part)
            if apart is not None:
                rough[apart] = np.inf
            limit = np.minimum(bound, self.threshold)
            unbound = np.flatnonzero(np.isinf(limit))
            if len(unbound) and len(part) > self.k:
                limit[unbound] = np.partition(rough[unbound], self.k - 1, axis=1)[:, self.k - 1] + slack[unbound]
            query, row = np.nonzero((rough <= (limit + slack)[:, None]) & (rough < np.inf))
            del rough
            found = np.empty(len(row))
            pairs = max(1, _CELLS // width)
            for at in range(0, len(row), pairs):
                away = part[row[at : at + pairs]] - self.queries[query[at : at + pairs]]
                found[at : at + pairs] = (away * away).sum(axis=1)
            yield start + row, query, found

    def apart(self, part: np.ndarray) -> np.ndarray | None:
        """The cells that are not compared: none."""
        return None


class _Bucketed(_Dense):
    """Distances to those rows that share a bucket of a random projection with the query in at least one table."""

    def __init__(self, block: pd.DataFrame, k: int, threshold: float | None, tables: int, bucket_length: float) -> None:
        super().__init__(block, k, threshold)
        lines = np.random.default_rng(_SEED).normal(size=(tables, self.queries.shape[1]))
        self.lines = lines / np.linalg.norm(lines, axis=1, keepdims=True) / bucket_length
        self.buckets = np.floor(self.queries @ self.lines.T)

    def apart(self, part: np.ndarray) -> np.ndarray:
        of_rows = np.floor(part @ self.lines.T)
        return reduce(np.logical_and, (self.buckets[:, t, None] != of_rows[None, :, t] for t in range(len(self.lines))))


class _Sparse:
    """Distances to a block of sparse query vectors of unit length.

    The block is an inverted index (bucket to queries). With a threshold below 2 only the cells that share a bucket
    are made; otherwise all cells are.
    """

    def __init__(self, block: pd.DataFrame, k: int, threshold: float | None) -> None:
        owners = np.repeat(np.arange(len(block)), block["v0"].map(len).to_numpy())
        buckets = np.concatenate(block["v0"].to_list()).astype(np.int64)
        weights = np.concatenate(block["v1"].to_list()).astype(np.float64)
        order = np.argsort(buckets, kind="stable")
        self.owners, self.weights = owners[order], weights[order]
        self.buckets, self.offsets = np.unique(buckets[order], return_index=True)
        self.offsets = np.append(self.offsets, len(buckets))
        self.count = len(block)
        self.sharing = threshold is not None and threshold <= 2.0

    def cells(self, batch: pa.RecordBatch, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, distance) of the cells. Rows are taken in parts of at most ``_CELLS`` postings, one row at least."""
        ends = np.cumsum(np.asarray(batch.column(1).value_lengths()), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + _CELLS, "right")))
            for row, query, found in self._cells(batch.slice(start, stop - start)):
                yield start + row, query, found
            start = stop

    def _cells(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        buckets_of, weights_of = batch.column(1), batch.column(2)
        ends = np.concatenate([[0], np.cumsum(np.asarray(buckets_of.value_lengths()))])
        found = buckets_of.flatten().to_numpy(zero_copy_only=False)
        values = weights_of.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        place = np.searchsorted(self.buckets, found)
        shared = place < len(self.buckets)
        shared[shared] = self.buckets[place[shared]] == found[shared]
        row, place, values = row[shared], place[shared], values[shared]
        hits = self.offsets[place + 1] - self.offsets[place]
        # Postings up to each row, so that a step makes a bounded number of cells.
        made = np.cumsum(np.bincount(row, weights=hits, minlength=batch.num_rows)).astype(np.int64)
        begins = np.searchsorted(row, np.arange(batch.num_rows + 1))
        start = 0
        while start < batch.num_rows:
            base = made[start - 1] if start else 0
            stop = int(np.searchsorted(made, base + _CELLS, "right"))
            stop = min(max(start + 1, stop), batch.num_rows)
            if not self.sharing:
                stop = min(stop, start + max(1, _CELLS // self.count))
            part = slice(begins[start], begins[stop])
            times = hits[part]
            first = np.repeat(self.offsets[place[part]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(times) else times
            at = first + np.arange(len(first))
            cell = np.repeat(row[part] - start, times) * self.count + self.owners[at]
            product = np.repeat(values[part], times) * self.weights[at]
            if self.sharing:
                cell, of = np.unique(cell, return_inverse=True)
                dots = np.bincount(of, weights=product, minlength=len(cell))
            else:
                dots = np.bincount(cell, weights=product, minlength=(stop - start) * self.count)
                cell = np.arange(len(dots))
            yield start + cell // self.count, cell % self.count, 2.0 - 2.0 * dots
            start = stop


def _within(
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, bound: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query in all of ``found``; ``bound`` is lowered to the k-th distance of those that have k."""
    query, distances, ids = _first_k(*(np.concatenate(parts) for parts in zip(*found, strict=True)), k)
    lasts = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.empty(0, np.int64)
    full = lasts[np.diff(lasts, prepend=-1) == k]
    bound[query[full]] = distances[full]
    return query, distances, ids


def _search_pass(
    shared: Broadcast, compared: Callable, k: int, threshold: float | None, output: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over the corpus for all queries of ``shared``: the k best rows of the task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        blocks = [
            (start, compared(queries.iloc[start : start + QUERIES_PER_BLOCK], k, threshold))
            for start in range(0, len(queries), QUERIES_PER_BLOCK)
        ]
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(blocks)
        bounds = np.full(len(queries), np.inf)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_pandas().to_numpy()
            for b, (start, block) in enumerate(blocks):
                bound = bounds[start : start + QUERIES_PER_BLOCK]
                mine, waiting = [] if kept[b] is None else [kept[b]], 0
                for row, query, found in block.cells(batch, bound):
                    found = np.round(np.maximum(found, 0.0), DIGITS)
                    if threshold is not None:
                        near = found < threshold
                        row, query, found = row[near], query[near], found[near]
                    mine.append((query, found, ids[row]))
                    waiting += len(query)
                    # What waits is at most as much as is kept, and one step.
                    if waiting > k * len(bound):
                        mine, waiting = [_within(mine, k, bound)], 0
                if mine:
                    kept[b] = mine[0] if len(mine) == 1 and not waiting else _within(mine, k, bound)
        names = pa.array(queries["query_id"].to_list(), output.field(0).type)
        for (start, _), best in zip(blocks, kept, strict=True):
            if best is not None and len(best[0]):
                columns = [names.take(pa.array(best[0] + start)), pa.array(best[2], output.field(1).type)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best[1], output.field(2).type)], schema=output)

    return run


def _query_passes(queries: DataFrame) -> Iterator[pd.DataFrame]:
    """The queries in sets of at most ``QUERY_VALUES`` vector entries; the driver holds one set at a time.

    The query plan runs once. More queries than one set holds cost a further pass over the corpus each.
    """
    taken: list[tuple] = []
    values = 0
    for row in queries.toLocalIterator(prefetchPartitions=True):
        # Packed numbers: lists of them take four times the memory, in every task too.
        taken.append((row[0], *(np.asarray(v) for v in row[1:])))
        values += len(row["v0"])
        if values >= QUERY_VALUES:
            yield pd.DataFrame(taken, columns=queries.columns)
            taken, values = [], 0
    if taken:
        yield pd.DataFrame(taken, columns=queries.columns)


def top_per_query(hits: DataFrame, k: int) -> DataFrame:
    """Rank 1..k per query. A first cut per (query, salt) keeps any one task's share small."""
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    order = [F.col("distance"), F.col("id")]
    cut = (
        hits.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order)))
        .where(F.col("rank") <= k)
        .drop("salt", "rank")
    )
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, threshold: float | None = None) -> DataFrame:
    """k nearest rows of every query: ``(query_id, rank, id, distance)``.

    Corpus and queries both carry either ``embedding`` (dense, one length) or ``vector``
    (sparse, unit length); the corpus is keyed by ``id``, the queries by ``query_id``.
    """
    return _nearest(corpus, queries, k, threshold)[0]


def _nearest(
    corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None, compared: Callable | None = None
) -> tuple[DataFrame, int]:
    """What ``nearest`` returns, and the number of queries."""
    dense = "embedding" in corpus.columns
    compared = compared or (_Dense if dense else _Sparse)
    key_type = corpus.schema["id"].dataType
    query_type = queries.schema["query_id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", key_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    output = to_arrow_schema(schema)
    context = corpus.sparkSession.sparkContext
    vectors = [F.col("embedding")] if dense else [F.col("vector.buckets"), F.col("vector.weights")]
    present = vectors[0].isNotNull()
    rows = corpus.where(present).select("id", *vectors)
    asked = queries.where(present).select("query_id", *[v.alias(f"v{i}") for i, v in enumerate(vectors)])

    parts, count = [], 0
    for part in _query_passes(asked):
        parts.append(rows.mapInArrow(_search_pass(context.broadcast(part), compared, k, threshold, output), schema))
        count += len(part)
    if not parts:
        none = corpus.sparkSession.createDataFrame([], schema)
        return none.select("query_id", F.lit(0).alias("rank"), "id", "distance"), 0
    return top_per_query(reduce(DataFrame.unionByName, parts), k), count


def hits(
    corpus: DataFrame,
    queries: DataFrame,
    threshold: float = THRESHOLD,
    shown: int = SHOWN,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """HIT rows: the nearest rows strictly below the threshold, at most ``shown`` per query.

    Asking for ``candidates`` rows first and filtering then would give the same: the filter is
    monotone in the sort key, ``min(shown, candidates)`` filtered rows are enough.
    """
    best, count = _nearest(corpus, queries, min(shown, candidates), threshold)
    found = best.withColumn("similarity", similarity(F.col("distance"), threshold))
    if "document" not in corpus.columns:
        return found
    # Documents are looked up for the few hits only; the vector scan does not read them. A query brings
    # at most ``shown`` hits, so their number is bounded by that of the queries.
    sent = F.broadcast(found) if count * shown <= BROADCAST_HITS else found
    return sent.join(corpus.select("id", "document"), "id").select(
        "query_id", "rank", "id", "document", "distance", "similarity"
    )


def approximately_nearest(
    corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, tables: int = 8, bucket_length: float = 0.5
) -> DataFrame:
    """k neighbours of every dense query by random projections: ``(query_id, rank, id, distance)``.

    Only rows that share a bucket with the query are compared, in one pass as in ``nearest``. Queries for which the buckets
    hold fewer than k rows are asked again exactly, so every query has k rows if the corpus has them.
    """
    compared = partial(_Bucketed, tables=tables, bucket_length=bucket_length)
    found = _nearest(corpus, queries, k, None, compared)[0]
    context = corpus.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(corpus.sparkSession))
    found = found.checkpoint()
    full = found.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, queries["query_id"].eqNullSafe(full["query_id"]), "left_anti")
    exact = nearest(corpus, short, k)
    return found.join(full.withColumnRenamed("query_id", "full_id"), F.col("query_id").eqNullSafe(F.col("full_id")), "left_semi").unionByName(exact)


def approximate_nearest(
    corpus: DataFrame, query: Sequence[float], k: int = CANDIDATES, tables: int = 8, bucket_length: float = 0.5
) -> DataFrame:
    """k approximate neighbours of one dense vector by random projections: ``(rank, id, distance)``."""
    asked = corpus.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<double>")
    return approximately_nearest(corpus, asked, k, tables, bucket_length).drop("query_id")
