"""Memory of search and encoding follows bounded steps, not the size of a batch or of the table."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.operators import clustered, search
from codeloom.streaming import index_stream


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_dense_step_is_small():
    """Before, five arrays of four million cells each, and exact distances of every step's 50 best rows."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(5000, 64))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * 5000 + 1, 64, dtype=np.int32)), pa.array(vectors.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), rows], ["id", "embedding"])

    class Shared:
        value = pd.DataFrame({"query_id": range(1024), "v0": list(vectors[:1024])})

    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    found = []
    run = search._search_pass(Shared, search._Dense, 50, None, schema)
    assert peak_mb(lambda: found.extend(run(iter([batch])))) < 80
    got = found[0].to_pandas()
    for q in (0, 517, 1023):
        exact = np.round(((vectors - vectors[q]) ** 2).sum(axis=1), search.DIGITS)
        best = np.lexsort((np.arange(5000), exact))[:50]
        mine = got[got.query_id == q].sort_values(["distance", "id"])
        assert mine.id.to_list() == best.tolist() and mine.distance.to_list() == exact[best].tolist()


def test_a_sparse_step_is_small():
    """A batch of a few thousand long vectors is compared in parts."""
    count, width = 4000, 1000
    buckets = np.tile(np.arange(width, dtype=np.int32), count)
    offsets = pa.array(np.arange(0, count * width + 1, width, dtype=np.int32))
    weights = pa.array(np.full(count * width, width**-0.5))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(count)), pa.ListArray.from_arrays(offsets, pa.array(buckets)), pa.ListArray.from_arrays(offsets, weights)],
        ["id", "v0", "v1"],
    )
    block = pd.DataFrame({"query_id": [1], "v0": [np.arange(2)], "v1": [np.array([0.6, 0.8])]})
    sparse = search._Sparse(block, 5, 1.9)
    seen = []

    def work():
        for row, _, found in sparse.cells(batch, np.full(1, np.inf)):
            seen.extend(zip(row.tolist(), np.round(found, 6).tolist(), strict=True))

    assert peak_mb(work) < 100
    assert seen == [(i, round(2 - 2 * 1.4 * width**-0.5, 6)) for i in range(count)]


def test_cells_share_blocks_and_large_ones_have_several(monkeypatch):
    monkeypatch.setattr(clustered, "BLOCK_ROWS", 10)
    assert clustered._row_blocks([(0, 4), (1, 5), (2, 3), (3, 25), (4, 1)]) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 5, 1)]


def test_groups_of_the_clustered_search_are_dealt_to_more_tasks(spark, monkeypatch):
    """Blocks of equal rows: more than twice k ties are still ranked by id."""
    monkeypatch.setattr(clustered, "BLOCK_ROWS", 40)
    monkeypatch.setattr(clustered, "BLOCK_QUERIES", 10)
    rows = [(i, [1.0, 2.0]) for i in range(300, 0, -1)] + [(1000 + i, [float(i), 0.0]) for i in range(100)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = corpus.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    found = clustered.clustered_nearest(corpus, asked, 6, cells=5, probes=5)
    assert found._jdf.queryExecution().toString().count("hashpartitioning(row_block") == 1
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(tuple(r) for r in search.nearest(corpus, asked, 6).collect())


def test_tasks_follow_the_characters(spark, monkeypatch):
    monkeypatch.setattr(index_stream, "CHARS_PER_TASK", 10)
    rows = spark.createDataFrame(
        [([("a", "x" * 450), ("b", None)], None), ([("c", "x" * 5000)], "bad"), (None, "bad")],
        "chunks array<struct<id: string, content: string>>, error string",
    )
    assert index_stream._tasks(rows) == 45
    assert index_stream._tasks(rows.where(F.lit(False))) == int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
