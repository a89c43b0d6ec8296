"""The clustered index against exact search."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as E
from codeloom.operators import clustered, search

SF = "/root/testdata/sf0.1"


def test_registered_query_reaches_the_recall(spark):
    approximate = {(r.query_id, r.id): r.distance for r in E.queries()["knn_ivf"](spark, SF).collect()}
    exact = {(r.query_id, r.id): r.distance for r in E.queries()["knn_batch"](spark, SF).where("query_id % 20 = 0").collect()}
    assert len(approximate.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(approximate[pair] == exact[pair] for pair in approximate.keys() & exact.keys())
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    corpus = rows.select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cells = math.ceil(math.sqrt(corpus.count()))
    centroids = clustered.train(corpus, cells)
    share = clustered.read_share(corpus, asked, centroids, math.ceil(clustered.PROBE_SHARE * len(centroids)))
    assert 0 < share < 1


def test_all_cells_probed_is_exact_and_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(clustered, "BLOCK_ROWS", 7)
    monkeypatch.setattr(clustered, "BLOCK_QUERIES", 3)
    same = [(i, [1.0, 0.0]) for i in range(40)]
    spread = [(100 + i, [float(i % 5), float(i // 5)]) for i in range(25)]
    corpus = spark.createDataFrame([*same, *spread, (999, None)], "id long, embedding array<double>")
    asked = corpus.where("id % 4 = 0 AND embedding IS NOT NULL").withColumnRenamed("id", "query_id")
    got = sorted(tuple(r) for r in clustered.clustered_nearest(corpus, asked, 6, cells=4, probes=4).collect())
    want = sorted(tuple(r) for r in search.nearest(corpus, asked, 6).collect())
    assert got == want


def test_nothing_to_index(spark):
    corpus = spark.createDataFrame([], "id long, embedding array<double>")
    assert clustered.clustered_nearest(corpus, corpus.withColumnRenamed("id", "query_id"), 5).count() == 0
