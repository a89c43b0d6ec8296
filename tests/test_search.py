import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from codeloom.operators import encode, search
from codeloom.operators.store import Collection
from codeloom.plans.index import ask, index_directory, index_files, refresh_directory
from codeloom.plans.queries import QUERIES

DOCUMENTS = [
    ("door.js_openDoor_3", "function openDoor(key) { return lock.turn(key); }"),
    ("garden.py_water_plants_7", "def water_plants(beds): return [pump.run(bed) for bed in beds]"),
]


def corpus(spark, rows):
    texts = spark.createDataFrame(rows, "id string, document string")
    return texts.join(encode.encoded(texts, "id", "document"), "id", "left").withColumn("encoder", F.lit(encode.BUILT_IN))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_questions_find_their_chunk(spark):
    found = ask(corpus(spark, DOCUMENTS), queries(spark, "open a door with its key", "water plants in all beds"), shown=1)
    assert {r.query_id: r.id for r in found.collect()} == {0: DOCUMENTS[0][0], 1: DOCUMENTS[1][0]}


def test_stricter_threshold_and_no_match(spark):
    rows = [("id1", "Some notes on zebras"), ("id2", "Other lines about rivers")]
    found = ask(corpus(spark, rows), queries(spark, "notes on zebras", "zzz qqq", "is this"), threshold=1.0).collect()
    assert [(r.query_id, r.rank, r.id) for r in found] == [(0, 1, "id1")]
    assert found[0].similarity == pytest.approx(1.0 - found[0].distance)


def test_other_encoder_is_refused(spark):
    rows = corpus(spark, DOCUMENTS).withColumn("encoder", F.lit("all-MiniLM-L6-v2"))
    with pytest.raises(search.EncoderMismatch):
        ask(rows, queries(spark, "x"))


def by_hand(text):
    parted = regex.sub(r"([\p{Ll}\p{N}])(\p{Lu})", r"\1 \2", text).lower()
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", parted) if w and w not in encode.STOP_WORDS]
    counts = Counter()
    for word in words:
        framed = f"^{word}$"
        for at in range(len(word)):
            a, b, c = map(ord, framed[at : at + 3])
            counts[((a * 128 + b) * 128 + c) % 2**24 * 2654435761 % 2**32 >> 20] += 1
    raw = {b: 1 + math.log(n) for b, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {b: w / norm for b, w in raw.items()}


def test_encoder_recipe(spark):
    texts = ["validateToken(token)", "a b c", "x", "price price price_1", "the is", "", "größeÄnderung größe", "世界 мир"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: dict(zip(r.vector.buckets, r.vector.weights)) for r in encode.encoded(frame, "id", "text").collect()}
    for i, text in enumerate(texts):
        expected = by_hand(text)
        assert found.get(i, {}).keys() == expected.keys()
        assert all(found[i][b] == pytest.approx(w) for b, w in expected.items())


def brute(corpus_rows, query_rows, k, threshold=None):
    expected = set()
    for query_id, q in query_rows:
        scored = sorted((round(float(((v - q) ** 2).sum()), 6), i) for i, v in corpus_rows)
        kept = [s for s in scored if threshold is None or s[0] < threshold][:k]
        expected |= {(query_id, rank + 1, i) for rank, (_, i) in enumerate(kept)}
    return expected


@pytest.mark.parametrize("block", [1024, 6])
def test_dense_search_is_exact(spark, monkeypatch, block):
    """Many copies of one vector decide ties by id; small blocks split the queries."""
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[100:200] = vectors[0]
    rows = [(i, v.astype(np.float64)) for i, v in enumerate(vectors)]
    asked = [(q, rows[q * 17][1]) for q in range(12)]
    to_list = lambda pairs: [(int(i), [float(x) for x in v]) for i, v in pairs]
    frame = spark.createDataFrame(to_list(rows), "id long, embedding array<float>").repartition(5)
    asked_frame = spark.createDataFrame(to_list(asked), "query_id int, embedding array<float>")
    found = search.nearest(frame, asked_frame, 50)
    assert {(r.query_id, r.rank, r.id) for r in found.collect()} == brute(rows, asked, 50)
    near = search.hits(frame, asked_frame, 9.0)
    assert {(r.query_id, r.rank, r.id) for r in near.collect()} == brute(rows, asked, 5, 9.0)
    one = search.nearest_to(frame, F.array(*[F.lit(float(x)) for x in asked[3][1]]), 7)
    assert {(3, r["rank"], r.id) for r in one.collect()} == brute(rows, asked[3:4], 7)


def test_large_vectors_and_several_passes(spark, monkeypatch):
    """Far from the origin the product form alone would lose all digits; equal query ids are separate queries."""
    monkeypatch.setattr(search, "QUERY_VALUES", 24)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in 1e5 + rng.normal(scale=0.01, size=8)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = frame.withColumnRenamed("id", "query_id").where("query_id < 10").coalesce(1)
    found = {(r.query_id, r["rank"], r.id, r.distance) for r in search.nearest(frame, asked, 4).collect()}
    for q in range(10):
        one = search.nearest_to(frame, F.array(*[F.lit(x) for x in rows[q][1]]), 4).collect()
        assert {f[1:] for f in found if f[0] == q} == {(r["rank"], r.id, r.distance) for r in one}
    assert len(found) == 40


def test_documents_stay_in_place(spark):
    """The lookup of documents sends the hits to the scan, also where Spark would not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, document string")
        corpus = encode.TRIGRAMS.add_vectors(frame, "id", "document")
        asked = encode.encoded(queries(spark, "alpha"), "query_id", "text")
        found = search.hits(corpus, asked)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
        assert [(r.id, r.document) for r in found.collect()] == [(1, "alpha beta")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("cells", [4_000_000, 64])
def test_sparse_search_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(search, "_CELLS", cells)
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 6))) for _ in range(120)]
    asked = ["alpha beta", "omega", "kappa sigma delta"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    corpus_frame = encode.encoded(frame, "id", "text").repartition(3)
    query_frame = encode.encoded(queries(spark, *asked), "query_id", "text")
    found = {(r.query_id, r.rank, r.id) for r in search.nearest(corpus_frame, query_frame, 10, 1.3).collect()}

    def dense(text):
        v = np.zeros(encode.BUCKETS)
        for b, w in by_hand(text).items():
            v[b] = w
        return v

    rows = [(i, dense(t)) for i, t in enumerate(texts)]
    assert found == brute(rows, [(q, dense(t)) for q, t in enumerate(asked)], 10, 1.3)


def test_approximate_search_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    query = rows.where("id = 0").first()["embedding"]
    exact = {r.id for r in search.nearest_to(rows, F.array(*[F.lit(x) for x in query]), 10).collect()}
    close = {r.id for r in search.approximate_nearest(rows, query, 10, tables=16, bucket_length=2.0).collect()}
    assert len(exact & close) >= 8


def test_approximate_query_as_registered(spark):
    """Every probe has its rows, and at least nine of ten are the exact ones."""
    approximate, exact = (
        {(r.query_id, r.id): r.distance for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
        for name in ("knn_lsh", "knn_batch")
    )
    per_query = Counter(q for q, _ in approximate)
    assert set(per_query) == {q for q, _ in exact if q % 20 == 0} and set(per_query.values()) == {50}
    wanted = {pair for pair in exact if pair[0] % 20 == 0}
    assert len(wanted & approximate.keys()) >= 0.9 * len(wanted)
    assert all(approximate[pair] == exact[pair] for pair in wanted & approximate.keys())


def test_approximate_search_completes_queries(spark):
    """Buckets too narrow to hold k rows."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 6)))]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = frame.where("id < 5").withColumnRenamed("id", "query_id")
    found = search.approximately_nearest(frame, asked, 10, tables=1, bucket_length=1e-6)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in search.nearest(frame, asked, 10).collect()}


def test_model_encoder(spark):
    class StubModel:
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    frame = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    rows = frame.select(encode.model_encoder(StubModel)(F.col("text")).alias("v")).collect()
    assert sorted(r.v for r in rows) == [[2.0, 1.0], [4.0, 1.0]]


def test_index_and_ask_with_a_model(spark, tmp_path):
    class LengthModel:
        def encode(self, texts):
            return [[1.0, 0.0] if "tax" in t else [0.0, 1.0] for t in texts]

    stub = encode.Encoder("stub", LengthModel)
    files = spark.createDataFrame([("a.py", "tax = 1\n\ndef other():\n    pass\n")], "path string, text string")
    collection = Collection(spark, str(tmp_path), "c")
    index_files(files, collection, encoder=stub)
    found = ask(collection.rows(), queries(spark, "about tax"), encoder=stub).collect()
    assert [(r.id, r.distance) for r in found] == [("a.py_tax_1", 0.0)]
    with pytest.raises(search.EncoderMismatch):
        ask(collection.rows(), queries(spark, "about tax"))


def test_refresh_only_reads_changed_files(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("A = 1\n")
    (root / "b.py").write_text("B = 1\n")
    store = str(tmp_path / "store")
    assert refresh_directory(spark, str(root), store).count() == 2
    (root / "b.py").write_text("\nB = 2\n")
    collection = refresh_directory(spark, str(root), store)
    ids = lambda rows: sorted(r.id.split("/")[-1] for r in rows.collect())
    assert ids(spark.read.parquet(f"{collection.path}/delta/batch_seq=1")) == ["b.py_B_2"]
    assert ids(collection.rows()) == ["a.py_A_1", "b.py_B_1", "b.py_B_2"]  # moved declarations stay
    refresh_directory(spark, str(root), store)
    assert spark.read.parquet(f"{collection.path}/delta/batch_seq=2").count() == 0


def test_directory_to_answer(spark, tmp_path):
    root = tmp_path / "src"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("def validate_token(token):\n    return token\n")
    (root / "tax.py").write_text("def calculate_tax(income):\n    return income * 2\n")
    (root / "notes.txt").write_text("def calculate_tax(): pass")
    collection = index_directory(spark, str(root), str(tmp_path / "store"))
    found = ask(collection.rows(), queries(spark, "calculate taxes", "token validation"), shown=1).collect()
    assert {r.query_id: r.id for r in found} == {
        0: f"{root}/tax.py_calculate_tax_1",
        1: f"{root}/pkg/__init__.py_validate_token_1",
    }
