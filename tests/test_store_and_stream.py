import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import encode, requests, store
from codeloom.operators.store import Collection, CollectionNotFound, LayoutMismatch
from codeloom.sources.requests import read_requests, stream_requests
from codeloom.plans.index import index_files
from codeloom.streaming import index_stream


def chunk(name, content, **extra):
    return {"id": name, "content": content, "metadata": {"file_path": "/" + name}, **extra}


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id string, document string, position int")


def test_upsert_add_compact_replay_drop(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "things")
    with pytest.raises(CollectionNotFound):
        c.get()
    c.drop()
    assert c.get_or_create("about things").get_or_create().exists() and c.count() == 0
    first = rows_of(spark, [("a", "1", 0), ("b", "1", 0), ("a", "2", 1)])
    assert c.upsert(first) == 0
    content = lambda: {r.id: r.document for r in c.rows().collect()}
    assert content() == {"a": "2", "b": "1"}
    assert c.upsert(rows_of(spark, [("b", "3", 0), ("c", "3", 0)]), ("w", 0)) == 1
    assert c.upsert(rows_of(spark, [("b", "3", 0), ("c", "3", 0)]), ("w", 0)) == 1  # the same batch again
    assert content() == {"a": "2", "b": "3", "c": "3"}
    c.compact()
    assert content() == {"a": "2", "b": "3", "c": "3"} and c.last_seq() == 1
    assert c.upsert(first, ("w", 0)) == 1  # a replay from before the compaction changes nothing
    assert content() == {"a": "2", "b": "3", "c": "3"}
    c.add(rows_of(spark, [("a", "9", 0), ("d", "9", 0)]))
    assert content() == {"a": "2", "b": "3", "c": "3", "d": "9"} and c.count() == 4
    c.compact()
    assert c.count() == 4
    c.drop()
    assert not c.exists()


def test_upsert_of_a_hot_key_keeps_the_last(spark):
    hot = spark.range(30000).select(F.lit("hot").alias("id"), F.col("id").cast("string").alias("document"), F.col("id").alias("position"))
    cold = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("document"), F.lit(0).alias("position"))
    newest = store.latest(hot.union(cold), order=("position",))
    assert newest.count() == 1001
    assert newest.where("id = 'hot'").first()["document"] == "29999"


GOOD = {"meta": {"id": "r1"}, "chunks": [chunk("a", "x", type="function"), {"id": "b", "content": "y"}]}
CASES = [
    (json.dumps(GOOD), "r1", "success", None, 2),
    (json.dumps({"chunks": [chunk("a", "x")]}), None, "success", None, 1),
    ("{bad", None, "error", "Invalid JSON", None),
    (json.dumps({"meta": {"id": "r2"}, "chunks": []}), "r2", "error", "No chunks provided", None),
    (json.dumps({"meta": {"id": "r3"}}), "r3", "error", "No chunks provided", None),
    (json.dumps({"meta": {"id": "r4"}, "chunks": None}), "r4", "error", "No chunks provided", None),
    (json.dumps({"meta": {"id": "r4"}, "chunks": {}}), "r4", "error", "No chunks provided", None),
    (json.dumps({"meta": None, "chunks": [chunk("a", "x")]}), None, "error", "'NoneType' object has no attribute 'get'", None),
    ("[1]", None, "error", "'list' object has no attribute 'get'", None),
    ("5", None, "error", "'int' object has no attribute 'get'", None),
    (json.dumps({"meta": {"id": "r5"}, "chunks": [chunk("a", "x"), {"content": "y"}]}), "r5", "error", "'id'", None),
    (json.dumps({"meta": {"id": "r6"}, "chunks": [{"id": "y"}, chunk("a", "x")]}), "r6", "error", "'content'", None),
    (json.dumps({"meta": {"id": "r7"}, "chunks": [chunk("a", "x"), chunk("a", "z")]}), "r7", "error", "duplicate ids", None),
    (json.dumps({"meta": {"id": "r8"}, "chunks": "abc"}), "r8", "error", "chunks is not a list", None),
]


def test_latest_of_ties_does_not_depend_on_the_order_of_rows(spark):
    rows = [("a", f"text {i}", 1) for i in range(40)]
    schema = "id string, document string, position int"
    found = {
        store.latest(spark.createDataFrame(given, schema).repartition(n), order=("position",)).first().document
        for given in (rows, rows[::-1])
        for n in (1, 3, 7)
    }
    assert len(found) == 1


def test_request_cases(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "n int, value string")
    found = requests.acks(requests.parsed(frame)).orderBy("n").collect()
    for row, (value, given, status, message, count) in zip(found, CASES):
        assert (row.status, row.indexed_count) == (status, count), value
        assert (row.message or "").startswith(message or ""), value
        assert row.id == given if given else len(row.id) == 64, value


def test_session_ends(spark):
    texts = [("s1", "a\nb\n"), ("s2", "a\n exit \nb\n"), ("s3", "\nb"), ("s4", "a\n\t\nb"), ("s5", " a \r\nb")]
    lines = requests.session_lines(spark.createDataFrame(texts, "session string, text string")).collect()
    assert {(r.session, r.line_no, r.value) for r in lines} == {
        ("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "a"), ("s4", 0, "a"), ("s5", 0, "a"), ("s5", 1, "b"),
    }


def test_request_lines_leave_out_empty_names(spark):
    row = ("f.py_x_1", "x = 1", "f.py", "x", "", 1, 1, "python", "variables")
    names = "id string, content string, file_path string, function_name string, class_name string, start_line int, end_line int, language string, chunk_type string"
    sent = requests.request_lines(spark.createDataFrame([row], names)).first()
    parsed = json.loads(sent.value)
    assert parsed == {
        "chunks": [
            {
                "id": "f.py_x_1",
                "content": "x = 1",
                "metadata": {"file_path": "f.py", "function_name": "x", "start_line": 1, "end_line": 1, "language": "python", "chunk_type": "variables"},
            }
        ]
    }


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(json.dumps(line) if not isinstance(line, str) else line for line in lines) + "\n")
    return path


def test_stream_indexes_acknowledges_and_restarts(spark, tmp_path):
    inbox, acks = tmp_path / "in", str(tmp_path / "acks")
    collection = Collection(spark, str(tmp_path / "store"), index_stream.COLLECTION)

    def run():
        query = index_stream.start(
            stream_requests(spark, str(inbox), 1), collection, str(tmp_path / "checkpoint"), acks, available_now=True
        )
        query.awaitTermination()

    one = write(inbox, "one.jsonl", [
        {"meta": {"id": "q1"}, "chunks": [chunk("a", "first function"), chunk("b", "second function")]},
        "{broken",
        {"meta": {"id": "q2"}, "chunks": [chunk("a", "first function again")]},
        "exit",
        {"meta": {"id": "never"}, "chunks": [chunk("z", "z")]},
    ])
    os.utime(one, (1000, 1000))
    run()
    content = lambda: {r.id: r.document for r in collection.rows().collect()}
    assert content() == {"a": "first function again", "b": "second function"}
    write(inbox, "two.jsonl", [{"meta": {"id": "q3"}, "chunks": [chunk("b", "replaced"), chunk("c", "new")]}])
    run()
    run()
    assert content() == {"a": "first function again", "b": "replaced", "c": "new"}
    given = {(r.id, r.status, r.indexed_count) for r in spark.read.parquet(acks).collect() if len(r.id) < 64}
    assert given == {("q1", "success", 2), ("q2", "success", 1), ("q3", "success", 2)}
    assert spark.read.parquet(acks).where("status = 'error'").count() == 1
    stored = collection.rows()
    assert {r.encoder for r in stored.collect()} == {encode.BUILT_IN} and stored.where("vector is null").count() == 0

    # The same bounded batch again leaves the same state: same segment, same acknowledgements.
    index_stream.index_batch(read_requests(spark, str(inbox / "two.jsonl")), collection, ("own", 1), acks)
    before = collection.last_seq()
    index_stream.index_batch(read_requests(spark, str(inbox / "two.jsonl")), collection, ("own", 1), acks)
    assert collection.last_seq() == before and content()["b"] == "replaced"
    assert spark.read.parquet(acks).count() == 5

    # Another writer between two runs of the stream, with and without a compaction, takes nothing from either.
    code = spark.createDataFrame([("a.py", bytearray(b"def tax(x):\n    return x\n"))], "path string, content binary")
    index_files(code, collection)
    write(inbox, "three.jsonl", [{"meta": {"id": "q4"}, "chunks": [chunk("s4", "four")]}])
    run()
    assert set(content()) == {"a", "b", "c", "a.py_tax_1", "s4"}
    collection.compact()
    write(inbox, "four.jsonl", [{"meta": {"id": "q5"}, "chunks": [chunk("s5", "five")]}])
    run()
    assert set(content()) == {"a", "b", "c", "a.py_tax_1", "s4", "s5"}
    with pytest.raises(LayoutMismatch):
        collection.upsert(collection.rows().drop("batch_seq").withColumn("position", F.lit(0)))


def test_an_unfinished_batch_that_a_compaction_passed_by_is_written(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "things").get_or_create()
    c.upsert(rows_of(spark, [("a", "1", 0)]))
    assert c._claimed("w-7") == (1, False)  # a try that ended before it wrote
    assert c.upsert(rows_of(spark, [("b", "1", 0)])) == 2
    c.compact()
    assert c.upsert(rows_of(spark, [("c", "1", 0)]), ("w", 7)) == 3
    assert {r.id for r in c.rows().collect()} == {"a", "b", "c"}
