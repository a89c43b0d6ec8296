"""Keyed streaming state: only changed keys are written."""

from pyspark.sql import functions as F

from codeloom.streaming import changes


def run(spark, folder, rows, sent):
    frame = spark.createDataFrame(rows, "k long, role string, text string").withColumn("sent", F.lit(sent))
    frame.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
    found = changes.changed(stream, ["k"], changes.row_digest("role", "text"))
    query = (
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start(f"{folder}/out")
    )
    query.awaitTermination()
    return sorted(((r.k, r.role, r.text) for r in spark.read.parquet(f"{folder}/out").where(F.col("sent") == sent).collect()), key=repr)


def test_replays_write_nothing_and_edits_their_keys(spark, tmp_path):
    rows = [(1, "user", "hi"), (2, "narrator", ""), (2, "user", "same"), (2, "user", "same"), (None, "x", None), (3, None, None)]
    first = run(spark, tmp_path, rows, 1)
    assert first == sorted([(1, "user", "hi"), (2, "narrator", ""), (2, "user", "same"), (None, "x", None), (3, None, None)], key=repr)
    assert run(spark, tmp_path, rows[::-1], 2) == []
    edited = [(1, "user", "hi!"), *rows[1:]]
    assert run(spark, tmp_path, edited, 3) == [(1, "user", "hi!")]
    assert run(spark, tmp_path, [(2, "user", "same")], 4) == [(2, "user", "same")]  # the key now holds less


def test_keys_share_calls_to_the_state(spark, tmp_path, monkeypatch):
    """Far fewer groups than keys; whole numbers beside a null stay exact, keys of one bucket stay apart."""
    monkeypatch.setattr(changes, "BUCKETS", 2)
    big = 2**53 + 1
    rows = [(k, "user", f"text {k}") for k in (*range(40), big, None)]
    stream = spark.readStream.schema("k long, role string, text string").parquet(str(tmp_path))
    plan = changes.changed(stream, ["k"], changes.row_digest("role", "text"))._jdf.queryExecution().analyzed().toString()
    assert "changes_bucket" in plan.partition("TransformWithState")[2].partition("\n")[0]
    assert run(spark, tmp_path, rows, 1) == sorted(rows, key=repr)
    assert run(spark, tmp_path, rows, 2) == []
    edited = [(big, "user", "again"), *[r for r in rows if r[0] != big]]
    assert run(spark, tmp_path, edited, 3) == [(big, "user", "again")]
