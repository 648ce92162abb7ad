from pyspark.sql import functions as F

from dossier.streaming import incremental


def test_upsert_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in ([(1, 1, "a"), (2, 2, "b")], [(1, 3, "c"), (3, 4, "d"), (2, 1, "old")]):
        spark.createDataFrame(part, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema("k int, seq int, v string").parquet(folder)
        incremental.upsert_stream(source, "k", "seq", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    last = spark.read.parquet(str(tmp_path / "out" / "version=1"))
    assert sorted(map(tuple, last.select("k", "v").collect())) == [(1, "c"), (2, "b"), (3, "d")]


def test_changed(spark):
    known = spark.createDataFrame([(1, "x"), (2, "y")], "k int, h string")
    rows = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k int, h string")
    assert sorted(r.k for r in incremental.changed(rows, known, "k", "h").collect()) == [2, 3]


def test_thread_states(spark, tmp_path):
    rows = [(1, "sent", "2024-01-01"), (1, "reply", "2024-01-02"), (2, "sent", "2024-01-01"), (2, "sent", "2024-01-02"), (2, "sent", "2024-01-03"), (3, "sent", "2024-01-01")]
    spark.createDataFrame(rows, "t long, kind string, at string").select("t", "kind", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t long, kind string, at timestamp").parquet(str(tmp_path / "in"))
    q = incremental.thread_states(source, "t", "at", "kind").writeStream.outputMode("update").format("memory").queryName("threads").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.t: r.status for r in spark.sql("select * from threads").collect()} == {1: "replied", 2: "exhausted", 3: "open"}


def test_upsert_stream_writes_touched_buckets_only(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(k, 1, f"v{k}") for k in range(40)], [(7, 2, "new"), (8, 0, "old"), (9, 1, "later"), (9, 1, "earlier")]):
        spark.createDataFrame(part, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(folder)
        incremental.upsert_stream(spark.readStream.schema("k int, seq int, v string").parquet(folder), "k", "seq", out, str(tmp_path / "ckpt"), 16)
    table = {r.k: r.v for r in incremental.current(spark, out).collect()}
    assert table == {k: f"v{k}" for k in range(40)} | {7: "new", 9: "later"}
    touched = [p.name for p in (tmp_path / "out" / "version=1").iterdir() if p.name.startswith("bucket=")]
    assert 1 <= len(touched) <= 3


def test_threads_are_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    events = [[(1, "sent", "2024-01-01"), (2, "sent", "2024-01-01")], [(2, "sent", "2024-03-01")], [(3, "sent", "2024-03-02")], [(1, "sent", "2024-03-03"), (2, "sent", "2024-03-03")]]
    got = {}
    for rows in events:
        spark.createDataFrame(rows, "t long, kind string, at string").select("t", "kind", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema("t long, kind string, at timestamp").parquet(str(folder))
        states = incremental.thread_states(source, "t", "at", "kind", forget_after="10 days")
        states.writeStream.outputMode("update").foreachBatch(lambda df, n: got.update({r.t: r.attempts for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert got == {1: 1, 2: 3, 3: 1}  # the first thread's one attempt of January is forgotten in March
