"""State that ends by the clock, and a log that has each entry once."""

import time

import pytest
from pyspark.sql import functions as F

from dossier.streaming import activity, incremental, threads

MESSAGE = "t long, message string, kind string, affiliation string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_state_expires_without_a_message(spark, tmp_path):
    """Ids of messages, what was learnt and silent threads end by time: another thread's messages, or none, are enough."""
    put(spark, tmp_path / "in", [(1, "a", "sent", "MIT"), (1, "a", "sent", None), (1, "b", "sent", None), (2, "x", "reply", None)], MESSAGE)
    source = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
    states = threads.thread_log(source, "t", silence=15000, response_life=2500, affiliation_life=2500)
    seen = []
    q = states.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    wait = lambda on: [time.sleep(0.2) for _ in range(300) if not on()]
    try:
        wait(lambda: len(seen) >= 2)
        assert sorted(seen) == [(1, 2, 0, 1, "MIT", "open"), (2, 0, 1, 0, None, "replied")]
        time.sleep(3)
        put(spark, tmp_path / "in", [(1, "a", "sent", None)], MESSAGE)
        wait(lambda: len(seen) >= 5)
        # the life of the first message's id is over, and the affiliation's with it; then each thread is closed by its timer
        assert sorted(seen[2:], key=str) == [(1, 3, 0, 1, None, "closed"), (1, 3, 0, 1, None, "exhausted"), (2, 0, 1, 0, None, "replied")]
    finally:
        q.stop()


def test_each_entry_once_after_a_loss(spark, tmp_path):
    put(spark, tmp_path / "in", [(1,), (2,)], "k long")
    put(spark, tmp_path / "in", [(3,)], "k long")
    source = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log, progress = str(tmp_path / "log"), str(tmp_path / "progress")

    def lost(rows, number):
        rows.write.mode("overwrite").parquet(f"{log}/batch={number}")
        if number:
            raise RuntimeError("lost between the write and its commit")

    with pytest.raises(Exception, match="lost between"):
        source.writeStream.foreachBatch(lost).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    put(spark, tmp_path / "in", [(4,)], "k long")
    activity.appended(source, log, progress)
    activity.appended(source, log, progress)
    assert sorted(r.k for r in activity.log(spark, log).collect()) == [1, 2, 3, 4]


def test_rollup_leaves_late_rows_out(spark, tmp_path):
    schema = "run int, at timestamp, outcome string, source string"
    ts = lambda x: F.to_timestamp(F.lit(x))  # noqa: E731, F841
    for part in ([(1, "2024-01-01 10:00:00", "created", "a"), (1, "2024-01-01 10:00:05", "error", "b"), (2, "2024-01-01 10:00:00", "duplicate", "a")], [(3, "2024-01-05 00:00:00", None, "a")], [(1, "2024-01-01 12:00:00", "created", "a"), (3, "2024-01-05 01:00:00", "created", "a")]):
        spark.createDataFrame(part, "run int, at string, outcome string, source string").withColumn("at", F.to_timestamp("at")).select("run", "at", "outcome", "source").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        counts = activity.run_counts(source, ["run"], "at", "outcome", "source", late="1 day")
        activity.appended(activity.run_entries(counts, ["run"]), str(tmp_path / "log"), str(tmp_path / "progress"), "update")
    got = {r.run: (r.severity, r.message, r.sources_run, r.duration_ms) for r in activity.last_runs(spark, str(tmp_path / "log"), ["run"]).collect()}
    assert got == {
        1: ("warning", "Discovery run complete — 1 new leads from 1 candidates (0 duplicates skipped), 1 source errors", 2, 5000), 2: ("info", "Discovery run complete — 0 new leads from 1 candidates (1 duplicates skipped)", 1, 0),
        3: ("info", "Discovery run complete — 1 new leads from 2 candidates (0 duplicates skipped)", 1, 3600000),
    }


def test_versions_are_compacted(spark, tmp_path):
    out = tmp_path / "out"
    for n in range(5):
        put(spark, tmp_path / "in", [(k, n, f"v{n}") for k in range(0, 40, n + 1)], "k int, seq int, v string")
        incremental.upsert_stream(spark.readStream.schema("k int, seq int, v string").parquet(str(tmp_path / "in")), "k", "seq", str(out), str(tmp_path / "c"), 4)
    want = {k: f"v{max(n for n in range(5) if k % (n + 1) == 0)}" for k in range(40)}
    assert {r.k: r.v for r in incremental.current(spark, str(out)).collect()} == want
    assert sorted(p.name for p in (out / "manifest").iterdir() if not p.name.startswith(".")) == ["version=3", "version=4"]
    named = {v for m in (None, 4) for v in incremental.manifest(spark, str(out), m).values()}
    assert {int(p.name[8:]) for p in out.iterdir() if p.name.startswith("version=")} == named and len(named) <= 3
