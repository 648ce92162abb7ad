"""Incremental runs: only new or changed material is worked on again, follow-up states live between runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed(rows: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose key is new or whose digest differs from the known one."""
    return rows.join(known.select(key, digest), [key, digest], "left_anti")


def within(df: DataFrame, at: str, as_of, hours: int) -> DataFrame:
    """Entries of a cache that are still good."""
    return df.where(F.col(at) > F.lit(as_of) - F.expr(f"interval {hours} hours"))


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests of a table, the newest last."""
    fs, at = _files(spark, f"{folder}/manifest")
    return sorted(int(x.getPath().getName().partition("=")[2]) for x in (fs.listStatus(at) if fs.exists(at) else []) if x.getPath().getName().startswith("version="))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket (as many rows as buckets) in the newest manifest, or the newest before one."""
    known = [n for n in _manifests(spark, folder) if before is None or n < before]
    return {r.bucket: r.version for r in spark.read.parquet(f"{folder}/manifest/version={known[-1]}").collect()} if known else {}


def current(spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a table that upsert_stream keeps, with the column bucket: the files that its newest manifest (older than `before`) names, or those of some buckets. None if there are none."""
    paths = [f"{folder}/version={v}/bucket={b}" for b, v in manifest(spark, folder, before).items() if buckets is None or b in buckets]
    return spark.read.option("basePath", folder).parquet(*paths).drop("version") if paths else None


def upsert_stream(source: DataFrame, key: str, seq: str, folder: str, checkpoint: str, buckets: int = 64) -> None:
    """Streams rows into a table of one row a key, the latest by seq; of rows with one seq the larger one within a batch, the later batch's otherwise.

    Keys fall into buckets by their hash. Batch N writes folder/version=N with the buckets that it touches and no others, then a manifest of the version of each bucket. A
    batch reads the touched buckets alone, by the manifest before its own, so its cost doesn't grow with the number of versions, and a repeated batch gives the same. Files that neither the
    newest manifest nor the one before names are removed then. Choose buckets so that one is a task's work; `current` reads the table."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        new = rows.select("*", bucket, F.lit(1).alias("__new"))
        touched = [r.bucket for r in rows.select(bucket).distinct().collect()]
        had = manifest(spark, folder, number)
        old = current(spark, folder, number, touched)
        if old is not None:
            new = new.unionByName(old.select(*rows.columns, "bucket", F.lit(0).alias("__new")))
        latest = new.groupBy("bucket", key).agg(F.max(F.struct(F.col(seq).alias("s"), "__new", F.struct(*rows.columns).alias("row"))).alias("x")).select("bucket", "x.row.*")
        latest.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/version={number}")
        now = had | dict.fromkeys(touched, number)
        if now:
            spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")
        _compact(spark, folder, had, now, number)

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _compact(spark: SparkSession, folder: str, had: dict[int, int], now: dict[int, int], number: int) -> None:
    """Removes what neither manifest names: buckets of older versions, and older manifests."""
    kept = {(v, b) for m in (had, now) for b, v in m.items()}
    fs, at = _files(spark, folder)
    for version in fs.listStatus(at):
        name = version.getPath().getName()
        if not name.startswith("version=") or int(name[8:]) >= number:
            continue
        own = [b for b in fs.listStatus(version.getPath()) if b.getPath().getName().startswith("bucket=")]
        gone = [b for b in own if (int(name[8:]), int(b.getPath().getName()[7:])) not in kept]
        for b in gone:
            fs.delete(b.getPath(), True)
        if len(gone) == len(own):
            fs.delete(version.getPath(), True)
    for old in _manifests(spark, folder)[:-2]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/version={old}"), True)


STATE = "attempts int, replied boolean, last_at timestamp"


def thread_states(events: DataFrame, thread: str, at: str, kind: str, most: int = 3, forget_after: str | None = None) -> DataFrame:
    """Streams messages of threads into thread, attempts, status: open until a reply comes or the attempts are used up.

    forget_after (an interval such as "30 days"): a thread without a message for so long, by the time of the messages, is forgotten; without it states stay."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts, replied, last = state.get if state.exists else (0, False, None)
        for pdf in batches:
            attempts += int((pdf[kind] == "sent").sum())
            replied = replied or bool((pdf[kind] == "reply").any())
            last = max([x for x in (last, pdf[at].max()) if x is not None])
        state.update((attempts, replied, last))
        if forget_after:
            state.setTimeoutTimestamp(int((pd.Timestamp(last) + pd.Timedelta(forget_after)).timestamp() * 1000))
        yield pd.DataFrame({thread: [key[0]], "attempts": [attempts], "status": ["replied" if replied else "exhausted" if attempts >= most else "open"]})

    rows = events.withWatermark(at, forget_after) if forget_after else events
    return rows.groupBy(thread).applyInPandasWithState(step, f"{thread} long, attempts int, status string", STATE, "update", GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout)
