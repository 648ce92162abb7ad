"""The activity log: entries that are appended exactly once, and one entry for a whole run instead of one for each of its leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry of the log.
ENTRY = ["type", "severity", "message", "related_lead_id", "at"]
RUN = "discovery_run_completed"


def described(name: Column, institution: Column) -> Column:
    """How a lead is named in the feed."""
    return F.concat_ws(", ", name, F.nullif(institution, F.lit("")))


def entries(rows: DataFrame, type_: Column, message: Column, at: Column, severity: Column | None = None, lead: Column | None = None) -> DataFrame:
    """ENTRY of each row. The text is made now, with the names in it, so a feed needs no lookups; a row without a text is no entry."""
    severity = F.coalesce(severity, F.lit("info")) if severity is not None else F.lit("info")
    lead = lead.cast("string") if lead is not None else F.lit(None).cast("string")
    return rows.select(type_.alias("type"), severity.alias("severity"), message.alias("message"), lead.alias("related_lead_id"), at.alias("at")).where("message is not null")


def appended(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Appends a stream to the log in folder/batch=N until nothing new is there. A batch that is run again after a loss replaces itself, so each entry is there once."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch")


#: Settings of the state of runs: on disk, and what RocksDB holds in memory bounded for all stores of an executor together.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
#: What a run comes to.
COUNTS = ["sources_run", "candidates_found", "leads_created", "duplicates_skipped", "errors"]


def run_counts(rows: DataFrame, run: list[str], at: str, outcome: str, source: str, late: str | None = None, window: str = "1 day") -> DataFrame:
    """COUNTS of each run and window of time, with started, finished and duration_ms. outcome: created, duplicate, error or anything else; errors are no candidates.

    late: how long after the newest row a row of a stream may still come; older ones are left out, and their state is given back. The state of a stream lies in RocksDB, with a bound on
    its memory, and holds of each run the distinct names of its sources, which are few: a sketch of them would take 13 kB a run."""
    rows = rows.withWatermark(at, late) if late else rows
    kind = F.col(outcome)
    if rows.isStreaming:
        for key, value in STATE.items():
            rows.sparkSession.conf.set(key, value)
    sources = F.size(F.collect_set(source)).cast("long") if rows.isStreaming else F.count_distinct(source)
    out = rows.groupBy(*run, F.window(at, window)).agg(
        sources.alias("sources_run"), F.count_if(F.coalesce(kind != "error", F.lit(True))).alias("candidates_found"), F.count_if(kind == "created").alias("leads_created"), F.count_if(kind == "duplicate").alias("duplicates_skipped"),
        F.count_if(kind == "error").alias("errors"), F.min(at).alias("started"), F.max(at).alias("finished"),
    )
    return out.withColumn("duration_ms", F.expr("(unix_micros(finished) - unix_micros(started)) div 1000")).drop("window")


def run_entries(counts: DataFrame, run: list[str]) -> DataFrame:
    """One entry a run, a warning if it had errors; the counts stay beside it."""
    c = F.col
    text = F.concat(F.lit("Discovery run complete — "), c("leads_created"), F.lit(" new leads from "), c("candidates_found"), F.lit(" candidates ("), c("duplicates_skipped"), F.lit(" duplicates skipped)"))
    failed = c("errors") > 0
    text = F.when(failed, F.concat(text, F.lit(", "), c("errors"), F.lit(" source errors"))).otherwise(text)
    return counts.select(*run, F.lit(RUN).alias("type"), F.when(failed, "warning").otherwise("info").alias("severity"), text.alias("message"), *COUNTS, "started", "finished", "duration_ms")


def last_runs(spark: SparkSession, folder: str, key: list[str]) -> DataFrame:
    """The newest entry of each run from a log of updates: a run that went on in a later batch has several."""
    rows = spark.read.parquet(folder)
    fields = [x for x in rows.columns if x not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("x")).select(*key, "x.*")
