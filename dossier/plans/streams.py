"""Streaming runs over the given tables, read as streams of files, whose ends are the same as a batch's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.queries import query, table
from dossier.session import shared_folder
from dossier.streaming import activity, incremental, threads


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream: its file, or the files of its folder. Spark takes a plain path of a stream for a folder; one with a pattern may be either."""
    own = table(spark, sf_dir, name).schema
    return spark.readStream.schema(own).parquet(f"{sf_dir}/{name}.parque[t]")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def incremental_upsert(spark, sf_dir):
    """The latest event of each user, kept by a stream in buckets of which each batch writes those it touches."""
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    incremental.upsert_stream(rows, "user_id", "seq", f"{folder}/table", f"{folder}/progress", 8)
    return incremental.current(spark, f"{folder}/table").select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN 'sent' WHEN role = 'user' AND turn >= 4 THEN 'reply' ELSE 'other' END AS kind FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (kind = 'sent') AS INTEGER) AS attempts, CASE WHEN bool_or(kind = 'reply') THEN 'replied' WHEN count(*) FILTER (kind = 'sent') >= 3 THEN 'exhausted' ELSE 'open' END AS status FROM e GROUP BY conv_id""")
def thread_state(spark, sf_dir):
    """What a thread has come to, as a stream keeps it: open, replied, or all attempts used up."""
    folder = f"{shared_folder(spark)}/threads-{uuid.uuid4().hex}"
    kind = F.when(F.col("role") == "assistant", "sent").when((F.col("role") == "user") & (F.col("turn") >= 4), "reply").otherwise("other")
    rows = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), kind.alias("kind"), F.timestamp_seconds(F.col("turn").cast("long")).alias("at"))
    states = incremental.thread_states(rows, "conv_id", "at", "kind")

    def batch(now: DataFrame, number: int) -> None:
        now.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).groupBy("conv_id").agg(F.max_by(F.struct("attempts", "status"), "number").alias("x")).select("conv_id", "x.attempts", "x.status")


def _pieces(rows: DataFrame, folder: str, by: str, n: int) -> DataFrame:
    """rows as a stream of n batches, one for each remainder of `by`. A task keeps a file open for each of its remainders, so it sorts nothing and holds no rows."""
    conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    had = conf.get(key)
    conf.set(key, str(n))
    try:
        rows.withColumn("__n", (F.pmod(F.col(by), F.lit(n))).cast("int")).repartition(n, "__n").write.partitionBy("__n").parquet(folder)
    finally:
        conf.set(key, had)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@query("""WITH m AS (SELECT DISTINCT conv_id, turn, role FROM conversations), e AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN 'sent' WHEN role = 'user' AND turn >= 4 THEN 'reply' ELSE 'other' END AS kind FROM m)
SELECT conv_id, CAST(count(*) FILTER (kind = 'sent') AS INTEGER) AS attempts, CAST(count(*) FILTER (kind = 'reply') AS INTEGER) AS replies, CAST(count(*) AS INTEGER) AS repeated,
  CASE WHEN bool_or(kind = 'reply') THEN 'replied' WHEN count(*) FILTER (kind = 'sent') >= 3 THEN 'exhausted' ELSE 'open' END AS status FROM e GROUP BY conv_id""")
def thread_log(spark, sf_dir):
    """Threads after a stream of several batches in which every message is delivered twice: what a message is told again doesn't count again."""
    folder = f"{shared_folder(spark)}/threads-{uuid.uuid4().hex}"
    turn = F.col("turn")
    kind = F.when(F.col("role") == "assistant", "sent").when((F.col("role") == "user") & (turn >= 4), "reply").otherwise("other")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    once = own.select(F.col("conv_id").cast("long").alias("conv_id"), F.concat_ws("/", turn, "role").alias("message"), kind.alias("kind"), F.lit(None).cast("string").alias("affiliation"), turn.cast("long").alias("turn"))
    told = once.unionByName(once.withColumn("turn", turn + 1))
    threads.written(threads.thread_log(_pieces(told, f"{folder}/in", "turn", 3), "conv_id"), f"{folder}/out", f"{folder}/progress")
    return threads.latest(spark, f"{folder}/out", "conv_id").select("conv_id", "attempts", "replies", "repeated", "status")


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'created' WHEN 'signup' THEN 'duplicate' WHEN 'error' THEN 'error' ELSE 'seen' END"


@query(f"""WITH e AS (SELECT user_id, ts, {_OUTCOME} AS o FROM events), r AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) FILTER (o <> 'error') AS candidates_found, count(*) FILTER (o = 'created') AS leads_created, count(*) FILTER (o = 'duplicate') AS duplicates_skipped,
  count(*) FILTER (o = 'error') AS errors, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms FROM e GROUP BY ALL)
SELECT user_id, CAST(CAST(day AS DATE) AS VARCHAR) AS day, CASE WHEN errors > 0 THEN 'warning' ELSE 'info' END AS severity, 'Discovery run complete — ' || leads_created || ' new leads from ' || candidates_found || ' candidates (' || duplicates_skipped || ' duplicates skipped)'
  || CASE WHEN errors > 0 THEN ', ' || errors || ' source errors' ELSE '' END AS message, duration_ms FROM r""")
def run_rollup(spark, sf_dir):
    """One log entry for each run (a user's day) of a stream of three batches, whose rows come late: a warning if it had errors."""
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "purchase", "created").when(F.col("event_type") == "signup", "duplicate").when(F.col("event_type") == "error", "error").otherwise("seen")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("outcome"), F.col("event_type").alias("source"), "event_id")
    counts = activity.run_counts(_pieces(rows, f"{folder}/in", "event_id", 3), ["user_id"], "ts", "outcome", "source", late="3650 days")
    entries = activity.run_entries(counts, ["user_id"]).withColumn("day", F.date_format("started", "yyyy-MM-dd"))
    activity.appended(entries, f"{folder}/log", f"{folder}/progress", "update")
    return activity.last_runs(spark, f"{folder}/log", ["user_id", "day"]).select("user_id", "day", "severity", "message", "duration_ms")


@query("""SELECT 'user_' || event_type AS type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, 'User ' || user_id || CASE WHEN user_id % 3 = 0 THEN '' ELSE ', Inst ' || user_id % 3 END || ': ' || event_type AS message, CAST(user_id AS VARCHAR) AS related_lead_id, event_id FROM events""")
def activity_log(spark, sf_dir):
    """Entries of a stream of four batches in an append-only log, each once, named as the feed shows them."""
    folder, u = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", F.col("user_id")
    rows = _pieces(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), f"{folder}/in", "event_id", 4)
    named = activity.described(F.concat(F.lit("User "), u), F.when(u % 3 != 0, F.concat(F.lit("Inst "), u % 3)))
    out = activity.entries(rows.withColumn("at", F.struct("ts", "event_id")), F.concat(F.lit("user_"), "event_type"), F.concat(named, F.lit(": "), "event_type"), F.col("at"), F.when(F.col("event_type") == "error", "error"), u)
    activity.appended(out, f"{folder}/log", f"{folder}/progress")
    return activity.log(spark, f"{folder}/log").select("type", "severity", "message", "related_lead_id", "at.event_id")
