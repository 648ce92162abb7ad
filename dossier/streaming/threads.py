"""Follow-up threads as a stream keeps them: counted attempts, messages that are told twice, what was last learnt of a person, and the closing of silent threads by a timer.

State has its own lives: the ids of messages are known for a day, so a message that is delivered again doesn't count again; an affiliation is good for thirty days; a
thread without a message for long is closed by a timer, without a message that does it. Times to live and timers go by the clock of the machines that run the stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds that ids of messages and affiliations are remembered, and that a thread may be silent.
DAY = 86_400_000
RESPONSE_LIFE, AFFILIATION_LIFE, SILENCE = DAY, 30 * DAY, 30 * DAY
#: Attempts after which a thread is exhausted.
MOST = 3
STATUS = "attempts int, replies int, repeated int, affiliation string, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Threads(StatefulProcessor):
    """Messages (message, kind: sent, reply or anything else, affiliation or null) of one thread to its status: open, replied, exhausted or closed."""

    def __init__(self, thread: str, most: int = MOST, silence: int = SILENCE, response_life: int = RESPONSE_LIFE, affiliation_life: int = AFFILIATION_LIFE):
        self.thread, self.most, self.silence, self.response_life, self.affiliation_life = thread, most, silence, response_life, affiliation_life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "attempts int, replies int, repeated int, deadline long")
        self.known = handle.getMapState("known", "message string", "kind string", ttlDurationMs=self.response_life)
        self.affiliation = handle.getValueState("affiliation", "name string", ttlDurationMs=self.affiliation_life)

    def _row(self, key: tuple, attempts: int, replies: int, repeated: int, closed: bool = False) -> pd.DataFrame:
        at = self.affiliation.get()[0] if self.affiliation.exists() else None
        status = "closed" if closed else "replied" if replies else "exhausted" if attempts >= self.most else "open"
        return pd.DataFrame({self.thread: [key[0]], "attempts": [attempts], "replies": [replies], "repeated": [repeated], "affiliation": pd.Series([at], dtype=object), "status": [status]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, replies, repeated, deadline = self.counts.get() if self.counts.exists() else (0, 0, 0, None)
        for frame in rows:
            for message, kind, affiliation in frame[["message", "kind", "affiliation"]].itertuples(index=False):
                if self.known.containsKey((message,)):
                    repeated += 1
                    continue
                self.known.updateValue((message,), (kind,))
                attempts, replies = attempts + (kind == "sent"), replies + (kind == "reply")
                if affiliation is not None and affiliation == affiliation:
                    self.affiliation.update((affiliation,))
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        deadline = timerValues.getCurrentProcessingTimeInMs() + self.silence
        self.handle.registerTimer(deadline)
        self.counts.update((attempts, replies, repeated, deadline))
        yield self._row(key, attempts, replies, repeated)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, replies, repeated, deadline = self.counts.get() if self.counts.exists() else (0, 0, 0, None)
        if deadline == expiredTimerInfo.getExpiryTimeInMs():
            row = self._row(key, attempts, replies, repeated, closed=not replies)
            for state in (self.counts, self.known, self.affiliation):
                state.clear()
            yield row

    def close(self) -> None:
        pass


def thread_log(messages: DataFrame, thread: str, kind_of_thread: str = "long", **lives: int) -> DataFrame:
    """A stream of messages (thread, message, kind, affiliation) to its threads' STATUS after each batch; lives: the arguments of Threads. State lies in RocksDB, so it may be larger than memory."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = messages.select(thread, "message", "kind", "affiliation")
    return rows.groupBy(thread).transformWithStateInPandas(Threads(thread, **lives), f"{thread} {kind_of_thread}, {STATUS}", "Update", "ProcessingTime")


def written(states: DataFrame, folder: str, checkpoint: str) -> None:
    """Each batch of states to folder/batch=N, a repeated one in its own place, until nothing new is there.

    A stream with timers always asks for one more batch, for a timer might be due, and would never be through; so here timers are looked at with new messages only. A stream that
    goes on (trigger by processing time) looks at them between messages, too."""

    def batch(now: DataFrame, number: int) -> None:
        now.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conf, key = states.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    had = conf.get(key)
    conf.set(key, "false")
    try:
        states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, had)


def latest(spark: SparkSession, folder: str, thread: str) -> DataFrame:
    """Of each thread what the last batch said that named it."""
    rows = spark.read.parquet(folder)
    fields = [c for c in rows.columns if c not in (thread, "batch")]
    return rows.groupBy(thread).agg(F.max_by(F.struct(*fields), "batch").alias("x")).select(thread, "x.*")
