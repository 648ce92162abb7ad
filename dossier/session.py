"""Sessions with the settings that results and plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **more: str) -> SparkSession:
    """UTC, adaptive plans with skew joins, checkpoints that go when nothing refers to them. A cluster's own settings win; master is for tests."""
    builder = SparkSession.builder.appName("dossier")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"} | more
    for k, v in settings.items():
        builder = builder.config(k, v)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))  # one process, as in tests: its own folder
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: steps that read it several times don't repeat what is above it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is not to be broadcast. Spark guesses a size from that of the files, so it takes exploded lists and counts of what is packed tightly for small."""
    return df.hint("merge")
