"""What the operators of this package share: session settings, checkpoints in the shared folder, global positions, labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import shared_folder

#: Rows and bytes of one Arrow batch: a worker holds a batch, not a partition.
BATCH_ROWS, BATCH_BYTES = "4096", str(4 << 20)
#: Ids up to so many are broadcast (16 MB at most); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches and makes sure of a checkpoint folder that all executors share."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared_folder(spark)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: its lineage ends there, and no executor's loss repeats the work above it."""
    prepare(df.sparkSession)
    return df.checkpoint()


def cut_small(df: DataFrame) -> DataFrame:
    """cut for what is small beside the texts, such as ids and links: as few files as the advised partition size asks for, not one for each core. Many small files
    cost more than what is in them, and each one starts a process where files get their rights by a command."""
    spark, key = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    had = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return cut(df)
    finally:
        spark.conf.set(key, had)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def frugal(run):
    """A function over Arrow batches that gives its worker's freed memory back to the system at its end: workers live on from stage to stage."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()  # Arrow keeps freed batches in a pool of its own
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a folder of intermediate files."""
    jvm, sc = spark._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text ended by a newline (null: empty), and more columns: texts then stand apart in an Arrow buffer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n")).alias("text"), *more)


def remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def only_ids(docs: DataFrame, ids: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose doc_id is in ids (one column, distinct, cut). Few ids are broadcast, many joined by a shuffle."""
    few = ids.count() <= broadcast_ids
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """doc_id, text, label of at most bound learning rows of each class, the first by a hash of the id. learn: of a doc_id column."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    some = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")


def positions(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df range-partitioned and sorted by order, with part and pos (place in its part), cut; and n, the rows of each part, in the order of parts.

    A hot key is no hot partition as long as order ends in something that tells its rows apart."""
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = cut(out.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    return out, out.groupBy("part").agg(F.count("*").alias("n"))


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with rank (from 0, in the order), and the number of its rows. Only one number of each part comes to the driver."""
    out, sizes = positions(df, order)
    before, total = {}, 0
    for r in sorted(sizes.collect()):
        before[r.part], total = total, total + r.n
    start = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    return out.join(F.broadcast(start), "part").withColumn("rank", F.col("before") + F.col("pos")).drop("part", "pos", "before"), total
