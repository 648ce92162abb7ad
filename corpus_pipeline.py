"""A training corpus from raw documents: toxic and poor ones go, one of each group of near copies stays, and the rest is packed into sequences.

Each stage takes all rows that the one before has kept, written as Parquet and read again. Rows are told apart by doc_id and text, so each row goes by its own
verdict: of an id with several texts only those that are judged so, and rows without an id like any other. Nulls and empty texts have no words, so the quality
rules reject them. A row that is repeated with its id is one document and stays as often as it came; rows without an id are in no group of near copies. Ties have
no part in a verdict; of a group the smallest id stays. Texts may be of any length, other columns than those of documents are dropped, and empty tables give an
empty one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import minhash, packing, quality_rules, queries, toxicity
from dossier.llm.common import BROADCAST_IDS, cut_small, remove, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: shared shingles of so many words, in percent of all that either text has.
SHINGLE, PERCENT = 5, 80


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def _drop(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs (keyed) without the rows whose doc_id and text key the verdict names. These are cut first, so their number is known: few are broadcast, many joined by a shuffle."""
    named = cut_small(verdict.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct())
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    return docs.join(named, docs.doc_id.cast("long").eqNullSafe(F.col("id")) & (docs.text_key == F.col("key")), "left_anti").select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    return _drop(docs, toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text_key",)).where("predicted = 1"))


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    return _drop(docs, quality_rules.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text_key",)).where("not kept"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    return _drop(docs, minhash.near_duplicates(docs, SHINGLE, PERCENT, carry=("text_key",)).where("not kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries._tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("quality_rules", without_poor), ("minhash", without_copies), ("packing", packed)]
#: Models and components are nothing that SQL can express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents. What a stage has written goes when the next one has read it."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, f"pipeline-{uuid.uuid4().hex}"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
