"""Shards along a Hilbert curve over several metadata dimensions: neighbours on the curve are alike in all of them, so a shard's value ranges prune files.

Each dimension is quantised into 2 ** bits cells along the order of its values, as many rows a cell as can be, however many values there are; a value is never
in two cells. Rows are sorted by curve index and doc_id over the whole cluster, and runs of equal length are cut: law `rows`.

Nulls: a null text has size 8 and crc32 0; null values share the first cell; null doc_ids come first in theirs. Repeated rows each have a slot, and rows of one
doc_id on one place of the curve follow one another by crc32 and size; texts may be of any length; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, prepare, ranked
from dossier.operators.order import running_sum


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points [n, dimensions]. Level by level from the top bit, the cell's corner turns the cube for the levels below."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(n):
            on = (x[:, d] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | ((x[:, d] >> level) & 1)
    return out


def _number_cuts(rows: DataFrame, name: str, bits: int) -> list:
    return rows.agg(F.percentile_approx(name, [k / 2**bits for k in range(1, 2**bits)], 10000)).first()[0] or []


def _word_cuts(rows: DataFrame, name: str, bits: int) -> list:
    """The smallest value of each cell but the first. Only these come to the driver: the order of the values is a running sum of their counts."""
    counts = cut(rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    cells = running_sum(counts, [name], F.col("n"), "before").withColumn("cell", F.expr(f"(before * {2**bits}L) div {total}L"))
    return sorted(r.low for r in cells.groupBy("cell").agg(F.min(name).alias("low")).collect() if r.cell)


def _cell(name: str, cuts: list, kind: str) -> Column:
    """How many of the cuts a value reaches or, a number, goes over; nulls are in the first cell."""
    if not cuts:
        return F.lit(0)
    own = F.array(*(F.lit(c).cast(kind) for c in sorted(set(cuts))))
    return F.coalesce(F.size(F.filter(own, lambda c: c <= F.col(name) if kind == "string" else c < F.col(name))), F.lit(0))


def _metadata(words: list[str]) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), *(F.col(w).cast("string").alias(f"word_{w}") for w in words)]


def _placed(docs: DataFrame, words: list[str], shards: int, bits: int, *more: Column) -> DataFrame:
    """Metadata, hilbert, shard, slot and more columns of each row, in slot order within its part."""
    prepare(docs.sparkSession)
    rows = cut(docs.select(*_metadata(words)))  # narrow: the texts are read once for it
    cells = [_cell(f"word_{w}", _word_cuts(rows, f"word_{w}", bits), "string") for w in words] + [_cell("size", _number_cuts(rows, "size", bits), "long")]

    @F.pandas_udf("long")
    def index(*points: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([p.to_numpy() for p in points], 1), bits))

    rows = docs.select(*_metadata(words), *more) if more else rows
    at, total = ranked(rows.withColumn("hilbert", index(*cells)), ["hilbert", "doc_id", "text_crc32", "size"])
    n = max(1, total)
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return at.withColumn("shard", F.expr(f"rank * {shards}L div {n}L")).withColumn("slot", F.col("rank") - first)


def hilbert_shards(docs: DataFrame, words: list[str], shards: int, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert of each row. words: columns of docs that are dimensions beside the size."""
    out = _placed(docs, words, shards, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, words: list[str], shards: int, folder: str, bits: int = 5) -> None:
    """The rows of docs under folder/shard=N. Each task writes a run of the curve, so a shard of many parts is many files, each of a narrow run of slots; a file's
    ranges of values prune it. Columns of docs named shard or slot are replaced."""
    out = _placed(docs, words, shards, bits, F.struct(*(c for c in docs.columns if c not in ("shard", "slot"))).alias("doc"))
    out.select("doc.*", F.col("shard").cast("int").alias("shard"), "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
