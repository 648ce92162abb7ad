"""Integer vectors in shards, and questions that meet the shards in blocks: what the exact search and the mining of hard negatives share.

A component x becomes floor(256 * x). Vectors that are null or hold a null or a component that isn't finite take no part; a shorter vector counts as if zeros followed,
an empty one as zeros. Inner products are whole numbers and exact at any size: doubles where their bound is below 2 ** 53, Python's integers beyond. What doesn't
fit in a long is returned as the nearest long."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut, prepare

#: Rows of one shard at most (about: shards are cut by hash), questions that are worked on together.
SHARD, BLOCK = 1 << 16, 256
SCALE = 256
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Rows and components of a table of vectors, and whether doubles hold their inner products exactly."""

    rows: int
    dims: int
    doubles: bool


def quantised(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """The rows that take part, with e: the whole-number components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | F.isnan(x.cast("double") - x.cast("double")))
    return df.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn("e", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def shape(rows: DataFrame) -> Shape:
    """Of rows with e; one row comes to the driver."""
    far = F.array_max(F.transform("e", lambda x: F.abs(x.cast("double"))))
    n, d, m = rows.agg(F.count("*"), F.max(F.size("e")), F.max(far)).first()
    return Shape(n, max(d or 0, 1), (d or 0) * (m or 0.0) ** 2 < 2**53)


def matrix(col: pa.Array | pa.ChunkedArray, s: Shape) -> np.ndarray:
    """The vectors of a column of lists, one a row, ended by zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n, flat = len(col), col.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(col.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    out = np.zeros((n, s.dims), np.float64 if s.doubles else object)
    if n and (size == s.dims).all():
        out[:] = flat.reshape(n, s.dims)
    elif n:
        row = np.repeat(np.arange(n), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out if s.doubles else np.frompyfunc(int, 1, 1)(out).reshape(out.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each row of a with each row of b, within the range of a long."""
    out = a @ b.T
    return np.minimum(np.maximum(out, -LONG - 1), LONG) if out.dtype == object else out


def ids(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which of them are null."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null(LONG).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)


def firsts(owner: np.ndarray, score: np.ndarray, vec: np.ndarray, void: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner: higher scores first, then smaller ids, then rows without an id."""
    down = -np.unique(score, return_inverse=True)[1] if score.dtype == object else -score
    order = np.lexsort((vec, void, down, owner))
    o = owner[order]
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
    place = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return order[place < k]


def under(score: np.ndarray) -> np.ndarray:
    """Doubles that are no more than the scores: what is compared with them isn't left out for a rounding."""
    out = score.astype(np.float64)
    return np.nextafter(out, -np.inf) if score.dtype == object else out


def leasts(col: pa.Array) -> np.ndarray:
    """A column of scores as doubles that are no more; -inf for null."""
    out = col.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
    return np.where(np.abs(out) < 2**53, out, np.nextafter(out, -np.inf))


def shards(spark, rows: int, largest: int = SHARD) -> int:
    """As many as keep a shard within `largest` rows, and one for each shuffle partition at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // largest))


def meet(held: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """One stream for each shard: rows of held (side 0), then those of asked (side 1), whatever task has the shard. Nothing is paired before it is worked on."""
    prepare(held.sparkSession)
    both = held.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "side")


def streams(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """key, side and rows of each run of equal key and side in a batch of meet()."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "side"]])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(at[:-1, a].tolist()), int(at[-1, a]), batch.slice(a, b - a)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, cut, with a number of each in `name`: rows that repeat are told apart."""
    return cut(rows.withColumn(name, F.monotonically_increasing_id()))
