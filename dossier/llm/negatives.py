"""Hard negatives of each anchor and positive: the best rows of another label whose score lies in the positive's window.

The upper limits of an anchor's positives, in descending order, cut the scores into disjoint slots. Each shard of rows scores a block of anchors at once and keeps the
best few of each slot, a combiner keeps the best few of each slot of all shards, and since the window of a positive is all slots from its own downwards, merging the
slots from the lowest up gives the best below each limit; the lower limits then end each list. So no window is searched by itself, however the windows overlap.

Shards hold rows of one range of label hashes, cut further by a hash of the row where a label is hot; anchors visit the shards of their label for the positives and
all shards for the negatives. Nothing is paired in the plan.

Rows: those of vectors.quantised with a label. An anchor's own row is each row with its id; rows without an id may be positives or negatives, last among equals, and
are never anchors. Repeated rows count as often as they come, as anchors too. Anchors without a positive return nothing; an empty table gives an empty one; other
columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm import vectors as V
from dossier.llm.common import cut, frugal, prepare

#: Rows that are scored together.
CHUNK = 2048


class Shard:
    """Rows of one shard as they come, then one matrix."""

    def __init__(self, s: V.Shape):
        self.s, self.parts = s, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((V.matrix(rows["e"], self.s), *V.ids(rows["vec_id"]), rows["label"].to_numpy()))

    def close(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) != 1:
            self.parts = [tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))]
        return self.parts[0]


def kept(best: list[np.ndarray], slots: np.ndarray, n: int, rows: tuple[np.ndarray, ...], a: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, k: int) -> list[np.ndarray]:
    """best (slot number of anchor, score, id, no id) after rows: the k best of each slot of each anchor. slots: upper limits of each anchor, descending, n of them; a row above the
    first limit is in none."""
    x, vec, void, labels = rows
    floor = np.full(len(a) * n, -np.inf)
    for i in range(0, len(x), CHUNK):
        part = slice(i, i + CHUNK)
        score = V.scores(a, x[part])
        fits = ((labels[part][None] == label[:, None]) == same) & ((vec[part][None] != own[:, None]) | void[part][None])
        slot = np.full(score.shape, -1, np.int64)
        for j in range(n):
            slot += (score <= slots[:, j : j + 1]).astype(bool)
        at = np.arange(len(a))[:, None] * n + np.maximum(slot, 0)
        r, c = np.nonzero(fits & (slot >= 0) & (score >= floor[at]).astype(bool))
        new = at[r, c], score[r, c], vec[part][c], void[part][c]
        best = [np.concatenate(y) for y in zip(best, new, strict=True)]
        keep = V.firsts(*best, k)
        best = [y[keep] for y in best]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) == k)
        ends = np.searchsorted(best[0], full, "right") - 1
        floor[full] = V.under(best[1][ends])
    return best


def _scored(s: V.Shape, n: int, same: bool, k: int):
    """The k best rows of each slot (limits) of each anchor in each shard."""

    def run(batches):
        key, shard = None, None
        for at, side, rows in V.streams(batches, ["bucket", "sub"]):
            if not side:
                if at != key:
                    key, shard = at, Shard(s)
                shard.add(rows)
                continue
            if at != key:
                continue  # a shard without rows
            held = shard.close()
            for i in range(0, rows.num_rows, V.BLOCK):
                b = rows.slice(i, V.BLOCK)
                a = V.matrix(b["e"], s)
                limits = b["limits"].flatten().to_numpy(zero_copy_only=False).reshape(len(a), n) if n > 1 or not same else np.full((len(a), 1), np.inf)
                limits = limits if s.doubles or same else limits.astype(object)
                none = [np.zeros(0, np.int64), a[:0, 0], np.zeros(0, np.int64), np.zeros(0, bool)]
                best = kept(none, limits, n, held, a, b["vec_id"].to_numpy(), b["label"].to_numpy(), same, k)
                yield pa.RecordBatch.from_arrays([b["akey"].take(pa.array(best[0] // n)), pa.array((best[0] % n).astype(np.int32)), pa.array(best[2], pa.int64(), mask=best[3]), pa.array(best[1].astype(np.int64))], names=["akey", "slot", "vec_id", "score"])

    return run


FOUND = "akey long, slot int, vec_id long, score long"


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vector: str = "embedding", largest: int = V.SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its first positives of the same label, the first negatives of another label
    with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = prepare(rows.sparkSession)
    taken = V.quantised(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector).where("label is not null"), vector)
    taken = cut(taken.select("vec_id", "label", "e"))
    s = V.shape(taken)
    n = V.shards(spark, s.rows, largest)
    per = max(1, -(-s.rows // n))
    bucketed = taken.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(min(n, 1024))).cast("int"))
    sizes = sorted(bucketed.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    subs = F.create_map(*[F.lit(x) for b in sizes for x in (b.bucket, -(-b.n // per))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    held = cut(bucketed.withColumn("sub", F.pmod(F.xxhash64("vec_id", "e"), subs[F.col("bucket")]).cast("int")))
    asked = V.numbered(held.where(anchors & F.col("vec_id").isNotNull()).select("vec_id", "label", "e", "bucket"), "akey")
    best = lambda *of: W.partitionBy(*of).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))

    home = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), subs[F.col("bucket")] - 1)))
    near = V.meet(held, home, ["bucket", "sub"]).mapInArrow(frugal(_scored(s, 1, True, positives)), FOUND)
    near = near.withColumn("place", F.row_number().over(best("akey"))).where(F.col("place") <= positives)
    near = cut(near.select("akey", (F.col("place") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # floor(high * score / 100) in whole numbers; places without a positive have no rows below them
    up = F.col("positive_score").cast("decimal(38,0)") * high
    limit = ((up - F.pmod(up, F.lit(100))) / 100).cast("long")
    limits = near.groupBy("akey").agg(F.sort_array(F.collect_list(limit), False).alias("limits"))
    limits = limits.withColumn("limits", F.concat("limits", F.array_repeat(F.lit(-V.LONG - 1), positives - F.size("limits"))))
    everywhere = [F.struct(F.lit(b.bucket).alias("bucket"), F.lit(x).alias("sub")) for b in sizes for x in range(-(-b.n // per))]
    away = asked.drop("bucket").join(limits, "akey").withColumn("to", F.explode(F.array(*everywhere) if everywhere else F.expr("array(struct(0 bucket, 0 sub))"))).select("*", "to.bucket", "to.sub").drop("to")
    slots = V.meet(held, away, ["bucket", "sub"]).mapInArrow(frugal(_scored(s, positives, False, negatives)), FOUND)
    slots = slots.withColumn("place", F.row_number().over(best("akey", "slot"))).where(F.col("place") <= negatives)

    # the complement turns the order round as the negative does, but has no overflow at the lowest score
    item = F.struct(F.bitwise_not("score").alias("down"), F.col("vec_id").isNull().alias("void"), F.col("vec_id"), F.col("score"))
    by = slots.groupBy("akey").agg(*(F.collect_list(F.when(F.col("slot") == j, item)).alias(f"s{j}") for j in range(positives)))
    for j in reversed(range(positives)):
        below = [F.col(f"s{j}"), *([F.col(f"w{j + 1}")] if j + 1 < positives else [])]
        by = by.withColumn(f"w{j}", F.slice(F.array_sort(F.concat(*below)), 1, negatives))
    by = by.select("akey", F.posexplode(F.array(*(F.col(f"w{j}") for j in range(positives)))).alias("place", "window"))
    out = near.join(by, ["akey", "place"]).select("akey", "positive_id", "positive_score", F.posexplode("window").alias("at", "x"))
    d = lambda c: F.col(c).cast("decimal(38,0)")
    out = out.where(d("positive_score") * low <= d("x.score") * 100)
    return out.join(asked.select("akey", F.col("vec_id").alias("anchor_id")), "akey").select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
