"""Exact search for the highest inner products: a ball tree for each shard, branch and bound, the kth score so far shared by all shards.

Rows go to the nearest of a bounded number of pivots (a sample by hash); clusters with more rows than a shard holds are cut into several by hash, so a very common
vector fills no task. Each shard becomes a tree of balls, halved along the widest direction down to leaves. No score of a ball passes q.c + |q| r, so the clusters
are asked in the order of that bound: first the best one of each query, then the next ones, and last all others, each time with the kth score found until then.
In a shard the bound goes down the tree, and its leaves are scored in the order of their bounds, in waves that double, each wave with the kth score after the one
before. A ball is left out only if its bound is below the kth score, so ties are whole.

Rows: those of vectors.quantised. A query's own row is each row with its id; rows without an id are candidates, last among equals, and never queries. Repeated rows
are candidates and queries of their own. Fewer candidates than asked give all; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm import vectors as V
from dossier.llm.common import cut, frugal, prepare

#: Pivots at most (their matrix is what each task is sent), rows of a leaf, clusters that the rounds before the last ask.
PIVOTS, LEAF, ROUNDS = 1024, 128, (1, 4)


class Tree:
    """A ball tree over the rows of a matrix. Nodes lie in levels: those of level k halve those of level k - 1; the last level has the leaves."""

    def __init__(self, points: np.ndarray, order: np.ndarray, bounds: np.ndarray, centers: list[np.ndarray], radii: list[np.ndarray]):
        self.points, self.order, self.bounds, self.centers, self.radii = points, order, bounds, centers, radii

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        x = points.astype(np.float64)
        order, bounds = np.arange(len(x)), np.array([0, len(x)])
        centers, radii = [], []
        while True:
            c = np.stack([x[order[a:b]].mean(0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            r = np.array([np.sqrt(((x[order[a:b]] - c[k]) ** 2).sum(1).max()) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])
            centers.append(c)
            radii.append(r)
            if np.diff(bounds).max() <= leaf:
                return cls(points, order, bounds, centers, radii)
            new = [0]
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = order[a:b]
                far = x[own[((x[own] - c[k]) ** 2).sum(1).argmax()]]  # the farthest row of the centre, and the farthest from that one
                other = x[own[((x[own] - far) ** 2).sum(1).argmax()]]
                order[a:b] = own[np.argsort(x[own] @ (other - far), kind="stable")]
                new += [a + (b - a) // 2, b]
            bounds = np.array(new)

    def leaf_bounds(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each leaf; -inf below a ball whose bound is under the query's least score."""
        norm = np.sqrt((q * q).sum(1))[:, None]
        out = np.zeros((len(q), 1))
        for k, (c, r) in enumerate(zip(self.centers, self.radii, strict=True)):
            above = np.repeat(out, 2, 1) if k else out
            bound = q @ c.T + norm * r
            bound += 1e-6 + 1e-9 * norm * (np.sqrt((c * c).sum(1)) + r)  # doubles round
            out = np.where((above == -np.inf) | (bound < least[:, None]), -np.inf, bound)
        return out

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, points=self.points if self.points.dtype != object else np.array(self.points.tolist(), np.int64), order=self.order, bounds=self.bounds, **{f"c{k}": c for k, c in enumerate(self.centers)}, **{f"r{k}": r for k, r in enumerate(self.radii)})
        return to.getvalue()

    @classmethod
    def load(cls, data: bytes, doubles: bool) -> Tree:
        with np.load(io.BytesIO(data)) as f:
            n = sum(k[0] == "c" for k in f.files)
            points = f["points"] if doubles else np.frompyfunc(int, 1, 1)(f["points"])
            return cls(points, f["order"], f["bounds"], [f[f"c{k}"] for k in range(n)], [f[f"r{k}"] for k in range(n)])


def best(tree: Tree, vec: np.ndarray, void: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows of the tree for each query, none below its least score; own: the id that a query leaves out."""
    exact = q
    q, least = q.astype(np.float64), least.astype(np.float64).copy()
    bound = tree.leaf_bounds(q, least)
    ranks = np.argsort(-bound, 1, kind="stable")
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), exact[:0, 0])
    done, wave = 0, 1
    while done < ranks.shape[1]:
        leaves = ranks[:, done : done + wave]
        asked, col = np.nonzero(np.take_along_axis(bound, leaves, 1) >= np.maximum(least, -1e300)[:, None])
        if not len(asked):
            break
        leaf = leaves[asked, col]
        parts = [found]
        for x in np.unique(leaf).tolist():
            who, rows = asked[leaf == x], tree.order[tree.bounds[x] : tree.bounds[x + 1]]
            score = V.scores(exact[who], tree.points[rows])
            i, j = np.nonzero((score >= least[who][:, None]).astype(bool) & ((vec[rows][None] != own[who][:, None]) | void[rows][None]))
            parts.append((who[i], rows[j], score[i, j]))
        owner, row, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = V.firsts(owner, score, vec[row], void[row], k)
        found = owner[keep], row[keep], score[keep]
        last = np.r_[found[0][1:] != found[0][:-1], True] if len(keep) else np.zeros(0, bool)
        full = last & (np.bincount(found[0], minlength=len(q))[found[0]] == k)
        least[found[0][full]] = np.maximum(least[found[0][full]], V.under(found[2][full]))
        done, wave = done + wave, 2 * wave
    return found


def _nearest(pivots: np.ndarray, s: V.Shape):
    half = (pivots * pivots).sum(1) / 2

    def run(batches):
        for b in batches:
            x = V.matrix(b["e"], s).astype(np.float64)
            near = np.empty(len(x), np.int32)
            for i in range(0, len(x), 1024):
                near[i : i + 1024] = (x[i : i + 1024] @ pivots.T - half).argmax(1)
            far = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["e"], pa.array(near), pa.array(far)], names=["vec_id", "e", "cluster", "far"])

    return run


INDEX = "cluster int, sub int, vec_ids array<long>, tree binary"


def _trees(s: V.Shape):
    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def tree():
            t = pa.Table.from_batches(held)
            vec = t["vec_id"].combine_chunks()
            at = pa.array([0, len(vec)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.ListArray.from_arrays(at, vec), pa.array([Tree.build(V.matrix(t["e"], s)).dump()], pa.binary())], names=["cluster", "sub", "vec_ids", "tree"])

        for k, _, rows in V.streams(batches, ["cluster", "sub"]):
            if k != key and held:
                yield tree()
                held.clear()
            key = k
            held.append(rows)
        if held:
            yield tree()

    return run


class Index:
    """Trees of all shards (a table in the shared folder) and the balls of the clusters."""

    def __init__(self, trees: DataFrame, shape: V.Shape, pivots: np.ndarray, clusters: np.ndarray, radii: np.ndarray, subs: np.ndarray):
        self.trees, self.shape, self.pivots, self.clusters, self.radii, self.subs = trees, shape, pivots, clusters, radii, subs


def index(rows: DataFrame, largest: int = V.SHARD, most: int = PIVOTS) -> Index:
    """Of rows with vec_id and e. Each row is indexed; only the pivots are a sample."""
    spark = prepare(rows.sparkSession)
    rows = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "e"))
    s = V.shape(rows)
    n = min(most, V.shards(spark, s.rows, largest))
    some = rows.select("e").orderBy(F.xxhash64("vec_id", "e"), "e").limit(n).collect()
    pivots = np.zeros((max(len(some), 1), s.dims))
    for i, r in enumerate(some):
        pivots[i, : len(r.e)] = r.e
    near = cut(rows.mapInArrow(_nearest(pivots, s), "vec_id long, e array<long>, cluster int, far double"))
    balls = sorted(near.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect())
    subs = np.array([-(-b.n // largest) for b in balls], np.int64)
    parts = F.create_map(*[F.lit(int(x)) for b, m in zip(balls, subs, strict=True) for x in (b.cluster, m)]) if balls else F.create_map(F.lit(0), F.lit(1))
    dealt = near.withColumn("sub", F.pmod(F.xxhash64("vec_id", "e"), parts[F.col("cluster")]).cast("int")).withColumn("side", F.lit(0))
    trees = cut(dealt.repartition("cluster", "sub").sortWithinPartitions("cluster", "sub").mapInArrow(frugal(_trees(s)), INDEX))
    return Index(trees, s, pivots, np.array([b.cluster for b in balls], np.int32), np.array([b.r for b in balls], np.float64), subs)


def _routes(ix: Index, first: int, stop: int):
    """The shards of the clusters that are first to stop - 1 by bound, for each query that its least score doesn't keep from them."""
    centers, clusters, radii, subs, s = ix.pivots[ix.clusters], ix.clusters, ix.radii, ix.subs, ix.shape

    def run(batches):
        for b in batches:
            q = V.matrix(b["e"], s).astype(np.float64)
            least = V.leasts(b["least"])
            norm = np.sqrt((q * q).sum(1))[:, None]
            bound = q @ centers.T + norm * radii
            bound += 1e-6 + 1e-9 * norm * (np.sqrt((centers * centers).sum(1)) + radii)
            ranks = np.argsort(-bound, 1, kind="stable")[:, first:stop]
            i, j = np.nonzero(np.take_along_axis(bound, ranks, 1) >= least[:, None])
            at = ranks[i, j]
            i, at = np.repeat(i, subs[at]), np.repeat(at, subs[at])
            sub = np.arange(len(at)) - np.maximum.accumulate(np.where(np.r_[True, (at[1:] != at[:-1]) | (i[1:] != i[:-1])], np.arange(len(at)), 0)) if len(at) else at
            for x in range(0, len(i), 4096):
                own = pa.array(i[x : x + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(clusters[at[x : x + 4096]]), pa.array(sub[x : x + 4096].astype(np.int32)), *(b[c].take(own) for c in ("qkey", "query_id", "e", "least"))], names=["cluster", "sub", "qkey", "query_id", "e", "least"])

    return run


def _searched(s: V.Shape, k: int):
    def run(batches):
        tree = vec = void = None
        for _, side, rows in V.streams(batches, ["cluster", "sub"]):
            if not side:
                vec, void = V.ids(rows["vec_ids"].flatten())
                tree = Tree.load(rows["tree"][0].as_py(), s.doubles)
                continue
            for x in range(0, rows.num_rows, V.BLOCK):
                b = rows.slice(x, V.BLOCK)
                least = V.leasts(b["least"])
                who, row, score = best(tree, vec, void, V.matrix(b["e"], s), b["query_id"].to_numpy(), least, k)
                yield pa.RecordBatch.from_arrays([b["qkey"].take(pa.array(who)), pa.array(vec[row], pa.int64(), mask=void[row]), pa.array(score.astype(np.int64))], names=["qkey", "vec_id", "score"])

    return run


FOUND = "qkey long, vec_id long, score long"


def search(ix: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query (query_id, e)."""
    spark = prepare(queries.sparkSession)
    asked = V.numbered(queries.select(F.col("query_id").cast("long").alias("query_id"), "e"), "qkey")
    order = W.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = spark.createDataFrame([], FOUND)
    stops = sorted({min(x, len(ix.clusters)) for x in (*np.cumsum(ROUNDS).tolist(), len(ix.clusters))} - {0})
    for first, stop in zip([0, *stops], stops, strict=False):
        kth = found.where(F.col("rank") == k).select("qkey", F.col("score").alias("least")) if "rank" in found.columns else found.select("qkey", F.col("score").alias("least"))
        routed = asked.join(kth, "qkey", "left").mapInArrow(_routes(ix, first, stop), "cluster int, sub int, qkey long, query_id long, e array<long>, least long")
        more = V.meet(ix.trees, routed, ["cluster", "sub"]).mapInArrow(frugal(_searched(ix.shape, k)), FOUND)
        found = cut(found.select("qkey", "vec_id", "score").unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    if not stops:
        found = found.withColumn("rank", F.lit(0))
    return found.join(asked.select("qkey", "query_id"), "qkey").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(rows: DataFrame, asks: Column, k: int, vector: str = "embedding", largest: int = V.SHARD) -> DataFrame:
    """The k highest scores of each row for which asks holds, among all other rows."""
    prepare(rows.sparkSession)
    taken = cut(V.quantised(rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector), vector).select("vec_id", "e"))
    return search(index(taken, largest), taken.where(asks).select(F.col("vec_id").alias("query_id"), "e"), k)
