import math
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import balltree, negatives
from dossier.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, e string"


def table(n=400, d=6, seed=3):
    """Clusters, one vector that a third of the rows share, nulls, odd components, repeated rows and ids, short vectors."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, d))
    rows = []
    for i in range(n):
        x = centers[0] if i % 3 == 0 else centers[i % 5] + r.normal(size=d) * 0.3
        rows.append((i, [float(np.float32(v)) for v in x], int(r.integers(0, 4)), "x"))
    rows += [(None, rows[3][1], 1, "x"), (None, rows[4][1], 2, None), rows[50], rows[50], rows[51], (50, rows[7][1], 2, "x")]
    rows += [(900, None, 1, "x"), (950, [1.0, None], 1, "x"), (1000, [math.nan] * d, 0, "x"), (1050, [math.inf] + [0.0] * (d - 1), 0, "x"), (1100, [], 3, "x"), (1150, [2.0], None, "x"), (1200, [2.0, -1.0], 3, "x")]
    return rows


def taking_part(rows, labelled=False):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and not (labelled and r[2] is None)]
    return [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in ok]


def by_rank(cs):
    return sorted(cs, key=lambda c: (-c[1], c[0] is None, c[0] or 0))


def dot(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def brute_top(rows, k, each=50):
    rows, out = taking_part(rows), []
    for q in rows:
        if q[0] is not None and q[0] % each == 0:
            out += [(q[0], i + 1, c[0], c[1]) for i, c in enumerate(by_rank([(r[0], dot(q[1], r[1])) for r in rows if r[0] != q[0]])[:k])]
    return sorted(out, key=str)


def brute_mined(rows, each=50, positives=5, negatives=3, low=50, high=95):
    rows, out = taking_part(rows, True), []
    for q in rows:
        if q[0] is not None and q[0] % each == 0:
            others = [(r[0], dot(q[1], r[1]), r[2]) for r in rows if r[0] != q[0]]
            for p in by_rank([o for o in others if o[2] == q[2]])[:positives]:
                found = by_rank([o for o in others if o[2] != q[2] and low * p[1] <= 100 * o[1] <= high * p[1]])[:negatives]
                out += [(q[0], p[0], i + 1, o[0], p[1], o[1]) for i, o in enumerate(found)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("largest", [1 << 16, 20])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_top_k(spark, monkeypatch, largest, k):
    monkeypatch.setattr(balltree, "LEAF", 8)
    rows = table()
    assert rows_of(balltree.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k, largest=largest)) == brute_top(rows, k)


@pytest.mark.parametrize("largest", [1 << 16, 20])
def test_mined(spark, largest):
    rows = table()
    assert rows_of(negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, largest=largest)) == brute_mined(rows)


def test_other_windows(spark):
    rows = table(150, seed=8)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, positives=3, negatives=10, low=20, high=80)
    assert rows_of(got) == brute_mined(rows, positives=3, negatives=10, low=20, high=80)
    assert rows_of(negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, positives=1)) == brute_mined(rows, positives=1)


def test_scores_beyond_doubles(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4) * 3e7], i % 2, "x") for i in range(60)] + [(60, [3e38, 1.0, 0.0, 0.0], 0, "x")]
    rows = [(a, b if a != 60 else [float(np.float32(1e9))] * 4, c, d) for a, b, c, d in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(balltree.top_k(df, F.col("vec_id") % 10 == 0, 5)) == brute_top(rows, 5, 10)
    assert rows_of(negatives.mine(df, F.col("vec_id") % 10 == 0)) == brute_mined(rows, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(50, None, 1, "x"), (100, [None], 1, "x")], SCHEMA)
    one = spark.createDataFrame([(50, [1.0], 1, "x")], SCHEMA)
    for df in (none, odd, one):
        assert rows_of(balltree.top_k(df, F.col("vec_id") % 50 == 0, 5)) == []
        assert rows_of(negatives.mine(df, F.col("vec_id") % 50 == 0)) == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(300, 8)) * 5 + 100 * r.normal(size=8) for _ in range(6)]).round()
    tree, q = balltree.Tree.build(x, 16), (100 * r.normal(size=(20, 8))).round()
    bound = tree.leaf_bounds(q, np.full(20, -np.inf))
    for k in range(bound.shape[1]):
        own = x[tree.order[tree.bounds[k] : tree.bounds[k + 1]]]
        assert ((q @ own.T).max(1) <= bound[:, k]).all()
    kth = np.sort(q @ x.T, 1)[:, -5]
    cut = tree.leaf_bounds(q, kth)
    assert (cut == -np.inf).mean() > 0.5  # most leaves are left out once the kth score is known
    who, row, score = balltree.best(tree, np.arange(len(x)), np.zeros(len(x), bool), q, np.full(20, -1), np.full(20, -np.inf), 5)
    for k, own in groupby(range(len(who)), key=lambda i: who[i]):
        assert sorted(score[list(own)]) == sorted(np.sort(q[k] @ x.T)[-5:])


def test_slots_keep_what_windows_need():
    """A window's best below its limit are among the best of its slots, also where limits are equal."""
    r = np.random.default_rng(2)
    x, a = r.integers(-9, 9, (500, 3)).astype(float), r.integers(-9, 9, (7, 3)).astype(float)
    limits = -np.sort(-r.integers(-50, 120, (7, 4)).astype(float), 1)
    limits[:, 2] = limits[:, 1]
    rows = x, np.arange(500), np.zeros(500, bool), np.ones(500, np.int64)
    none = [np.zeros(0, np.int64), a[:0, 0], np.zeros(0, np.int64), np.zeros(0, bool)]
    got = negatives.kept(none, limits, 4, rows, a, np.full(7, -1), np.zeros(7, np.int64), False, 3)
    for i in range(7):
        for j in range(4):
            mine = [(-s, v) for o, s, v in zip(got[0], got[1], got[2], strict=True) if o // 4 == i and o % 4 >= j]
            score = x @ a[i]
            assert sorted(mine)[:3] == sorted((-s, v) for v, s in enumerate(score) if s <= limits[i, j])[:3]
    assert V.firsts(np.array([1, 0, 0]), np.array([5.0, 7.0, 7.0]), np.array([1, 9, 3]), np.zeros(3, bool), 1).tolist() == [2, 0]
