"""Quality classifier: tree paths over document statistics as conjunctive rules, lasso logistic weights, compiled into one Spark column.

Learnt from at most SAMPLE labelled documents of each quality whose crc32(id) modulo 4 is not 2. The lasso sees every path of every tree, but those that hold in
fewer than SUPPORT of these rows or fail in fewer, and is solved until the optimum's conditions hold. Nulls and empty texts are texts without words; a text of
any length is read whole; repeated rows and texts of equal statistics get the same score each; without labels of both kinds every score is the share of good
ones, or 0.5; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import prepare, remainder
from dossier.llm.docstats import features, statistics
from dossier.llm.quality_rules import SAMPLE, sample
from dossier.llm.trees import Rule, boosted, holds, lasso_logistic, paths

#: Lasso penalty a row; the share of the learning rows that a rule must hold in, and must not hold in.
PENALTY, SUPPORT = 0.0005, 0.002


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules whose weight isn't zero. Deep trees on few splits, shallow ones on many: both give paths."""
    if len(set(y)) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return float(np.log(p / (1 - p))), []
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    free = np.zeros(x.shape[1], int)
    rules = list(dict.fromkeys(r for depth, trees in ((2, 30), (3, 30)) for r in paths(boosted(x, y, free, trees, depth, 0.2))))
    on = holds(rules, x)
    share = on.mean(0)
    fine = np.flatnonzero((share >= SUPPORT) & (share <= 1 - SUPPORT))
    b, w = lasso_logistic(on[:, fine], y, penalty)
    return b, [(rules[i], float(v)) for i, v in zip(fine, w, strict=True) if v]


def compiled(b: float, rules: list[tuple[Rule, float]], columns: list[Column]) -> Column:
    """The probability as a column: one CASE for each rule."""

    def condition(rule: Rule) -> Column:
        parts = [c for f, lo, hi in rule for c in ([columns[f] > lo] if np.isfinite(lo) else []) + ([columns[f] <= hi] if np.isfinite(hi) else [])]
        return reduce(lambda p, q: p & q, parts)

    margin = reduce(lambda p, q: p + q, [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules], F.lit(float(b)))
    return 1 / (1 + F.exp(-margin))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_rules of each row."""
    prepare(docs.sparkSession)
    b, rules = fit(*sample(docs, labels, bound))
    kinds = features()
    rows = statistics(docs).select("doc_id", *(c.alias(f"f_{k}") for k, (c, _) in kinds.items()))
    scored = rows.select("doc_id", compiled(b, rules, [F.col(f"f_{k}") for k in kinds]).alias("score"))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.lit(len(rules)).alias("n_rules"))
