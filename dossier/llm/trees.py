"""Gradient-boosted trees on a driver-sized sample, kept as flat numpy arrays: all trees are full and of one depth, so a level is one array step.

Children of node i are 2 i + 1 (value <= threshold) and 2 i + 2. A node that isn't split sends all rows left and hands its value down."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x nodes
    rows: np.ndarray  # trees x nodes: training rows that came there

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        all_rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[all_rows, f[at]] > t[at])
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boosted(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, leaf: float = 3.0, bins: int = 64) -> Forest:
    """signs: -1, 0 or 1 for each feature, the way the score may go with it. A split against its sign is not made, and its midpoint bounds what stands below."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for f in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1) if n else np.zeros((0, k), int)
    width = bins + 1
    p = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    inner, full = 2**depth - 1, 2 ** (depth + 1) - 1
    feature, threshold, value, rows = (np.zeros((trees, s), d) for s, d in ((inner, np.int64), (inner, float), (full, float), (full, np.int64)))
    threshold[:] = np.inf
    margin, flat = np.full(n, base), binned + np.arange(k) * width
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        at, low, high = np.zeros(n, np.int64), np.full(full, -np.inf), np.full(full, np.inf)
        for node in range(full):
            own = np.flatnonzero(at == node)
            rows[t, node] = len(own)
            a, b = g[own].sum(), h[own].sum()
            value[t, node] = np.clip(-a / (b + ridge), low[node], high[node])
            if node >= inner:
                continue
            lo, hi = low[node], high[node]
            cut = None
            if len(own) >= 2:
                both = [np.bincount(flat[own].ravel(), np.repeat(w[own], k), k * width).reshape(k, width).cumsum(1)[:, :-1] for w in (g, h, np.ones(n))]
                ga, ha, ca = both
                gb, hb, cb = a - ga, b - ha, len(own) - ca
                wa, wb = (np.clip(-u / (v + ridge), lo, hi) for u, v in ((ga, ha), (gb, hb)))
                gain = -(2 * ga * wa + (ha + ridge) * wa**2) - (2 * gb * wb + (hb + ridge) * wb**2) + (2 * a * value[t, node] + (b + ridge) * value[t, node] ** 2)
                gain[(ca < leaf) | (cb < leaf) | (signs[:, None] * (wb - wa) < 0)] = -1
                best = np.unravel_index(gain.argmax(), gain.shape)
                if gain[best] > 1e-6 and best[1] < len(edges[best[0]]):
                    cut = best
            l, r = 2 * node + 1, 2 * node + 2
            low[[l, r]], high[[l, r]] = lo, hi
            if cut is None:
                at[own] = l
                low[l] = high[l] = value[t, node]
                continue
            f, c = int(cut[0]), int(cut[1])
            feature[t, node], threshold[t, node] = f, edges[f][c]
            at[own] = np.where(binned[own, f] <= c, l, r)
            if signs[f]:
                middle = (wa[cut] + wb[cut]) / 2
                (high if signs[f] > 0 else low)[l] = middle
                (low if signs[f] > 0 else high)[r] = middle
        value[t] *= rate
        margin += value[t][at]
    return Forest(base, depth, feature, threshold, value, rows)


Rule = tuple[tuple[int, float, float], ...]


def paths(forest: Forest) -> list[Rule]:
    """The distinct conjunctions (feature, above, at most) that lead to a node below the roots and stand for some training rows."""
    found: dict[Rule, None] = {}
    for f, t, rows in zip(forest.feature, forest.threshold, forest.rows, strict=True):
        box: dict[int, dict[int, tuple[float, float]]] = {0: {}}
        for node in range(len(f)):
            for child in (2 * node + 1, 2 * node + 2):
                box[child] = own = dict(box[node])
                if np.isfinite(t[node]):
                    lo, hi = own.get(int(f[node]), (-np.inf, np.inf))
                    own[int(f[node])] = (lo, min(hi, float(t[node]))) if child % 2 else (max(lo, float(t[node])), hi)
                    if rows[child]:
                        found[tuple(sorted((k, *v) for k, v in own.items()))] = None
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """rows x rules: whether each rule holds."""
    out = np.ones((len(x), len(rules)), bool)
    for r, rule in enumerate(rules):
        for f, lo, hi in rule:
            out[:, r] &= (x[:, f] > lo) & (x[:, f] <= hi)
    return out


def lasso_violation(x: np.ndarray, y: np.ndarray, rows: np.ndarray, b: float, w: np.ndarray, penalty: float) -> float:
    """How far intercept and weights are from the optimum's conditions: the slope is 0 for the intercept, minus the penalty with a weight's sign, and no more
    than the penalty where a weight is 0. y: sums of labels, rows: numbers of rows that each row of x stands for."""
    e = (rows / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y) / rows.sum()
    g = x.T @ e
    return float(max([abs(e.sum()), *np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0))]))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, close: float = 0.02, steps: int = 50_000) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights for 0/1 columns by accelerated proximal gradient steps that begin anew when they overshoot, until the optimum's conditions hold
    to `close` of the penalty. penalty is for each row; rows with equal columns are one row with a weight."""
    n, k = x.shape
    if not n:
        return 0.0, np.zeros(k)
    _, one, own = np.unique(np.packbits(x.astype(bool), axis=1), axis=0, return_index=True, return_inverse=True)
    rows, sums = np.bincount(own.ravel()).astype(float), np.bincount(own.ravel(), y)
    x = x[one].astype(float)
    size = 0.25 * np.linalg.norm(np.c_[x, np.ones(len(x))] * np.sqrt(rows / n)[:, None], 2) ** 2
    w, z, b, c, m = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for step in range(steps):
        e = (rows / (1 + np.exp(-np.clip(x @ z + c, -40, 40))) - sums) / n
        u = z - x.T @ e / size
        w_next, b_next = np.sign(u) * np.maximum(np.abs(u) - penalty / size, 0), c - e.sum() / size
        back = (z - w_next) @ (w_next - w) + (c - b_next) * (b_next - b) > 0
        m_next = 1.0 if back else (1 + np.sqrt(1 + 4 * m * m)) / 2
        go = 0.0 if back else (m - 1) / m_next
        z, c = w_next + go * (w_next - w), b_next + go * (b_next - b)
        w, b, m = w_next, b_next, m_next
        if step % 50 == 49 and lasso_violation(x, sums, rows, b, w, penalty) <= close * penalty:
            break
    return b, w
