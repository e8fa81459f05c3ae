"""Gradient-boosted regression trees for a logistic loss, over binned features (numpy)."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees are complete, of one depth: arrays (trees, 2**depth - 1) and (trees, 2**depth)."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf
        self.depth = int(np.log2(leaf.shape[1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x (n, features)."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out

    def to_dict(self) -> dict:
        return {"base": self.base, "feature": self.feature.tolist(), "cut": [[float(f"{c:.6g}") for c in t] for t in self.cut], "leaf": [[round(float(v), 5) for v in t] for t in self.leaf]}

    @classmethod
    def from_dict(cls, d: dict) -> Boosted:
        return cls(d["base"], np.array(d["feature"], np.int64), np.array(d["cut"], float), np.array(d["leaf"], float))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 100, depth: int = 5, rate: float = 0.25, l2: float = 2.0) -> Boosted:
    """Second-order boosting; every node takes the split of the greatest gain in its histogram."""
    n, k = x.shape
    values = [np.unique(x[:, f]) for f in range(k)]  # the few values of a code are bins of their own
    edges = [v[:-1] if len(v) <= BINS else np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f, v in enumerate(values)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p = np.average(y, weights=weight)
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - prob), weight * prob * (1 - prob)
        at = np.zeros(n, np.int64)
        feature, cut, split_bin = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.full(2**depth - 1, BINS)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for f in range(k):
                if not len(edges[f]):
                    continue
                cell = local * BINS + binned[:, f]
                left_g = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)[:, :-1]
                left_h = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = 0
                gain = gain[:, : len(edges[f])]
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                for i in np.flatnonzero(value > best):
                    best[i] = value[i]
                    feature[first + i], cut[first + i], split_bin[first + i] = f, edges[f][top[i]], top[i]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > split_bin[at])
        local = at - (2**depth - 1)
        leaf = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + l2)
        margin += leaf[local]
        features.append(feature)
        cuts.append(np.where(np.isinf(cut), 1e300, cut))
        leaves.append(leaf)
    return Boosted(base, np.array(features), np.array(cuts), np.array(leaves))
