"""Gradient-boosted trees for two classes, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    #: For each tree, in heap order: the feature and the value that a row must exceed to go right; the leaves' log odds.
    features: np.ndarray
    values: np.ndarray
    leaves: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for f, v, leaf in zip(self.features, self.values, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > v[at])
            out += leaf[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 1.0, share: float = 1.0, seed: int = 1) -> Trees:
    """Newton boosting of the logistic loss; each split has the best gain over the quantiles of those features, a share of
    all, that are drawn for its tree."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, width = binned.shape
    prior = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    score = np.full(n, prior)
    inner, ends = 2**depth - 1, 2**depth
    all_f, all_v, all_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, ends))
    draw, some = np.random.default_rng(seed), max(1, round(share * width))
    for t in range(trees):
        chosen = np.sort(draw.choice(width, some, replace=False)) if some < width else np.arange(width)
        cell = binned[:, chosen] + np.arange(some) * bins
        p = 1 / (1 + np.exp(-score))
        g, h, at = y - p, p * (1 - p), np.zeros(n, np.int64)
        repeated = [np.repeat(w, some) for w in (g, h)]
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            index = ((at - first)[:, None] * (some * bins) + cell).reshape(-1)
            sums = [np.bincount(index, w, count * some * bins).reshape(count, some, bins).cumsum(2) for w in repeated]
            total = [s[:, :1, -1:] for s in sums]
            gain = sums[0] ** 2 / (sums[1] + ridge) + (total[0] - sums[0]) ** 2 / (total[1] - sums[1] + ridge)
            best = gain.reshape(count, -1).argmax(1)
            f, b = chosen[best // bins], best % bins
            all_f[t, first : first + count] = f
            all_v[t, first : first + count] = [edges[i][j] if j < len(edges[i]) else np.inf for i, j in zip(f, b, strict=True)]
            at = 2 * at + 1 + (binned[np.arange(n), f[at - first]] > b[at - first])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, ends) / (np.bincount(leaf, h, ends) + ridge)
        all_l[t] = value
        score += value[leaf]
    return Trees(all_f, all_v, all_l, prior)
