"""Gradient-boosted regression trees on the logistic loss, over binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of one depth as arrays: feature, cut and leaf value of each node in heap order."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, least: float = 3.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        flat = binned + np.arange(m) * BINS
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.trees, 1 << self.depth), np.float32)
        f = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)  # place within the level
            for level in range(self.depth):
                width = 1 << level
                key = (at[:, None] * (m * BINS) + flat).ravel()
                sums = [np.bincount(key, weights=np.repeat(v, m), minlength=width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h)]
                (gl, hl), (gt, ht) = (s[:, :, :-1] for s in sums), (s[:, :1, -1:] for s in sums)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least) | (ht - hl < self.least)] = -np.inf
                for node in range(width):
                    j, b = np.unravel_index(gain[node].argmax(), gain[node].shape)
                    slot = width - 1 + node
                    if gain[node, j, b] > 1e-6 and b < len(self.edges[j]):
                        self.feature[t, slot], self.cut[t, slot] = j, self.edges[j][b]
                slot = width - 1 + at
                at = 2 * at + (x[np.arange(n), self.feature[t, slot]] > self.cut[t, slot])
            g, h = (np.bincount(at, weights=v, minlength=1 << self.depth) for v in (g, h))
            self.leaf[t] = -self.rate * g / (h + self.ridge)
            f = f + self.leaf[t, at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                slot = (1 << level) - 1 + at
                at = 2 * at + (x[rows, self.feature[t, slot]] > self.cut[t, slot])
            f += self.leaf[t, at]
        return f
