"""Isolation forest in arrays: random splits, path lengths of whole batches at once."""

from __future__ import annotations

import numpy as np


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (n - 1) / big, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """``trees`` random trees over ``sample`` points each, kept as full binary arrays of ``depth`` levels."""

    def __init__(self, points: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(points)
        self.sample = min(sample, n)
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, size), np.int16)
        self.cut = np.full((trees, size), np.inf, np.float64)
        self.length = np.zeros((trees, size), np.float32)
        for t in range(trees):
            self._grow(points[rng.choice(n, self.sample, replace=False)] if n else points, t, 0, 0, rng)

    def _grow(self, x: np.ndarray, tree: int, node: int, level: int, rng) -> None:
        lo, hi = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(hi > lo)
        if level == self.depth or len(x) <= 1 or not len(open_):
            # a leaf: its value is repeated below it, so every row may walk the full depth
            self._fill(tree, node, level, level + float(average_path(len(x))))
            return
        f = int(rng.choice(open_))
        c = float(rng.uniform(lo[f], hi[f]))
        self.feature[tree, node], self.cut[tree, node] = f, c
        left = x[:, f] <= c
        self._grow(x[left], tree, 2 * node + 1, level + 1, rng)
        self._grow(x[~left], tree, 2 * node + 2, level + 1, rng)

    def _fill(self, tree: int, node: int, level: int, value: float) -> None:
        first, width = node, 1
        for _ in range(level, self.depth + 1):
            self.length[tree, first: first + width] = value
            first, width = 2 * first + 1, 2 * width

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: 2 ** -(mean path length / expected path length)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / max(1e-9, float(average_path(self.sample)) or 1.0))
