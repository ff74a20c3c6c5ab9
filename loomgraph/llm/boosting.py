"""Gradient-boosted trees for two classes, with numpy: binned features, level-wise trees, Newton leaf values."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = n_trees, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, share = self._binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-z))
            tree, leaf = self._tree(b, p - y, p * (1 - p))
            self.trees.append(tree)
            z += tree[2][leaf]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Complete trees: (feature, bin) of each inner node, in heap order; rows with bin <= go left."""
        n_inner, width = 2**self.depth - 1, self.bins + 1
        feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, width, np.int64)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            base, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for j in range(b.shape[1]):
                key = (node - base) * width + b[:, j]
                sg = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                sh = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + self.least) + (tg - sg) ** 2 / (th - sh + self.least) - tg**2 / (th + self.least)
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[base + i], cut[base + i] = top[i], j, at[i]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - n_inner
        sums = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        return (feature, cut, -self.rate * sums[0] / (sums[1] + self.least)), leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, z = self._binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            z += value[node - len(feature)]
        return 1 / (1 + np.exp(-z))


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on at least the wanted share of candidates is right; 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    ok = ends[right[ends] >= precision]
    return float(p[order][ok[-1]]) if len(ok) else 1.0
