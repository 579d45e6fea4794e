"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy.

Both are fitted on a bounded sample on the driver; scoring is vectorised and runs
in the tasks.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of a fixed depth stored as arrays; equal inputs give equal trees."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base = 0.0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.model = []
        share = (y.sum() + 0.5) / (n + 1.0)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        # Rare features (most rows zero) also get edges among their other values.
        for j in range(width):
            other = x[x[:, j] != np.median(x[:, j]), j]
            if len(other):
                edges[j] = np.unique(np.concatenate([edges[j], np.quantile(other, np.linspace(0, 1, 9)[:-1])]))
        codes = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)], axis=1)
        most = max(len(e) for e in edges) + 1
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature = np.full(2**self.depth - 1, -1)
            cut = np.zeros(2**self.depth - 1)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = node - first
                best = np.full(count, 1e-9)
                where = [(-1, 0)] * count
                for j in range(width):
                    cell = at * most + codes[:, j]
                    sums = [np.bincount(cell, weights=w, minlength=count * most).reshape(count, most).cumsum(axis=1) for w in (g, h, np.ones(n))]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(nl < self.least) | (nt - nl < self.least)] = -1
                    k = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(count), k] > best):
                        best[i], where[i] = gain[i, k[i]], (j, int(k[i]))
                for i, (j, k) in enumerate(where):
                    if j >= 0:
                        feature[first + i], cut[first + i] = j, edges[j][k] if k < len(edges[j]) else np.inf
                node = self._down(x, node, feature, cut)
            leaf = node - (2**self.depth - 1)
            size = 2**self.depth
            value = self.rate * np.bincount(leaf, weights=g, minlength=size) / (np.bincount(leaf, weights=h, minlength=size) + self.ridge)
            self.model.append((feature, cut, value))
            score = score + value[leaf]
        return self

    @staticmethod
    def _down(x: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """One level down; a node without a feature sends all to the left."""
        f = feature[node]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] >= cut[node])
        return 2 * node + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.model:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = self._down(x, node, feature, cut)
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


class Isotonic:
    """Least-squares monotone fit by pooling adjacent violators; between knots it is linear."""

    def __init__(self):
        self.at, self.to = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def fit(self, p: np.ndarray, y: np.ndarray) -> Isotonic:
        if len(p) == 0:
            return self
        values, inverse = np.unique(p, return_inverse=True)
        weight = np.bincount(inverse).astype(float)
        mean = np.bincount(inverse, weights=y) / weight
        blocks: list[list[float]] = []  # mean, weight, first, last
        for v, m, w in zip(values, mean, weight, strict=True):
            blocks.append([m, w, v, v])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, _, last = blocks.pop()
                m1, w1, first, _ = blocks.pop()
                blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
        self.at = np.array([x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
        self.to = np.array([b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
        return self

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, self.at, self.to)
