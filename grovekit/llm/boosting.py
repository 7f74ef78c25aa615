"""Gradient-boosted trees with logistic loss, and their calibration, in NumPy."""

from __future__ import annotations

import numpy as np


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class BoostedTrees:
    """Trees of fixed depth on binned features; ``fit`` is deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.l2, self.bins = trees, depth, rate, l2, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.int32) if len(x) else np.zeros(x.shape, np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, d = x.shape
        self.edges = [(u[1:] + u[:-1]) / 2 if len(u := np.unique(x[:, j])) <= self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = self._binned(x)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), self.bins + 1, np.int32)
        self.leaf = np.zeros((self.trees, inner + 1))
        width = self.bins + 1
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int32)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                if len(at):
                    gs, hs = g[at].sum(), h[at].sum()
                    best = 1e-9
                    for j in range(d):
                        c = b[at, j]
                        gl, hl = np.cumsum(np.bincount(c, g[at], width)), np.cumsum(np.bincount(c, h[at], width))
                        gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, self.feature[t, k], self.cut[t, k] = gain[i], j, i
                node[at] = 2 * k + 1 + (b[at, self.feature[t, k]] > self.cut[t, k])
            node -= inner
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.leaf[t] = self.rate * gs / (hs + self.l2)
            score += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


class Calibrated:
    """Boosted trees whose scores are turned into probabilities on held-out rows, with the threshold of the best F there, in which
    recall weighs ``beta`` times as much as precision."""

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, beta: float = 1.0) -> "Calibrated":
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        s, t = self.trees.score(x[held]), y[held]
        a, c = 1.0, 0.0
        smooth = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        for _ in range(50):  # Newton's method for the two parameters
            p = _logistic(a * s + c)
            g = np.array([((smooth - p) * s).sum(), (smooth - p).sum()])
            w = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, c = a + step[0], c + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.a, self.c = float(a), float(c)
        p = self.probability(x[held])
        grid = np.linspace(0.05, 0.95, 19)
        f = [(1 + beta**2) * ((p >= g) & (t == 1)).sum() / max(1, (p >= g).sum() + beta**2 * (t == 1).sum()) for g in grid]
        best = np.flatnonzero(np.array(f) >= max(f) - 1e-12)
        self.threshold = float(grid[best[len(best) // 2]])
        self.best = float(max(f))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.a * self.trees.score(x) + self.c)
