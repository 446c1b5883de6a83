"""Gradient-boosted symmetric trees with logistic loss, on histograms.

Fitted on the driver from a bounded sample; a model is a few kilobytes of
thresholds and leaf values, and scoring is vectorised.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Each tree asks one (feature, threshold) question for each level."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Learn P(y = 1); without rows of both classes only the base rate."""
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1.0)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if n < 2 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        raw = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            leaf, asked = np.zeros(n, np.int64), []
            for level in range(self.depth):
                best = (1e-9, None, None)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    width = len(e) + 1
                    cell = leaf * width + codes[f]
                    g = np.bincount(cell, grad, (1 << level) * width).reshape(-1, width)
                    h = np.bincount(cell, hess, (1 << level) * width).reshape(-1, width)
                    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    gs, hs = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gain = (gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)).sum(0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                if best[1] is None:
                    break
                _, f, k = best
                asked.append((f, float(edges[f][k])))
                leaf |= (codes[f] > k).astype(np.int64) << level
            if not asked:
                break
            g, h = np.bincount(leaf, grad, 1 << len(asked)), np.bincount(leaf, hess, 1 << len(asked))
            value = self.rate * g / (h + self.ridge)
            self.trees.append((asked, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for asked, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for level, (f, edge) in enumerate(asked):
                leaf |= (x[:, f] > edge).astype(np.int64) << level
            out += value[leaf]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(y = 1) for each row of features."""
        return 1 / (1 + np.exp(-self.raw(x)))
