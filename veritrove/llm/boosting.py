"""Gradient-boosted trees for a yes/no question, in numpy: small, and trained where they are used."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of ``depth`` levels over binned features, fitted to the logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 4.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit to rows ``x`` with answers ``y`` (0 or 1)."""
        self.edges = []
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            middle = (values[1:] + values[:-1]) / 2
            self.edges.append(middle if len(middle) < self.bins else np.unique(np.quantile(middle, np.linspace(0, 1, self.bins - 1))))
        b = self._binned(x)
        width = self.bins + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature = np.full(2**self.depth - 1, -1)
            cut = np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                low, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                here = node - low
                for k in range(x.shape[1]):
                    at = here * width + b[:, k]
                    gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    cs = np.bincount(at, minlength=n * width).reshape(n, width).cumsum(1)
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(cs < self.least) | (ct - cs < self.least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(n), top] > best
                    best[better] = gain[np.arange(n), top][better]
                    feature[low : low + n][better] = k
                    cut[low : low + n][better] = top[better]
                f = feature[node]
                right = (f >= 0) & (b[np.arange(len(y)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes for each row."""
        b = self._binned(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (b[rows, np.maximum(f, 0)] > cut[node]))
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
