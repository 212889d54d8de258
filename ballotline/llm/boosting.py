"""Gradient-boosted trees for two classes, on histograms, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of fixed depth as flat arrays: feature and threshold for each inner node, value for each leaf."""

    def __init__(self, depth: int = 4, trees: int = 80, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0, share: float = 0.4, seed: int = 1) -> None:
        self.depth, self.trees, self.rate, self.ridge, self.least, self.share, self.seed = depth, trees, rate, ridge, least, share, seed

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        bins = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(f)], 1)
        mean = np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature, self.cut, self.value = np.zeros((self.trees, inner), int), np.full((self.trees, inner), np.inf), np.zeros((self.trees, leaves))
        score = np.full(n, self.base)
        rnd, of = np.random.default_rng(self.seed), max(1, round(f * self.share))
        for t in range(self.trees):
            # each tree sees a share of the features
            mine_f = np.sort(rnd.choice(f, of, replace=False))
            flat = bins[:, mine_f] + np.arange(of) * BINS
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node = np.zeros(n, int)
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * (of * BINS) + flat).ravel()
                gs = np.bincount(at, np.repeat(g, of), k * of * BINS).reshape(k, of, BINS).cumsum(2)
                hs = np.bincount(at, np.repeat(h, of), k * of * BINS).reshape(k, of, BINS).cumsum(2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                gain[(hs < self.least) | (ha - hs < self.least)] = -1
                best = gain.reshape(k, -1).argmax(1)
                go = np.zeros(n, bool)
                for j in range(k):
                    column, b = divmod(int(best[j]), BINS)
                    feature = int(mine_f[column])
                    if gain[j, column, b] <= 1e-9 or b >= len(cuts[feature]):
                        continue
                    i = k - 1 + j
                    self.feature[t, i], self.cut[t, i] = feature, cuts[feature][b]
                    mine = node == j
                    go[mine] = bins[mine, feature] > b
                node = node * 2 + go
            gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = -self.rate * gl / (hl + self.ridge)
            score += self.value[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = node * 2 + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out
