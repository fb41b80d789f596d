"""Gradient-boosted trees for a logistic loss, small enough to train on a bounded sample and to send with a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class BoostedTrees:
    """Complete binary trees as arrays: feature and cut of each inner node, value of each leaf."""

    depth: int = 4
    base: float = 0.0
    features: list = field(default_factory=list)
    cuts: list = field(default_factory=list)
    leaves: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += v[at - (len(v) - 1)]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0, weights: np.ndarray | None = None) -> BoostedTrees:
    """Second-order boosting; cuts are sought among quantiles of each feature, all nodes of a level at once."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])
    w = np.ones(n) if weights is None else weights
    p = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
    model = BoostedTrees(depth, float(np.log(p / (1 - p))))
    z = np.full(n, model.base)
    for _ in range(rounds):
        q = _sigmoid(z)
        g, h = w * (q - y), w * np.maximum(q * (1 - q), 1e-6)
        inner = (1 << depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            best = np.zeros(width)
            for j in range(d):
                if not len(edges[j]):
                    continue
                slots = len(edges[j]) + 1
                key = node * slots + code[j]
                gs = np.bincount(key, g, minlength=width * slots).reshape(width, slots).cumsum(1)
                hs = np.bincount(key, h, minlength=width * slots).reshape(width, slots).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = edges[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(value)
        z += value[leaf]
    return model
