"""Gradient-boosted trees for yes-or-no labels over dense features, in heap-ordered arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss; splits between quantiles of each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    cuts = np.full((width, bins), np.inf)
    slot = np.empty((n, width), np.int64)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
        slot[:, f] = np.searchsorted(e, x[:, f], side="left") + f * bins
    nodes = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, nodes), np.int64)
    cut = np.full((trees, nodes), np.inf)
    value = np.zeros((trees, nodes))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    logit = np.full(n, start)
    row = np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        slope, curve = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            key = (slot + ((at - first) * (width * bins))[:, None]).ravel()
            shape = (many, width, bins)
            size = many * width * bins
            s = np.bincount(key, np.repeat(slope, width), size).reshape(shape).cumsum(2)
            c = np.bincount(key, np.repeat(curve, width), size).reshape(shape).cumsum(2)
            all_s, all_c = s[:, :1, -1:], c[:, :1, -1:]
            gain = s**2 / (c + 1) + (all_s - s) ** 2 / (all_c - c + 1) - all_s**2 / (all_c + 1)
            gain[:, ~np.isfinite(cuts)] = 0
            best = gain.reshape(many, -1).argmax(1)
            here = slice(first, first + many)
            feature[t, here] = best // bins
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            cut[t, here] = np.where(split, cuts[best // bins, best % bins], np.inf)
            at = 2 * at + 1 + (x[row, feature[t, at]] > cut[t, at])
        s = np.bincount(at, slope, nodes)
        c = np.bincount(at, curve, nodes)
        value[t] = rate * s / (c + 1)
        logit += value[t][at]
    return Trees(feature, cut, value, start)
