"""Histogram gradient-boosted trees for yes/no labels, kept as flat arrays, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth as complete binary trees: row t holds the inner nodes or leaves of tree t.

    A row of values goes left where its value is at or below the node's threshold; NaN goes left.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaves for all rows: every level of every tree is one numpy step over the rows."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            out += self.leaf[t, node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, leaf_weight: float = 1.0, ridge: float = 1.0) -> Forest:
    """Boost logistic loss by Newton steps; splits are searched on histograms of at most ``bins`` quantile bins.

    No rows, or labels of one kind only, give a forest that answers their share everywhere.
    """
    n, f = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = []
    code = np.zeros((n, f), np.int64)
    for j in range(f):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        edges.append(e)
        code[:, j] = np.searchsorted(e, x[:, j], "left")
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    column = np.arange(f) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = ((node - first)[:, None] * (f * bins) + column + code).ravel()
            size = width * f * bins
            gs = np.bincount(at, np.repeat(g, f), size).reshape(width, f, bins)
            hs = np.bincount(at, np.repeat(h, f), size).reshape(width, f, bins)
            gl, hl = np.cumsum(gs, 2), np.cumsum(hs, 2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < leaf_weight) | (ht - hl < leaf_weight)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for w in np.nonzero(gain.reshape(width, -1).max(1) > 1e-6)[0]:
                j, b = divmod(int(best[w]), bins)
                if b < len(edges[j]):
                    feature[first + w], threshold[first + w] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)


def held_out(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **options) -> np.ndarray:
    """Margins of every row by a forest that has not seen the row's fold."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        out[fold == k] = fit(x[fold != k], y[fold != k], **options).margin(x[fold == k])
    return out


@dataclass
class Isotonic:
    """A rising step function through pooled means, straight between them and flat beyond."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value) if len(self.at) else 1 / (1 + np.exp(-margin))


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each block's value is (yes + 1/2) / (rows + 1), so no score is quite 0 or 1."""
    blocks: list[list[float]] = []
    for m, label in sorted(zip(margin.tolist(), y.tolist())):
        blocks.append([m, 1.0, float(label)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            m2, n2, s2 = blocks.pop()
            m1, n1, s1 = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, s1 + s2])
    value = [(s + 0.5) / (n + 1) for _, n, s in blocks]
    return Isotonic(np.array([b[0] for b in blocks]), np.maximum.accumulate(np.array(value)) if blocks else np.array([]))
