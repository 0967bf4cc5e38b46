"""Gradient-boosted trees on binned features, in numpy.

Trees are complete, of one depth, and stored as flat arrays, so a batch of
millions of rows is scored by a few gathers for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """edges: bin borders of each feature; feature, border: trees x inner nodes; value: trees x leaves."""

    edges: list[np.ndarray]
    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        binned = binned_by(x, self.edges)
        rows, out = np.arange(len(x)), np.full(len(x), self.base, dtype=np.float32)
        depth = int(np.log2(self.value.shape[1]))
        for feature, border, value in zip(self.feature, self.border, self.value):
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(depth):
                at = 2 * at + 1 + (binned[feature[at], rows] > border[at])
            out += value[at - (value.shape[0] - 1)]
        return out


def binned_by(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """features x rows, a byte each."""
    out = np.empty((x.shape[1], x.shape[0]), dtype=np.uint8)
    for k, e in enumerate(edges):
        out[k] = np.searchsorted(e, x[:, k], side="left")
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 5, rate: float = 0.3, least: float = 20.0, ridge: float = 1.0) -> Boosted:
    """Fit by Newton steps of the logistic loss; least: hessian times four in a leaf."""
    n, width = x.shape
    w = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])).astype(x.dtype) if n else np.zeros(0, x.dtype) for k in range(width)]
    binned = binned_by(x, edges)
    p0 = min(max(float((w * y).sum() / max(w.sum(), 1e-9)), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, borders, values = [], [], []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        feature, border = np.zeros(inner, dtype=np.int32), np.full(inner, BINS, dtype=np.int32)
        wide: list[np.ndarray] = []  # of each feature: sums of g and h by node and bin
        for d in range(depth):
            nodes, first = 2**d, 2**d - 1
            local = at - first
            # sums are taken over left children only; those of right ones are what is left of their parents'
            rows = np.flatnonzero(local % 2 == 0) if d else np.arange(n)
            half, g_rows, h_rows = local[rows] // 2 if d else local, g[rows], h[rows]
            size = max(1, nodes // 2) * BINS
            best = np.full(nodes, 1e-6)
            narrow = []
            for k in range(width):
                key = half * BINS + binned[k][rows]
                sums = np.stack([np.bincount(key, g_rows, size), np.bincount(key, h_rows, size)]).reshape(2, -1, BINS)
                narrow.append(np.stack([sums, wide[k] - sums], axis=2).reshape(2, nodes, BINS) if d else sums)
            wide = narrow
            gt, ht = wide[0].sum(axis=2) if width else (np.zeros(nodes), np.zeros(nodes))
            whole = gt**2 / (ht + ridge)
            for k in range(width):
                gl, hl = np.cumsum(wide[k], axis=2)[:, :, :-1]
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole[:, None]
                gain[(hl < least / 4) | (hr < least / 4)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > best
                best = np.where(better, gain[np.arange(nodes), top], best)
                feature[first : first + nodes][better] = k
                border[first : first + nodes][better] = top[better]
            at = 2 * at + 1 + (binned[feature[at], np.arange(n)] > border[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        f += value[leaf]
        features.append(feature)
        borders.append(border)
        values.append(value.astype(np.float32))
    shape = (len(features), -1)
    if not features:
        return Boosted(edges, np.zeros((0, 1), np.int32), np.zeros((0, 1), np.int32), np.zeros((0, 2), np.float32), base)
    return Boosted(edges, np.array(features).reshape(shape), np.array(borders).reshape(shape), np.array(values).reshape(shape), base)
