"""Histogram gradient-boosted trees for two classes in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Node i sends rows whose feature[i] is at most threshold[i] to left[i], others to right[i]; leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row, all trees at once."""
        if len(x) == 0:
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def trees(self) -> list[int]:
        return self.roots.tolist()


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 8.0, penalty: float = 1.0) -> Forest:
    """Newton boosting on the logistic loss; splits are at quantiles of the sample."""
    x = np.asarray(x, np.float64)
    y = np.asarray(y, np.float64)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: at most cuts[b]
    flat = binned + np.arange(k) * BINS
    rate_of = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of / (1 - rate_of)))
    f = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(0.0)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        root = node()
        roots.append(root)
        open_nodes = [(root, np.arange(n), 0)]
        while open_nodes:
            i, rows, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and w[rows].sum() >= 2 * least:
                idx = flat[rows].ravel()
                gl = np.cumsum(np.bincount(idx, np.repeat(g[rows], k), BINS * k).reshape(k, BINS), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(idx, np.repeat(h[rows], k), BINS * k).reshape(k, BINS), axis=1)[:, :-1]
                wl = np.cumsum(np.bincount(idx, np.repeat(w[rows], k), BINS * k).reshape(k, BINS), axis=1)[:, :-1]
                gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                gain[(wl < least) | (w[rows].sum() - wl < least)] = -1
                j, b = divmod(int(gain.argmax()), BINS - 1)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    best = j, b
            if best is None:
                value[i] = rate * gs / (hs + penalty)
                f[rows] += value[i]
                continue
            j, b = best
            feature[i], threshold[i] = j, float(cuts[j][b])
            low = binned[rows, j] <= b
            left[i], right[i] = node(), node()
            open_nodes += [(left[i], rows[low], level + 1), (right[i], rows[~low], level + 1)]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)
