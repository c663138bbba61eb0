"""Gradient-boosted trees on a small table: histogram splits, logistic loss, monotonic
constraints, and the trees flattened into arrays for vectorised scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees, node k's children at 2k+1 and 2k+2.

    ``feature`` is -1 at a leaf that ended early: such a node sends rows left, and
    both children hold its value.
    """

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                right = (f >= 0) & (x[rows, np.maximum(f, 0)] > threshold[node])
                node = 2 * node + 1 + right
            out += value[node - (value.size - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 64, ridge: float = 1.0) -> Forest:
    """Fit to labels 0/1.  ``monotone`` maps a feature to +1 or -1: the log-odds never
    fall, or never rise, with it.
    """
    monotone = monotone or {}
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, 0), np.int64)
    margin, made = np.full(len(x), base), []
    for _ in range(trees if len(x) and y.min() != y.max() else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        lo, hi = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = None
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if len(rows) < 2 or not len(c):
                    continue
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(c) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                left = np.clip(gl / (hl + ridge), lo[k], hi[k])
                right = np.clip(gr / (hr + ridge), lo[k], hi[k])
                gain = 2 * (gl * left + gr * right) - (hl + ridge) * left**2 - (hr + ridge) * right**2
                gain[(hl < 1) | (hr < 1)] = -np.inf
                if sign := monotone.get(j):
                    gain[sign * (right - left) < 0] = -np.inf
                at = int(np.argmax(gain))
                if np.isfinite(gain[at]) and (best is None or gain[at] > best[0]):
                    best = (gain[at], j, at, left[at], right[at])
            kids = (2 * k + 1, 2 * k + 2)
            lo[list(kids)], hi[list(kids)] = lo[k], hi[k]
            own = np.clip(gs / (hs + ridge), lo[k], hi[k])
            if best is None or best[0] <= 2 * gs * own - (hs + ridge) * own**2 + 1e-9:
                node[rows] = kids[0]
                continue
            _, j, at, left, right = best
            feature[k], threshold[k] = j, cuts[j][at]
            if sign := monotone.get(j):
                middle = (left + right) / 2
                up, down = (kids[1], kids[0]) if sign > 0 else (kids[0], kids[1])
                lo[up], hi[down] = max(lo[up], middle), min(hi[down], middle)
            node[rows] = np.where(code[rows, j] > at, kids[1], kids[0])
        at = node - inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        value = rate * np.clip(gs / (hs + ridge), lo[inner:], hi[inner:])
        margin = margin + value[at]
        made.append((feature, threshold, value))
    empty = (np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    f, t, v = (np.array(a) for a in zip(*made, strict=True)) if made else empty
    return Forest(base, f, t, v)
