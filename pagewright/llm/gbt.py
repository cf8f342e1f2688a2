"""Gradient-boosted trees on binned dense features, in NumPy, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node k has the children 2k + 1 and 2k + 2."""

    depth: int
    prior: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    flat = code + np.arange(d) * width
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    prior = float(np.log(p0 / (1 - p0)))
    f, inner = np.full(n, prior), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (d * width) + flat).ravel()
            G = np.bincount(where, np.repeat(g, d), k * d * width).reshape(k, d, width)
            H = np.bincount(where, np.repeat(h, d), k * d * width).reshape(k, d, width)
            gl, hl = G.cumsum(2)[:, :, :-1], H.cumsum(2)[:, :, :-1]
            gt, ht = G.sum(2)[:, :1, None], H.sum(2)[:, :1, None]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(k, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), width - 1)
                if gain[i, j, c] > 1e-6 and c < len(cuts[j]):
                    feature[t, first + i], cut[t, first + i] = j, cuts[j][c]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        at -= inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        f += leaf[t, at]
    return Trees(depth, prior, feature, cut, leaf)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the best non-decreasing fit."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, s2 = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, (pools[-1][2] * pools[-1][1] + s2 * n2) / (pools[-1][1] + n2)]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])
