"""Gradient-boosted regression trees and isotonic calibration, on numpy arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Squared-loss boosting of small trees over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(y) else []
        self.base = float(np.average(y, weights=weight)) if len(y) else 0.0
        self.trees = []
        if not len(y):
            return self
        binned = self._bin(x)
        guess = np.full(len(y), self.base)
        for _ in range(self.rounds):
            tree = self._grow(binned, y - guess, weight)
            self.trees.append(tree)
            guess += self.rate * self._apply(tree, binned)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.trees and len(x):
            binned = self._bin(x)
            for tree in self.trees:
                out += self.rate * self._apply(tree, binned)
        return out

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, x: np.ndarray, r: np.ndarray, w: np.ndarray) -> list:
        """A heap of (feature, bin) splits and leaf means."""
        size = 2 ** (self.depth + 1)
        feature, cut, mean = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.ones(len(r), int)
        for k in range(1, size):
            mine = node == k
            if not mine.any():
                continue
            mean[k] = np.average(r[mine], weights=w[mine])
            if k >= size // 2 or mine.sum() < 2 * self.least:
                continue
            best, rows, target, weight = 1e-12, x[mine], r[mine] * w[mine], w[mine]
            whole, mass = target.sum(), weight.sum()
            for f in range(x.shape[1]):
                n = len(self.edges[f]) + 1
                s = np.bincount(rows[:, f], target, n).cumsum()[:-1]
                m = np.bincount(rows[:, f], weight, n).cumsum()[:-1]
                c = np.bincount(rows[:, f], minlength=n).cumsum()[:-1]
                ok = (c >= self.least) & (len(rows) - c >= self.least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, s**2 / m + (whole - s) ** 2 / (mass - m) - whole**2 / mass, -1)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, feature[k], cut[k] = gain[at], f, at
            if feature[k] >= 0:
                node[mine] = 2 * k + (rows[:, feature[k]] > cut[k])
        return [feature, cut, mean]

    def _apply(self, tree: list, x: np.ndarray) -> np.ndarray:
        feature, cut, mean = tree
        node = np.ones(len(x), int)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + right, node)
        return mean[node]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing function of x (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots = [(e, s / n) for s, n, lo, hi in blocks for e in ((lo, hi) if lo < hi else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])
