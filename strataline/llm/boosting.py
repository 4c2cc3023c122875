"""Gradient boosted trees on small integer features, trained on the driver on a bounded table, scored as SQL CASE."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """A split (feature, threshold, left if value <= threshold, right), or a leaf value."""

    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.score(x), self.right.score(x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, smooth: float) -> Tree:
    leaf = Tree(value=round(-rate * float(g.sum() / (h.sum() + smooth)), 6))
    if depth == 0 or len(x) < 20:
        return leaf
    best, base = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + smooth)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            go = x[:, f] <= t
            gl, hl = g[go].sum(), h[go].sum()
            gain = gl**2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth) - base
            if gain > best[0]:
                best = (gain, f, float(t))
    _, f, t = best
    if f < 0:
        return leaf
    go = x[:, f] <= t
    return Tree(f, t, _grow(x[go], g[go], h[go], depth - 1, rate, smooth), _grow(x[~go], g[~go], h[~go], depth - 1, rate, smooth))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, smooth: float = 1.0) -> list[Tree]:
    """Trees whose sum is the log odds of y."""
    score, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), depth, rate, smooth)
        out.append(tree)
        score += tree.score(x)
    return out


def total(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.score(x) for t in trees), np.zeros(len(x)))


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest log odds at and above which held-out rows are right with this precision, calibrated without gaps; infinite if none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[scores[order][1:] != scores[order][:-1], True]
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else float("inf")
