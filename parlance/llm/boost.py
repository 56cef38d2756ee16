"""Gradient-boosted trees for yes-or-no decisions, small enough to ride with a task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of small depth, exact splits. Deterministic for the same rows in the same order."""

    def __init__(self, rounds: int = 40, rate: float = 0.4, least: int = 4, depth: int = 2):
        self.rounds, self.rate, self.least, self.depth = rounds, rate, least, depth
        self.base, self.trees = 0.0, []

    def _best(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-9, None
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= self.least) & (len(v) - at - 1 >= self.least)]
            if len(at):
                gain = cg[at] ** 2 / (ch[at] + 1.0) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1.0) - whole
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, found = gain[i], (f, float((v[at[i]] + v[at[i] + 1]) / 2))
        return found

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        split = self._best(x, g, h) if depth and len(x) >= 2 * self.least else None
        if split is None:
            return float(self.rate * g.sum() / (h.sum() + 1.0))
        left = x[:, split[0]] <= split[1]
        return (*split, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, at, low, high = tree
        return np.where(x[:, f] <= at, self._apply(low, x), self._apply(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        score = np.full(len(x), self.base)
        for t in self.trees:
            score += self._apply(t, x)
        return 1 / (1 + np.exp(-score))
