"""Small gradient-boosted trees and logistic regression, fitted in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of depth 2 over quantile cuts."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, cuts: int = 24, smooth: float = 1.0):
        self.rounds, self.rate, self.cuts, self.smooth = rounds, rate, cuts, smooth
        self.base, self.trees = 0.0, []

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, grid: list[np.ndarray]) -> tuple[int, float] | None:
        best, at = 1e-9, None
        total = g.sum() ** 2 / (h.sum() + self.smooth)
        for f, points in enumerate(grid):
            for c in points:
                left = x[:, f] <= c
                hl = h[left].sum()
                hr = h.sum() - hl
                if min(left.sum(), (~left).sum()) < 4:
                    continue
                gl = g[left].sum()
                gain = gl**2 / (hl + self.smooth) + (g.sum() - gl) ** 2 / (hr + self.smooth) - total
                if gain > best:
                    best, at = gain, (f, float(c))
        return at

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p0 = min(0.999, max(0.001, y.mean()))
        self.base = float(np.log(p0 / (1 - p0)))
        s = np.full(len(y), self.base)
        grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts)))[:-1] for f in range(x.shape[1])]
        leaf = lambda g, h: float(self.rate * g.sum() / (h.sum() + self.smooth))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-s))
            g, h = y - p, p * (1 - p)
            top = self._split(x, g, h, grid)
            if top is None:
                break
            tree: list = [top]
            for side in (x[:, top[0]] <= top[1], x[:, top[0]] > top[1]):
                low = self._split(x[side], g[side], h[side], grid)
                if low is None:
                    tree.append((None, leaf(g[side], h[side])))
                    s[side] += tree[-1][1]
                else:
                    left = side & (x[:, low[0]] <= low[1])
                    right = side & ~left
                    tree.append((low, leaf(g[left], h[left]), leaf(g[right], h[right])))
                    s[left] += tree[-1][1]
                    s[right] += tree[-1][2]
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for top, *sides in self.trees:
            first = x[:, top[0]] <= top[1]
            for where, side in zip((first, ~first), sides):
                s += np.where(where, side[1] if side[0] is None else np.where(x[:, side[0][0]] <= side[0][1], side[1], side[2]), 0)
        return 1 / (1 + np.exp(-s))


class Logistic:
    """Weights by Newton steps with a ridge."""

    def __init__(self, ridge: float = 0.1):
        self.ridge, self.w = ridge, np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 25) -> Logistic:
        a = np.hstack([np.ones((len(x), 1)), x])
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hess = (a * (p * (1 - p))[:, None]).T @ a + self.ridge * np.eye(len(w))
            move = np.linalg.solve(hess, a.T @ (y - p) - self.ridge * w)
            w += move
            if np.abs(move).max() < 1e-6:
                break
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.w[0] + x @ self.w[1:], -30, 30)))
