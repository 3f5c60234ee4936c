"""Small logistic models that the classifiers train on bounded samples, on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60, ridge: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights (the intercept last) of a logistic regression on standardised x, by Newton's method. l2 grows with the rows,
    ridge (for each column) doesn't: what a few rows tell of a column counts little."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, weight = np.zeros(x1.shape[1]), np.ones(len(x)) if weight is None else weight
    ridge = np.append(l2 * max(1.0, weight.sum()) + np.broadcast_to(ridge, x.shape[1]), 1e-6)
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        h = (x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge)
        move = np.linalg.solve(h, x1.T @ (weight * (p - y)) + ridge * w)
        move *= min(1.0, 4 / max(1e-9, np.abs(move).max()))
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def score_dense(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Bag:
    """Sets of feature numbers as rows, for sparse sums."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], minlength=self.width)


def fit_bag(bag: Bag, y: np.ndarray, pairs: tuple[Bag, Bag] | None = None, penalty: float = 0.0, positive: float = 1.0, l2: float = 2e-4, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights (the intercept last) of a logistic regression on feature sets, by Adam; pairs: rows and their
    counterfactuals, whose difference in score is penalised by its square. positive: how much a row of label 1 weighs."""
    w, m, v = np.zeros(bag.width + 1), np.zeros(bag.width + 1), np.zeros(bag.width + 1)
    if bag.n:
        rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        w[-1] = np.log(rate0 / (1 - rate0))
    weight = np.where(y > 0, positive, 1.0)
    weight /= max(1e-9, weight.mean()) if bag.n else 1.0
    for t in range(1, steps + 1):
        g = weight * (sigmoid(bag.dot(w[:-1]) + w[-1]) - y)
        grad = np.append(bag.back(g) / max(1, bag.n) + l2 * w[:-1], g.mean() if bag.n else 0.0)
        if pairs is not None and pairs[0].n:
            a, b = pairs
            d = a.dot(w[:-1]) - b.dot(w[:-1])
            grad[:-1] += 2 * penalty / a.n * (a.back(d) - b.back(d))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
