"""Follow-the-regularised-leader training of sparse (multinomial) logistic regression, with elastic-net penalties."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Weights of `size` features (and a bias, kept apart and not penalised) for `classes` classes.

    Per coordinate, learning rates fall as alpha / (beta + root of the summed squared
    gradients); l1 keeps small weights at exactly zero, l2 shrinks the others.
    """

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Weights of the given rows; the last row is the bias."""
        z, n = self.z[rows], self.n[rows]
        bias = (np.arange(len(self.z))[rows] == len(self.z) - 1)[:, None]
        l1, l2 = np.where(bias, 0.0, self.l1), np.where(bias, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def step(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        rows, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        more = self.n[rows] + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(self.n[rows])) / self.alpha * w
        self.n[rows] = more

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.step(*rows[i])
        return self


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss of logits / temperature over rows that were not trained on; 1 without rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
