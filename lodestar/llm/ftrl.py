"""Follow-the-regularised-leader (proximal) with per-coordinate rates, L1 and L2 penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of one or more linear outputs over hashed features; state is held by coordinate, weights follow from it.

    w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).
    """

    def __init__(self, size: int, outputs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, outputs)), np.zeros((size, outputs))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, w: np.ndarray, grad: np.ndarray) -> None:
        """at: distinct coordinates; w: their weights() now; grad: the loss's gradient there."""
        n, square = self.n[at], grad * grad
        self.z[at] += grad - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
