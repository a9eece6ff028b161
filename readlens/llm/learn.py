"""Follow-the-regularised-leader on sparse rows, and a temperature for the probabilities that come of it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ftrl:
    """Step size alpha, its smoothing beta, L1 and L2 penalties (elastic net), passes over the rows and their order's seed."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.5
    epochs: int = 3
    seed: int = 7


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, width: int, how: Ftrl) -> np.ndarray:
    """Weights (classes, width + 1) of a multinomial logistic regression; the last column is the bias and has no penalty.

    rows: (places, values) of each; targets: (rows, classes), each row's shares of the classes, which sum to 1.
    """
    classes = targets.shape[1]
    z, n = np.zeros((classes, width + 1)), np.zeros((classes, width + 1))
    l1 = np.full(width + 1, how.l1)
    l1[width] = 0
    rng = np.random.default_rng(how.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[:, at]
        return np.where(np.abs(own) <= l1[at], 0.0, (np.sign(own) * l1[at] - own) / ((how.beta + np.sqrt(n[:, at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for k in rng.permutation(len(rows)):
            at, x = np.append(rows[k][0], width), np.append(rows[k][1], 1.0)
            w = weights(at)
            g = (softmax(w @ x) - targets[k])[:, None] * x
            before = n[:, at]
            after = before + g * g
            z[:, at] += g - (np.sqrt(after) - np.sqrt(before)) / how.alpha * w
            n[:, at] = after
    return weights(np.arange(width + 1))


def logits(weights: np.ndarray, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return weights[:, row[0]] @ row[1] + weights[:, -1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """What to divide logits by for the least log loss on rows that took no part in the fit; golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    if not len(labels):
        return 1.0
    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
