"""Follow-the-regularised-leader learners over sparse rows, trained apart on shards and averaged."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rates:
    """alpha, beta: the step size of a weight; l1, l2: the elastic-net penalties.

    Rows are gone over until there were `updates` of them, at least `epochs` and at most `epochs_most` times.
    """

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 3
    epochs_most: int = 30
    updates: int = 9_000


def _weights(z: np.ndarray, n: np.ndarray, r: Rates) -> np.ndarray:
    w = -(z - np.sign(z) * r.l1) / ((r.beta + np.sqrt(n)) / r.alpha + r.l2)
    return np.where(np.abs(z) <= r.l1, 0.0, w)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, rates: Rates) -> np.ndarray:
    """Weights (classes, size + 1) after the epochs; the last column is the bias.

    rows: (indices, values, class), in the order of learning. Two classes learn one logistic row (of class 1), more
    learn a softmax over one row each.
    """
    k = 1 if classes == 2 else classes
    z, n = np.zeros((k, size + 1)), np.zeros((k, size + 1))
    for _ in range(min(max(rates.epochs, -(-rates.updates // max(len(rows), 1))), rates.epochs_most)):
        for at, values, label in rows:
            at, values = np.append(at, size), np.append(values, 1.0)
            w = _weights(z[:, at], n[:, at], rates)
            error = probabilities(w @ values)
            error[label if k > 1 else 0] -= 1.0 if k > 1 else float(label)
            gradient = error[:, None] * values[None, :]
            square = gradient * gradient
            z[:, at] += gradient - (np.sqrt(n[:, at] + square) - np.sqrt(n[:, at])) / rates.alpha * w
            n[:, at] += square
    return _weights(z, n, rates)


def probabilities(logits: np.ndarray) -> np.ndarray:
    """The logistic of one logit, or the softmax of several (along the first axis)."""
    if len(logits) == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))
    e = np.exp(logits - logits.max(axis=0))
    return e / e.sum(axis=0)
