"""A generative label model over many voters, and a linear classifier on its posteriors."""

from __future__ import annotations

import numpy as np

from . import linear


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def _balanced(scores: np.ndarray, share: float) -> float:
    """The intercept at which posteriors average ``share``."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sigmoid(scores + mid).mean() < share else (low, mid)
    return (low + high) / 2


def fit_posteriors(
    votes: np.ndarray, start: np.ndarray, share: float, rounds: int = 15, ridge: float = 0.02
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label for each row of ``votes`` (0/1, one column a voter).

    Expectation maximisation of two classes whose voters have rates of their
    own (accuracies) and a shared residual covariance (correlations): a voter
    that repeats another gains no weight. ``start`` holds first posteriors and
    ``share`` the share of the class. Returns posteriors, rates, correlations.
    """
    votes = votes.astype(np.float64)
    q = np.clip(start.astype(np.float64), 0.01, 0.99)
    n, m = votes.shape
    rates, cov = np.full((2, m), 0.5), np.eye(m)
    for _ in range(rounds):
        weight = np.stack([1 - q, q])
        rates = (weight @ votes + 0.5) / (weight.sum(axis=1, keepdims=True) + 1.0)
        cov = np.zeros((m, m))
        for k in (0, 1):
            centred = votes - rates[k]
            cov += (centred * weight[k][:, None]).T @ centred
        cov = cov / max(1, n) + ridge * np.eye(m)
        w = linear.solve(cov, rates[1] - rates[0])
        scores = votes @ w
        q = np.clip(sigmoid(scores + _balanced(scores, share)), 1e-3, 1 - 1e-3)
    spread = np.sqrt(np.diag(cov))
    return q, rates, cov / np.outer(spread, spread)


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression of soft labels ``y`` on ``x`` by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(penalty)
        step = linear.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
