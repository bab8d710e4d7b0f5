"""Learning from positives and unlabelled rows: class prior and non-negative unbiased risk. Numpy only."""

from __future__ import annotations

import numpy as np

from .training import logistic, sigmoid


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled rows: best bin estimate.

    A classifier of positive against unlabelled is fitted on half of either; on the other
    half the share of unlabelled rows above a threshold, over that of positives, is at least
    the prior for every threshold, and equals it where no negatives score. The threshold is
    the one with the least upper confidence bound.
    """
    p, u = positive[::2], unlabelled[::2]
    if not len(p) or not len(u) or len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    w = logistic(np.vstack([p, u]), np.r_[np.ones(len(p)), np.zeros(len(u))])
    sp = np.sort(positive[1::2] @ w[:-1] + w[-1])
    su = np.sort(unlabelled[1::2] @ w[:-1] + w[-1])
    at = np.concatenate([sp, su])
    qp = 1 - np.searchsorted(sp, at, "left") / len(sp)
    qu = 1 - np.searchsorted(su, at, "left") / len(su)
    some = qp > 0.01
    slack = np.sqrt(np.log(4 / delta) / (2 * len(su))) + np.sqrt(np.log(4 / delta) / (2 * len(sp)))
    bound = (qu[some] + (1 + gamma) * slack) / qp[some]
    k = int(np.argmin(bound))
    return float(np.clip(qu[some][k] / qp[some][k], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for the constant, that minimise the non-negative risk under logistic loss.

    Risk: prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). Where the second part
    turns negative, the step is against it alone, as it must not be fitted below zero.
    """
    p, u = np.column_stack([positive, np.ones(len(positive))]), np.column_stack([unlabelled, np.ones(len(unlabelled))])
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        fp, fu = p @ w, u @ w
        as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_neg = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        g = -prior * (p.T @ sigmoid(-fp)) / len(p) + g_neg if as_negative >= 0 else -g_neg
        g = g + ridge * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
