"""A two-state linear-chain conditional random field on NumPy.

The score of a labelling y is the sum of emission scores s_t at the places with y_t = 1 and of transition scores
A[y_t, y_t+1]; the start scores equal A[0]. Only odds matter, so each message is one number: the forward message
f_t = s_t + g(f_t-1) and the backward message b_t = h(s_t+1 + b_t+1) are log odds of state 1 to state 0, and the
marginal of place t is sigmoid(f_t + b_t). Sequences of any lengths run together, place by place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Steps:
    """For each place, the positions of the sequences that reach it, longest first."""

    starts: np.ndarray
    lengths: np.ndarray
    alive: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, lengths: np.ndarray) -> Steps:
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        ordered = lengths[order]
        most = int(ordered[0]) if len(ordered) else 0
        alive = np.searchsorted(-ordered, -np.arange(1, most + 1), side="right")
        return cls(starts[order], ordered, alive)


def messages(scores: np.ndarray, steps: Steps, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    forward, backward = np.empty(len(scores)), np.zeros(len(scores))
    before = None
    for t, n in enumerate(steps.alive.tolist()):
        at = steps.starts[:n] + t
        if t:
            e = before[:n]
            before = scores[at] + np.logaddexp(move[0, 1], move[1, 1] + e) - np.logaddexp(move[0, 0], move[1, 0] + e)
        else:
            before = scores[at] + (move[0, 1] - move[0, 0])
        forward[at] = before
    after = np.zeros(0)
    for t in range(len(steps.alive) - 1, 0, -1):
        n = int(steps.alive[t])
        at = steps.starts[:n] + t
        e = scores[at]
        e[: len(after)] += after
        after = np.logaddexp(move[1, 0], move[1, 1] + e) - np.logaddexp(move[0, 0], move[0, 1] + e)
        backward[at - 1] = after
    return forward, backward


def marginals(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The probability of state 1 at every place of the sequences laid end to end."""
    if not len(scores):
        return np.zeros(0)
    forward, backward = messages(scores, Steps.of(lengths), move)
    return sigmoid(forward + backward)


def _pairs(scores: np.ndarray, forward: np.ndarray, backward: np.ndarray, inner: np.ndarray, move: np.ndarray, part: int = 200_000) -> np.ndarray:
    """Expected counts of the four moves over all neighbours, part by part; inner: places that have a successor."""
    total = np.zeros(4)
    for low in range(0, len(inner), part):
        here = inner[low : low + part]
        f, e = forward[here], scores[here + 1] + backward[here + 1]
        logs = np.stack([np.full(len(f), move[0, 0]), move[0, 1] + e, move[1, 0] + f, move[1, 1] + f + e])
        logs -= logs.max(axis=0)
        np.exp(logs, out=logs)
        total += (logs / logs.sum(axis=0)).sum(axis=1)
    return total.reshape(2, 2)


def fit(
    emit, spread, size: int, labels: np.ndarray, lengths: np.ndarray, rounds: int, rate: float, decay: float, place_weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, move) by gradient ascent with per-weight steps on the mean conditional log likelihood.

    emit(weights) gives the emission scores of all places; spread(residuals) carries residuals of places back to the
    weights. labels are 0/1 per place."""
    steps = Steps.of(lengths)
    ends = np.cumsum(lengths)
    inner = np.ones(len(labels), bool)
    inner[ends[np.asarray(lengths) > 0] - 1] = False
    inner = np.flatnonzero(inner)
    firsts = (ends - lengths)[np.asarray(lengths) > 0]
    weights, move = np.zeros(size), np.zeros((2, 2))
    seen_w, seen_m = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    truth = np.zeros((2, 2))
    np.add.at(truth, (labels[inner], labels[inner + 1]), 1)
    np.add.at(truth[0], labels[firsts], 1)
    total = max(len(labels), 1)
    for _ in range(rounds):
        scores = emit(weights)
        forward, backward = messages(scores, steps, move)
        p = sigmoid(forward + backward)
        grad_w = spread(labels - p) / total - decay * weights
        expected = _pairs(scores, forward, backward, inner, move)
        expected[0] += (1 - p[firsts]).sum(), p[firsts].sum()
        grad_m = (truth - expected) / total - decay * move
        seen_w += grad_w**2
        seen_m += grad_m**2
        weights = weights + rate * grad_w / np.sqrt(seen_w)
        move = move + rate * grad_m / np.sqrt(seen_m)
    return weights, move


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50, decay: float = 1e-3) -> np.ndarray:
    """Newton's method for a small weighted logistic regression; the last coefficient is the intercept."""
    x = np.column_stack([features, np.ones(len(features))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        slope = x.T @ (weights * (labels - p)) - decay * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + decay * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
