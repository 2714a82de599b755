"""Small numeric solvers for one group at a time."""

from __future__ import annotations

import numpy as np


def newton_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with an L2 penalty on the coefficients (strength 1 / c) and a free intercept."""
    if len(np.unique(y)) < 2:
        raise ValueError("a logistic fit needs both classes")
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.r_[np.full(x.shape[1], 1.0 / c), 0.0]
    w = np.zeros(z.shape[1])

    def loss(w):
        m = z @ w
        return weight @ (np.logaddexp(0, m) - y * m) + 0.5 * penalty @ (w * w)

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        if np.abs(gradient).max() < 1e-10:
            break
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), gradient)
        size = 1.0
        while (to := loss(w - size * step)) > at and size > 1e-8:
            size /= 2
        w, at = w - size * step, min(to, at)
    return w[:-1], float(w[-1])


def newton_logistic_many(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """:func:`newton_logistic` for many labels over the same rows: ``y`` and ``weight`` have a column for each. Coefficients by row, intercepts.

    All labels step together, their Hessians are one product with the rows' outer squares. A label is done when its gradient or its step
    is nothing; losses compare with the slack that rounding needs, so no step is halved over the last digits.
    """
    z = np.column_stack([x, np.ones(len(x))])
    n, d = z.shape
    squares = (z[:, :, None] * z[:, None, :]).reshape(n, d * d)
    penalty = np.r_[np.full(d - 1, 1.0 / c), 0.0][:, None]
    w, left = np.zeros((d, y.shape[1])), np.arange(y.shape[1])

    def loss(w, m, y, weight):
        return (weight * (np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m)).sum(0) + 0.5 * (penalty * w * w).sum(0)

    at = loss(w, z @ w, y, weight)
    for _ in range(steps):
        own, ys, ws = w[:, left], y[:, left], weight[:, left]
        p = 1 / (1 + np.exp(-z @ own))
        gradient = z.T @ (ws * (p - ys)) + penalty * own
        hessian = (squares.T @ (ws * p * (1 - p))).T.reshape(len(left), d, d) + np.diag(penalty[:, 0] + 1e-12)
        step = np.linalg.solve(hessian, gradient.T[:, :, None])[:, :, 0].T
        size, was = np.ones(len(left)), at[left]
        while True:
            to = own - size * step
            now = loss(to, z @ to, ys, ws)
            worse = (now > was + 1e-12 * np.abs(was)) & (size > 1e-8)
            if not worse.any():
                break
            size[worse] /= 2
        w[:, left], at[left] = to, np.minimum(now, was)
        left = left[(np.abs(gradient).max(0) >= 1e-10) & (np.abs(step).max(0) >= 1e-11)]
        if not len(left):
            break
    return w[:-1].T, w[-1]


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x; equal x are averaged first."""
    knots, which, weight = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(which, y) / weight
    level, mass, width = [], [], []
    for m, w in zip(mean, weight.astype(float), strict=True):
        level.append(m)
        mass.append(w)
        width.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            m2, w2, n2 = level.pop(), mass.pop(), width.pop()
            level[-1] = (level[-1] * mass[-1] + m2 * w2) / (mass[-1] + w2)
            mass[-1] += w2
            width[-1] += n2
    return knots, np.repeat(level, width)


def pool_blocks(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in ascending order, each with a count and a sum → blocks whose means increase strictly, neighbours pooled where they do not."""
    kept: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), hits.tolist(), strict=True):
        kept.append(list(block))
        while len(kept) > 1 and kept[-2][3] * kept[-1][2] >= kept[-1][3] * kept[-2][2]:
            _, high_end, more, sum_ = kept.pop()
            kept[-1][1] = high_end
            kept[-1][2] += more
            kept[-1][3] += sum_
    return tuple(np.array(c) for c in zip(*kept, strict=True)) if kept else (low, high, n, hits)
