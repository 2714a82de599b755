"""A small ridge logistic fit for calibrations, by damped Newton steps."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60, weight: np.ndarray | None = None) -> dict:
    """Standardised features, unpenalised intercept; a row counts as ``weight`` rows. One class or no rows: a constant at the smoothed share of ones."""
    weight = np.ones(len(y)) if weight is None else weight
    if len(y) == 0 or y.min() == y.max():
        share = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
        width = x.shape[1] if x.ndim == 2 else 0
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(width), "b": float(np.log(share / (1 - share)))}
    mean = np.average(x, 0, weight)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, weight))
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-9
    w = np.zeros(z.shape[1])

    def loss(w):
        m = z @ w
        return weight @ (np.logaddexp(0, m) - y * m) + 0.5 * penalty @ (w * w)

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (weight * (p - y)) + penalty * w)
        size = 1.0
        while size > 1e-6 and (to := loss(w - size * step)) > at:
            size /= 2
        if size <= 1e-6 or at - to < 1e-10:
            break
        w, at = w - size * step, to
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": float(w[-1])}


def sigmoid(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["w"] + model["b"], -35, 35)))
