"""Theta method: simple smoothing with half the linear drift, on deseasonalised data (M8)."""

from __future__ import annotations

import numpy as np

from tallycast.config import SEASON_LENGTH, GridConfig
from tallycast.operators.models.batch import Errors, Model, clipped_band

MIN_OBS = 10


def _slope(y: np.ndarray, n: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Least-squares slope of each series against its index."""
    size = n.astype(float)
    offset = np.where(inside, np.arange(y.shape[1]) - (size[:, None] - 1) / 2, 0.0)
    return (offset * y).sum(axis=1) / (size * (size * size - 1) / 12)


def _season(y: np.ndarray, n: np.ndarray, inside: np.ndarray, m: int) -> np.ndarray:
    """Mean of the detrended values by index mod m, centred to sum 0."""
    flat = np.where(inside, y - _slope(y, n, inside)[:, None] * np.arange(y.shape[1]), 0.0)
    raw = np.stack([flat[:, k::m].sum(axis=1) / inside[:, k::m].sum(axis=1) for k in range(m)], axis=1)
    return raw - raw.mean(axis=1, keepdims=True)


def _smooth(z, n, alpha):
    level = np.broadcast_to(z[:, :1], (len(z), alpha.shape[1])).copy()
    sse = np.zeros(level.shape)
    for t in range(1, z.shape[1]):
        c = int(np.searchsorted(-n, -t))
        e = z[:c, t, None] - level[:c]
        level[:c] += alpha * e
        sse[:c] += e * e
    return sse


def _fit(m: int):
    def fit(y: np.ndarray, n: np.ndarray, horizon: int, grid: GridConfig) -> dict[str, np.ndarray]:
        index = np.arange(y.shape[1])
        inside = index < n[:, None]
        season = _season(y, n, inside, m) if m > 1 else np.zeros((len(y), 1))
        z = np.where(inside, y - season[:, index % m], 0.0)
        alphas = np.array(grid.theta_alphas)
        alpha = alphas[_smooth(z, n, alphas[None, :]).argmin(axis=1)]
        half = _slope(z, n, inside) / 2

        errors = Errors(len(y))
        level = z[:, 0].copy()
        for t in range(1, y.shape[1]):
            c = int(np.searchsorted(-n, -t))
            e = z[:c, t] - level[:c]
            drift = half[:c] * (1 - (1 - alpha[:c]) ** t) / alpha[:c]
            errors.add(y[:c, t], e - drift)
            level[:c] += alpha[:c] * e

        h = np.arange(1, horizon + 1)
        a, size = alpha[:, None], n[:, None]
        drift = half[:, None] * (h - 1 + (1 - (1 - a) ** size) / a)
        effects = np.take_along_axis(season, (size - 1 + h) % m, axis=1)
        mean = y.sum(axis=1) / n
        sd = np.sqrt(np.where(inside, (y - mean[:, None]) ** 2, 0.0).sum(axis=1) / (n - 1))
        return clipped_band(level[:, None] + drift + effects, sd, errors)

    return fit


def model(freq: str, grid: GridConfig) -> Model:
    m = SEASON_LENGTH[freq]
    variant = lambda n: None if n < MIN_OBS else "season" if n >= 2 * m else "plain"
    points = len(grid.theta_alphas)
    return Model("theta", variant, {"season": (_fit(m), points * 4), "plain": (_fit(1), points)})
