"""Exponential smoothing with additive trend and, for long series, additive season (M6)."""

from __future__ import annotations

from itertools import product

import numpy as np

from tallycast.config import SEASON_LENGTH, SEASONAL_MIN_OBS, GridConfig
from tallycast.operators.models.batch import Errors, Model, clipped_band
from tallycast.operators.models.search import minimise

BOX = (np.array([1e-4, 0.0, 0.0]), np.array([0.9999, 0.9999, 0.9999]))  # level, trend, season


def _start(y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and seasonal effects (by period mod m) before the first error."""
    if m == 1:
        return y[:, :1].copy(), np.zeros((len(y), 1, 1))
    level = y[:, :m].cumsum(axis=1)[:, -1:] / m
    return level, (y[:, :m] - level)[:, None, :]


def _run(y, n, m, a, b, g, errors: Errors | None = None):
    """Error-correction recursion for parameters of shape (series or 1, points)."""
    level, season = _start(y, m)
    shape = (len(y), a.shape[1])
    level = np.broadcast_to(level, shape).copy()
    trend = np.zeros(shape)
    season = np.broadcast_to(season, (*shape, m)).copy()
    sse = np.zeros(shape)
    part = lambda p, c: p if len(p) == 1 else p[:c]
    for t in range(m, y.shape[1]):
        c = int(np.searchsorted(-n, -t))  # series still running, longest first
        e = y[:c, t, None] - level[:c] - trend[:c]
        if m > 1:
            e -= season[:c, :, t % m]
            season[:c, :, t % m] += part(g, c) * e
        level[:c] += trend[:c] + part(a, c) * e
        trend[:c] += part(a, c) * part(b, c) * e
        sse[:c] += e * e
        if errors is not None:
            errors.add(y[:c, t], e[:, 0])
    return level, trend, season, sse


def errors_at(y: np.ndarray, n: np.ndarray, m: int, points: np.ndarray) -> np.ndarray:
    """Summed squared one-step errors at ``points`` (series x points x 3)."""
    return _run(y, n, m, *np.moveaxis(points, 2, 0))[3]


def refined(y: np.ndarray, n: np.ndarray, m: int, start: np.ndarray) -> np.ndarray:
    """Parameters (series x 3) of least squared error near ``start``, never worse than it."""
    floor = 1e-12 * (y * y).sum(axis=1) + 1e-300
    value = lambda rows, points: np.log(errors_at(y[rows], n[rows], m, points) + floor[rows, None])
    low, high = BOX
    if m == 1:  # no season, its parameter stays
        plain = lambda rows, points: value(rows, np.dstack([points, np.zeros(points.shape[:2])]))
        found = minimise(plain, start[:, :2], low[:2], high[:2])
        return np.column_stack([found, start[:, 2]])
    return minimise(value, start, low, high)


def _fit(m: int):
    def fit(y: np.ndarray, n: np.ndarray, horizon: int, grid: GridConfig) -> dict[str, np.ndarray]:
        points = np.array(list(product(grid.alphas, grid.betas, grid.gammas if m > 1 else (0.0,)))).T[:, None, :]
        sse = _run(y, n, m, *points)[3]
        best = sse.argmin(axis=1)
        errors = Errors(len(y))
        chosen = [p[0, best][:, None] for p in points]
        if grid.refine:
            chosen = [p[:, None] for p in refined(y, n, m, np.column_stack(chosen)).T]
        level, trend, season, _ = _run(y, n, m, *chosen, errors)
        h = np.arange(1, horizon + 1)
        effects = np.take_along_axis(season[:, 0, :], (n[:, None] - 1 + h) % m, axis=1)
        return clipped_band(level + h * trend + effects, errors.sample_sd(), errors)

    return fit


def model(freq: str, grid: GridConfig) -> Model:
    m, enough = SEASON_LENGTH[freq], SEASONAL_MIN_OBS[freq]
    plain = len(grid.alphas) * len(grid.betas)
    variant = lambda n: "season" if n >= enough else "plain" if n >= 2 else None
    fits = {"season": (_fit(m), plain * len(grid.gammas) * 4), "plain": (_fit(1), plain)}
    return Model("exponential_smoothing", variant, fits)
