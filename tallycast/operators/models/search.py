"""Minimum of a function inside a box, for all series of a batch at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

STEP = 1e-5  # of the box, for central differences
HALVINGS = 12
Value = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _slopes(value: Value, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
    size, d = u.shape
    sides = np.repeat(u[:, None, :], 2 * d, axis=1)
    index = np.arange(d)
    sides[:, index, index] = np.minimum(u + STEP, 1.0)
    sides[:, d + index, index] = np.maximum(u - STEP, 0.0)
    f = value(rows, sides)
    return (f[:, :d] - f[:, d:]) / (sides[:, index, index] - sides[:, d + index, index])


def _curved(inverse: np.ndarray, moved: np.ndarray, bent: np.ndarray) -> np.ndarray:
    """Update of the inverse curvature by a step and the change of slope along it."""
    along = (moved * bent).sum(axis=1)
    usable = along > 1e-12
    rho = (1 / np.where(usable, along, 1.0))[:, None, None]
    turn = np.eye(moved.shape[1]) - rho * moved[:, :, None] * bent[:, None, :]
    updated = turn @ inverse @ turn.transpose(0, 2, 1) + rho * moved[:, :, None] * moved[:, None, :]
    return np.where(usable[:, None, None], updated, inverse)


def minimise(
    value: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60
) -> np.ndarray:
    """Parameters (series x d) no worse than ``start``, by projected quasi-Newton steps.

    ``value(rows, points)`` gives the function of the series ``rows`` at ``points`` (rows x points x d).
    Slopes are central differences; twelve step lengths are tried in one call and only a lower value is
    taken, so the result is never above the start. A series stops when steepest descent finds
    nothing lower.
    """
    width = high - low
    u = np.clip((start - low) / width, 0.0, 1.0)
    size, d = u.shape

    def scaled(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            f = value(rows, low + points * width)
        return np.where(np.isfinite(f), f, np.inf)

    best = scaled(np.arange(size), u[:, None, :])[:, 0]
    inverse = np.broadcast_to(np.eye(d), (size, d, d)).copy()
    fresh = np.ones(size, dtype=bool)  # no curvature known
    slope = np.zeros((size, d))
    live = np.flatnonzero(np.isfinite(best))
    if len(live):
        slope[live] = _slopes(scaled, live, u[live])
    lengths = 0.5 ** np.arange(HALVINGS)
    for _ in range(rounds):
        if not len(live):
            break
        here, g = u[live], np.nan_to_num(slope[live], posinf=0.0, neginf=0.0)
        held = ((here <= 0) & (g > 0)) | ((here >= 1) & (g < 0))
        free = np.where(held, 0.0, g)
        way = -(inverse[live] @ free[:, :, None])[:, :, 0]
        way[held] = 0.0
        uphill = (way * free).sum(axis=1) >= 0
        way[uphill] = -free[uphill]
        way /= np.maximum(np.abs(way).max(axis=1, keepdims=True), 1.0)
        tried = np.clip(here[:, None, :] + lengths[:, None] * way[:, None, :], 0.0, 1.0)
        f = scaled(live, tried)
        pick = f.argmin(axis=1)
        lowest = f[np.arange(len(live)), pick]
        lower = lowest < best[live] - 1e-12 * (1 + np.abs(best[live]))

        rows = live[lower]
        if len(rows):
            before, moved = slope[rows], tried[lower, pick[lower]] - u[rows]
            u[rows], best[rows] = tried[lower, pick[lower]], lowest[lower]
            slope[rows] = _slopes(scaled, rows, u[rows])
            inverse[rows] = _curved(inverse[rows], moved, np.nan_to_num(slope[rows] - before, posinf=0.0, neginf=0.0))
            fresh[rows] = False
        stuck = live[~lower]
        done = stuck[fresh[stuck] | (np.abs(slope[stuck]).max(axis=1) < 1e-9)]
        inverse[stuck], fresh[stuck] = np.eye(d), True
        live = np.setdiff1d(live, done)
    return np.where(u == (start - low) / width, start, low + u * width)
