"""ARIMA(1,1,1) (M7): by conditional sum of squares on a grid, or by exact likelihood.

The exact way filters the changes w of a series. With one-step forecasts g and their relative variances r,
started at the stationary variance, e = w - g, g' = phi w + theta e / r and r' = 1 + theta^2 (1 - 1 / r); this is the
Kalman filter of the state (w, last shock) written out.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallycast.config import BAND_Z, GridConfig
from tallycast.operators.models.batch import Errors, Model, banded
from tallycast.operators.models.search import minimise

MIN_OBS = 10
LIMIT = 0.99  # of phi and theta in the search


def _run(y, n, phi, theta, errors: Errors | None = None):
    w = np.diff(y, axis=1)
    shape = (len(y), phi.shape[1])
    e, sse = np.zeros(shape), np.zeros(shape)
    part = lambda p, c: p if len(p) == 1 else p[:c]
    for t in range(2, y.shape[1]):
        c = int(np.searchsorted(-n, -t))
        now = w[:c, t - 1, None] - part(phi, c) * w[:c, t - 2, None] - part(theta, c) * e[:c]
        e[:c] = now
        sse[:c] += now * now
        if errors is not None:
            errors.add(y[:c, t], now[:, 0])
    return e, sse


def _filter(y, n, phi, theta, errors: Errors | None = None):
    """Next change, its relative variance, squared scaled errors and log variances, summed per series."""
    shape = (len(y), phi.shape[1])
    ahead, squares, logs = np.zeros((3, *shape))
    r = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)  # depends on the parameters alone: one row if all series share them
    part = lambda p, c: p if len(p) == 1 else p[:c]
    for t in range(1, y.shape[1]):
        c = int(np.searchsorted(-n, -t))
        w = (y[:c, t] - y[:c, t - 1])[:, None]
        e, now = w - ahead[:c], part(r, c)
        squares[:c] += e * e / now
        logs[:c] += np.log(now)
        ahead[:c] = part(phi, c) * w + part(theta, c) * e / now
        now[:] = 1 + part(theta, c) ** 2 * (1 - 1 / now)
        if errors is not None:
            errors.add(y[:c, t], e[:, 0])
    return ahead, r, squares, logs


def deviance(y: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """-2 x log likelihood of the changes at phi and theta (series or 1 x points), the variance at its best."""
    _, _, squares, logs = _filter(y, n, phi, theta)
    size = n[:, None] - 1
    floor = 1e-14 * (y * y).sum(axis=1)[:, None] + 1e-300  # of a constant series nothing is left
    return size * (np.log(2 * np.pi * (squares + floor) / size) + 1) + logs


def likeliest(y: np.ndarray, n: np.ndarray, grid: GridConfig) -> np.ndarray:
    """phi and theta (series x 2) of largest exact likelihood, searched from the best grid point."""
    points = np.array(list(product(grid.phis, grid.thetas)))
    start = points[deviance(y, n, *points.T[:, None, :]).argmin(axis=1)]
    value = lambda rows, at: deviance(y[rows], n[rows], at[:, :, 0], at[:, :, 1])
    return minimise(value, start, np.full(2, -LIMIT), np.full(2, LIMIT))


def _fit_exact(y: np.ndarray, n: np.ndarray, horizon: int, grid: GridConfig) -> dict[str, np.ndarray]:
    phi, theta = likeliest(y, n, grid).T[:, :, None]
    errors = Errors(len(y))
    change, r, squares, _ = _filter(y, n, phi, theta, errors)
    h = np.arange(1, horizon + 1)
    powers = (1 - phi ** h) / (1 - phi)  # sums of phi^0 .. phi^(h-1)
    weights = 1 + (phi + theta) * (1 - phi ** (h - 1)) / (1 - phi)
    unknown = (r - 1) * powers ** 2  # of the last shock
    variance = squares / (n[:, None] - 1) * (np.cumsum(weights ** 2, axis=1) + unknown)
    last = y[np.arange(len(y)), n - 1][:, None]
    return banded(last + change * powers, BAND_Z * np.sqrt(variance), errors)


def likelihoods(packed: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """Exact log likelihood of every series of three or more periods at each (phi, theta): sku, phi, theta, loglik.

    A series that never changes has none (null).
    """
    phi, theta = np.array(points).T[:, None, :]

    def run(batches):
        for batch in batches:
            found = []
            for sku, ys in zip(batch["sku"], batch["ys"]):
                y = np.asarray(ys, dtype=float)[None]
                size, (_, _, squares, logs) = y.shape[1] - 1, _filter(y, np.array([y.shape[1]]), phi, theta)
                for i, (p, q) in enumerate(points):
                    known = squares[0, i] > 0
                    value = -(size * (np.log(2 * np.pi * squares[0, i] / size) + 1) + logs[0, i]) / 2 if known else None
                    found.append((sku, p, q, value))
            yield pd.DataFrame(found, columns=["sku", "phi", "theta", "loglik"])

    kind = packed.schema["sku"].dataType.simpleString()
    return packed.filter("n >= 3").select("sku", "ys").mapInPandas(run, f"sku {kind}, phi double, theta double, loglik double")


def fit(y: np.ndarray, n: np.ndarray, horizon: int, grid: GridConfig) -> dict[str, np.ndarray]:
    if grid.refine:
        return _fit_exact(y, n, horizon, grid)
    points = np.array(list(product(grid.phis, grid.thetas))).T[:, None, :]
    best = _run(y, n, *points)[1].argmin(axis=1)
    phi, theta = (p[0, best][:, None] for p in points)
    errors = Errors(len(y))
    e, _ = _run(y, n, phi, theta, errors)

    rows = np.arange(len(y))
    last = y[rows, n - 1][:, None]
    change = phi * (last - y[rows, n - 2][:, None]) + theta * e  # one step ahead
    h = np.arange(1, horizon + 1)
    powers = (1 - phi ** h) / (1 - phi)  # sums of phi^0 .. phi^(h-1)
    weights = 1 + (phi + theta) * (1 - phi ** (h - 1)) / (1 - phi)
    variance = errors.sq[:, None] / (n[:, None] - 2) * np.cumsum(weights ** 2, axis=1)
    return banded(last + change * powers, BAND_Z * np.sqrt(variance), errors)


def model(freq: str, grid: GridConfig) -> Model:
    variant = lambda n: "all" if n >= MIN_OBS else None
    return Model("arima", variant, {"all": (fit, len(grid.phis) * len(grid.thetas))})
