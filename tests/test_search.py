"""Bounded search: known minima, never worse than the grid, and ARIMA against a plain Kalman filter."""

from itertools import product

import numpy as np
import pytest

from tallycast.config import GRID, GridConfig
from tallycast.operators.models import arima, smoothing
from tallycast.operators.models.search import minimise

REFINED = GridConfig(refine=True)


def test_minimum_inside_and_on_the_edge_of_the_box():
    centre = np.array([[0.3, 0.6], [1.7, 0.2], [-0.5, -2.0]])

    def value(rows, points):
        x, y = np.moveaxis(points - centre[rows][:, None, :], 2, 0)
        return x * x + 30 * (y + 0.5 * x * x) ** 2

    found = minimise(value, np.full((3, 2), 0.9), np.zeros(2), np.ones(2))
    assert found[0] == pytest.approx(centre[0], abs=1e-4)
    dense = np.array(list(product(np.linspace(0, 1, 201), repeat=2)))
    for row in range(3):
        best = value(np.array([row]), dense[None])[0].min()
        assert value(np.array([row]), found[row][None, None])[0, 0] <= best + 1e-9


def test_start_stays_where_the_function_is_flat_or_not_finite():
    start = np.array([[0.2, 0.4], [0.1, 0.1]])
    value = lambda rows, points: np.where(rows[:, None] == 0, 1.0, np.nan) * np.ones(points.shape[:2])
    assert (minimise(value, start, np.zeros(2), np.ones(2)) == start).all()


def table(rng, lengths, season):
    y = np.zeros((len(lengths), max(lengths)))
    for row, n in enumerate(lengths):
        level = 50 + rng.normal(0, rng.uniform(0.1, 3), n).cumsum()
        y[row, :n] = level + 10 * np.sin(np.arange(n) * 2 * np.pi / 12) * (season > 1) + rng.normal(0, 2, n)
    return y, np.array(lengths)


@pytest.mark.parametrize("m", [1, 12])
def test_smoothing_is_never_worse_than_grids(m):
    y, n = table(np.random.default_rng(m), [60, 60, 41, 30, 24], m)
    y[4, :24] = 7.0  # never changes
    points = np.array(list(product(GRID.alphas, GRID.betas, GRID.gammas if m > 1 else (0.0,))))
    sse = smoothing.errors_at(y, n, m, points[None])
    start = points[sse.argmin(axis=1)]
    found = smoothing.refined(y, n, m, start)
    low, high = smoothing.BOX
    assert ((found >= low) & (found <= high)).all()
    after = smoothing.errors_at(y, n, m, found[:, None])[:, 0]
    assert (after <= sse.min(axis=1)).all() and (after[:4] < sse.min(axis=1)[:4]).any()
    near = np.linspace(-0.04, 0.04, 9)  # a dense grid around the result holds nothing lower
    around = np.array(list(product(near, near, near if m > 1 else [0.0])))
    dense = np.clip(found[:, None] + around, low, high) if m > 1 else np.clip(found[:, None] + around, low * [1, 1, 0], high)
    assert (after <= smoothing.errors_at(y, n, m, dense).min(axis=1) * (1 + 1e-6) + 1e-9).all()


def kalman(w, phi, theta, horizon):
    """Plain filter of the state (w, last shock, sum of forecasts): -2 log likelihood, mean and variance ahead."""
    turn, shock = np.array([[phi, theta], [0.0, 0.0]]), np.array([1.0, 1.0])
    mean = np.zeros(2)
    var = np.array([[(1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2), 1.0], [1.0, 1.0]])
    squares = logs = 0.0
    for value in w:
        e, f = value - mean[0], var[0, 0]
        squares, logs = squares + e * e / f, logs + np.log(f)
        gain = var[:, 0] / f
        mean, var = mean + gain * e, var - np.outer(gain, var[0])
        mean, var = turn @ mean, turn @ var @ turn.T + np.outer(shock, shock)
    sigma = squares / len(w)
    wide = np.array([[phi, theta, 0], [0, 0, 0], [phi, theta, 1.0]])  # with the running sum of changes
    state = np.array([mean[0], mean[1], mean[0]])
    cover = np.array([[var[0, 0], var[0, 1], var[0, 0]], [var[1, 0], var[1, 1], var[1, 0]], [var[0, 0], var[0, 1], var[0, 0]]])
    sums, spread = [], []
    for _ in range(horizon):
        sums.append(state[2])
        spread.append(sigma * cover[2, 2])
        state, cover = wide @ state, wide @ cover @ wide.T + np.ones((3, 3)) * np.outer([1, 1, 1], [1, 1, 1])
    return len(w) * (np.log(2 * np.pi * sigma) + 1) + logs, np.array(sums), np.array(spread)


def test_likelihood_and_band_equal_a_plain_filter():
    y, n = table(np.random.default_rng(5), [50, 33, 12, 3], 1)
    for phi, theta in ((0.5, -0.3), (-0.8, 0.9), (0.95, -0.99), (0.0, 0.0)):
        found = arima.deviance(y, n, np.array([[phi]]), np.array([[theta]]))[:, 0]
        for row in range(4):
            assert found[row] == pytest.approx(kalman(np.diff(y[row, :n[row]]), phi, theta, 1)[0], rel=1e-9)
    params = arima.likeliest(y[:3], n[:3], REFINED)
    out = arima.fit(y[:3], n[:3], 6, REFINED)
    for row in range(3):
        _, sums, spread = kalman(np.diff(y[row, :n[row]]), *params[row], 6)
        ahead = y[row, n[row] - 1] + sums
        assert out["forecast"][row] == pytest.approx(np.maximum(ahead, 0), rel=1e-9)
        assert out["upper"][row] == pytest.approx(ahead + 1.96 * np.sqrt(spread), rel=1e-6)


def test_likelihood_is_at_its_maximum():
    rng = np.random.default_rng(6)
    lengths = [160, 80, 40, 12]
    y, n = table(rng, lengths, 1)
    shocks = rng.normal(0, 1, 161)
    w = np.zeros(161)
    for t in range(1, 161):
        w[t] = 0.7 * w[t - 1] + shocks[t] - 0.3 * shocks[t - 1]
    y[0] = 500 + w[1:].cumsum()
    found = arima.likeliest(y, n, REFINED)
    assert found[0] == pytest.approx([0.7, -0.3], abs=0.25)
    best = arima.deviance(y, n, found[:, :1], found[:, 1:])[:, 0]
    grid = np.array(list(product(GRID.phis, GRID.thetas))).T[:, None, :]
    assert (best <= arima.deviance(y, n, *grid).min(axis=1) + 1e-9).all()
    dense = np.clip(found[:, None] + np.array(list(product(np.linspace(-0.05, 0.05, 21), repeat=2))), -arima.LIMIT, arima.LIMIT)
    assert (best <= arima.deviance(y, n, dense[:, :, 0], dense[:, :, 1]).min(axis=1) + 1e-6).all()


def test_constant_and_short_series_are_fitted():
    y = np.full((2, 12), 4.0)
    out = arima.fit(y, np.array([12, 10]), 3, REFINED)
    assert out["forecast"] == pytest.approx(np.full((2, 3), 4.0)) and out["rmse"] == pytest.approx(0.0)
    smooth = smoothing.model("M", REFINED).fit([np.array([1.0, 3.0]), np.array([5.0])], [None] * 2, [True] * 2, 2, REFINED)
    assert smooth[0]["rmse"] >= 0 and smooth[1] is None
