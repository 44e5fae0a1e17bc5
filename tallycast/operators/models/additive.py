"""Piecewise-linear trend plus yearly and weekly Fourier terms (M9).

The slope may change at up to ``BENDS`` places spread over the first part of a series. The changes carry an L1
penalty, so that most of them are zero; its weight follows from the noise that is left, as a Laplace prior on the
changes gives it. Level, slope and Fourier terms (ridge) are eliminated by their normal equations; the changes of all
series of a batch are then solved together by active sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallycast.config import BAND_Z, GridConfig

YEARLY_ORDER = 10
WEEKLY_ORDER = 3
RIDGE = 1e-3
MIN_OBS = 2
BENDS = 25
BEND_SHARE = 0.8
BEND_SCALE = 0.05  # of the prior, for values over the largest one and time from 0 to 1
NOISE_ROUNDS = 6
LEAST_NOISE = 1e-5  # standard deviation, for values over the largest one
ROUNDS = 500
SLACK = 1e-6
AT_ONCE = 1024  # series solved together


def period_days(last: np.datetime64, n: int, horizon: int, freq: str) -> np.ndarray:
    """Days since the epoch of the n known and the next ``horizon`` period labels."""
    steps = np.arange(1 - n, horizon + 1)
    if freq == "M":
        labels = (last.astype("M8[M]") + steps + 1).astype("M8[D]") - 1
    else:
        labels = last + steps * (7 if freq == "W" else 1)
    return labels.astype(float)


def _design(days: np.ndarray, span: float, weekly: bool) -> np.ndarray:
    """Columns 1, t and the Fourier terms."""
    columns = [np.ones_like(days), (days - days[0]) / max(span, 1.0)]
    seasons = [(365.25, YEARLY_ORDER)] + ([(7.0, WEEKLY_ORDER)] if weekly else [])
    for length, order in seasons:
        angle = 2 * np.pi * days[:, None] * np.arange(1, order + 1) / length
        columns += [*np.sin(angle).T, *np.cos(angle).T]
    return np.column_stack(columns)


def bend_places(n: int) -> np.ndarray:
    """Rows at which the slope may change, evenly spread over the first ``BEND_SHARE`` of the series."""
    history = int(n * BEND_SHARE)
    count = max(0, min(BENDS, history - 1))
    return np.linspace(0, history - 1, count + 1).round().astype(int)[1:]


def bend_columns(days: np.ndarray, n: int) -> np.ndarray:
    """Time since each place, zero before it; the first ``n`` of ``days`` are known."""
    span = max(days[n - 1] - days[0], 1.0)
    return np.maximum(days[:, None] - days[bend_places(n)], 0.0) / span


def normal_equations(days: np.ndarray, ys: np.ndarray, weekly: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram of the bends, their products with each row of ``ys``, squares left without bends), the rest eliminated."""
    n = ys.shape[1]
    base, hinges = _design(days[:n], days[n - 1] - days[0], weekly), bend_columns(days[:n], n)
    solved = np.linalg.solve(_gram(base), base.T @ np.column_stack([hinges, ys.T]))
    free = np.column_stack([hinges, ys.T]) - base @ solved
    width = hinges.shape[1]
    return hinges.T @ free[:, :width], (hinges.T @ free[:, width:]).T, (ys.T * free[:, width:]).sum(axis=0)


def _gram(base: np.ndarray) -> np.ndarray:
    penalty = np.full(base.shape[1], RIDGE * len(base))
    penalty[:2] = 1e-9
    return base.T @ base + np.diag(penalty)


def descend(gram: np.ndarray, target: np.ndarray, weight: np.ndarray, bends: np.ndarray) -> np.ndarray:
    """Minimise b'Gb / 2 - t'b + weight * sum |b| for each series, from ``bends``, by active sets.

    The active changes go towards the minimum for their signs, up to the first that reaches zero and is dropped. When
    none does, the zero change that wants to leave most becomes active; when none wants to, the series is done. Every
    step lowers the loss, so no set of signs comes twice.
    """
    bends, signs, width = bends.copy(), np.sign(bends), bends.shape[1]
    spots = range(width)
    scale = np.einsum("ijj->ij", gram)
    floor = 1e-13 * scale.max(axis=1, keepdims=True, initial=0)
    usable = scale > floor
    left = np.arange(len(bends))
    for _ in range(ROUNDS):
        now, sign, part, goal, limit = bends[left], signs[left], gram[left], target[left], weight[left, None]
        held = sign != 0
        system = np.where(held[:, :, None] & held[:, None, :], part, 0.0)
        system[:, spots, spots] = np.where(held, part[:, spots, spots] + floor[left], 1.0)
        best = np.linalg.solve(system, np.where(held, goal - limit * sign, 0.0)[:, :, None])[:, :, 0]
        crossing = held & (best * sign <= 0)
        share = np.where(crossing, now / np.where(crossing & (now != best), now - best, 1.0), 1.0)
        least = share.min(axis=1, keepdims=True, initial=1)
        dropped = crossing & (share <= least)
        bends[left] = np.where(dropped, 0.0, now + least * (best - now))
        pull = goal - np.matmul(part, best[:, :, None])[:, :, 0]
        excess = np.where(held | ~usable[left], 0.0, np.abs(pull) - limit * (1 + SLACK))
        whole = ~crossing.any(axis=1)
        entering = whole & (excess.max(axis=1, initial=0) > 0)
        sign[dropped] = 0
        rows = np.flatnonzero(entering)
        chosen = excess[rows].argmax(axis=1)
        sign[rows, chosen] = np.sign(pull[rows, chosen])
        signs[left] = sign
        left = left[~whole | entering]
        if not len(left):
            break
    return bends


def solve_bends(gram: np.ndarray, target: np.ndarray, square: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope changes, weight of their penalty): changes and noise by turns, from no changes."""
    bends = np.zeros_like(target)
    weight = np.zeros(len(target))
    for _ in range(NOISE_ROUNDS):
        left = square - 2 * (target * bends).sum(axis=1) + np.einsum("ij,ijk,ik->i", bends, gram, bends)
        weight = np.maximum(left / lengths, LEAST_NOISE ** 2) / BEND_SCALE
        bends = descend(gram, target, weight, bends)
    return bends, weight


def finish(ys: np.ndarray, days: np.ndarray, bends: np.ndarray, horizon: int, weekly: bool) -> dict:
    """The other terms for given slope changes, the forecast and its errors."""
    n = len(ys)
    base, trend = _design(days, days[n - 1] - days[0], weekly), bend_columns(days, n) @ bends
    weights = np.linalg.solve(_gram(base[:n]), base[:n].T @ (ys - trend[:n]))
    fitted = base @ weights + trend
    error = ys - fitted[:n]
    known = ys != 0
    half = BAND_Z * error.std(ddof=1)
    ahead = fitted[n:]
    return {
        "model": "additive",
        "forecast": np.maximum(ahead, 0.0).tolist(),
        "lower": np.maximum(ahead - half, 0.0).tolist(),
        "upper": (ahead + half).tolist(),
        "mape": float(np.abs(error[known] / ys[known]).mean() * 100) if known.any() else 0.0,
        "mae": float(np.abs(error).mean()),
        "rmse": float(np.sqrt((error * error).mean())),
    }


class Additive:
    name = "additive"

    def __init__(self, freq: str):
        self.freq, self.weekly = freq, freq == "D"

    def slope_changes(self, series, last_periods) -> tuple[list[np.ndarray], list[float]]:
        """Per series its slope changes at ``bend_places``, in units of the series, and the penalty they were found with."""
        count = len(series)
        gram, target = np.zeros((count, BENDS, BENDS)), np.zeros((count, BENDS))
        square, top = np.zeros(count), np.ones(count)
        alike: dict[tuple, list[int]] = {}  # series of the same periods share their equations
        for i, (ys, last) in enumerate(zip(series, last_periods)):
            top[i] = np.abs(ys).max() or 1.0
            alike.setdefault((len(ys), last), []).append(i)
        for (n, last), members in alike.items():
            table = np.array([series[i] / top[i] for i in members])
            shared, products, squares = normal_equations(period_days(last, n, 0, self.freq), table, self.weekly)
            width = len(shared)
            gram[members, :width, :width], target[members, :width], square[members] = shared, products, squares
        bends, weight = solve_bends(gram, target, square, np.array([len(ys) for ys in series]))
        return [b[:len(bend_places(len(ys)))] * t for b, ys, t in zip(bends, series, top)], weight.tolist()

    def fit(self, series, last_periods, wanted, horizon: int, grid: GridConfig) -> list[dict | None]:
        out: list[dict | None] = [None] * len(series)
        able = [i for i, ys in enumerate(series) if wanted[i] and len(ys) >= MIN_OBS]
        for start in range(0, len(able), AT_ONCE):
            some = able[start:start + AT_ONCE]
            bends, _ = self.slope_changes([series[i] for i in some], [last_periods[i] for i in some])
            for i, changes in zip(some, bends):
                days = period_days(last_periods[i], len(series[i]), horizon, self.freq)
                out[i] = finish(series[i], days, changes, horizon, self.weekly)
        return out


BEND_ROWS = "sku string, place int, period date, slope_change double, hinge_sum double, hinge_square double, hinge_y double"


def trend_bends(packed: DataFrame, freq: str) -> DataFrame:
    """One row for each place of each packed series: the change of the slope there, in units a day.

    With it the products of the place's column with one, itself and the series, of which the normal equations are made.
    Series of less than three periods have no place. Nulls aren't expected: ``pack`` fills missing periods.
    """
    fitter = Additive(freq)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), AT_ONCE):
                some = batch.iloc[start:start + AT_ONCE]
                series = [np.asarray(ys, dtype=float) for ys in some["ys"]]
                lasts = some["last_period"].to_numpy().astype("M8[D]")
                changes, _ = fitter.slope_changes(series, lasts)
                for sku, ys, last, found in zip(some["sku"], series, lasts, changes):
                    days, places = period_days(last, len(ys), 0, freq), bend_places(len(ys))
                    hinges, span = bend_columns(days, len(ys)), max(days[-1] - days[0], 1.0)
                    yield pd.DataFrame({
                        "sku": sku, "place": places, "period": days[places].astype("M8[D]").astype(object), "slope_change": found / span,
                        "hinge_sum": hinges.sum(axis=0), "hinge_square": (hinges * hinges).sum(axis=0), "hinge_y": ys @ hinges,
                    })

    return packed.select("sku", "ys", "last_period").mapInPandas(run, BEND_ROWS)


def model(freq: str, grid: GridConfig) -> Additive:
    return Additive(freq)
