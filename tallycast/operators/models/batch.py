"""Arrow-batched fitting of the models that built-in expressions cannot run well.

The recursions of exponential smoothing, ARIMA and theta depend on the value before, so
array folds would be interpreted step by step for every series and grid point. Here a step
in time is one numpy operation over all series of a batch and all grid points; Spark
partitions the series. See README for the measurement behind this choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.config import BAND_Z, GridConfig

CELLS = 32_768  # series x grid points handled at once, small enough for the processor cache
RESULT = (
    "struct<model:string,forecast:array<double>,lower:array<double>,upper:array<double>,"
    "mape:double,mae:double,rmse:double>"
)


class Errors:
    """Running error sums of several series."""

    def __init__(self, size: int):
        self.abs, self.sq, self.err, self.ape, self.hits, self.n = np.zeros((6, size))

    def add(self, actual: np.ndarray, error: np.ndarray) -> None:
        """One period of the first ``len(actual)`` series."""
        c = len(actual)
        hit = actual != 0
        self.abs[:c] += np.abs(error)
        self.sq[:c] += error * error
        self.err[:c] += error
        self.ape[:c] += np.where(hit, np.abs(error / np.where(hit, actual, 1.0)), 0.0)
        self.hits[:c] += hit
        self.n[:c] += 1

    def measures(self) -> dict[str, np.ndarray]:
        n = np.maximum(self.n, 1)
        return {
            "mape": self.ape / np.maximum(self.hits, 1) * 100,
            "mae": self.abs / n,
            "rmse": np.sqrt(self.sq / n),
        }

    def sample_sd(self) -> np.ndarray:
        variance = (self.sq - self.err * self.err / np.maximum(self.n, 1)) / np.maximum(self.n - 1, 1)
        return np.sqrt(np.maximum(variance, 0.0))


def banded(forecast: np.ndarray, half: np.ndarray, errors: Errors) -> dict[str, np.ndarray]:
    """Result of a batch from forecasts (series x horizon) and half widths of the band."""
    return {
        "forecast": np.maximum(forecast, 0.0),
        "lower": np.maximum(forecast - half, 0.0),
        "upper": forecast + half,
        **errors.measures(),
    }


def clipped_band(forecast: np.ndarray, sd: np.ndarray, errors: Errors) -> dict[str, np.ndarray]:
    """Band around the forecast after it was clipped at zero."""
    return banded(np.maximum(forecast, 0.0), BAND_Z * sd[:, None], errors)


Fit = Callable[[np.ndarray, np.ndarray, int, GridConfig], dict[str, np.ndarray]]


def _fit_some(series: list[np.ndarray], fit: Fit, points: int, horizon: int, grid: GridConfig) -> list[tuple]:
    """Results in the order of ``series``. Longest first, so that a step works on a prefix."""
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    results: list[tuple] = [()] * len(series)
    size = max(1, CELLS // points)
    for start in range(0, len(order), size):
        chosen = order[start:start + size]
        lengths = np.array([len(series[i]) for i in chosen])
        table = np.zeros((len(chosen), lengths[0]))
        for row, i in enumerate(chosen):
            table[row, :lengths[row]] = series[i]
        out = fit(table, lengths, horizon, grid)
        parts = [out[name] for name in ("forecast", "lower", "upper", "mape", "mae", "rmse")]
        for row, i in enumerate(chosen):
            results[i] = tuple(part[row].tolist() for part in parts)
    return results


class Model:
    """A recursive model: variants by eligibility, each with its fit and its grid size."""

    def __init__(self, name: str, variant_of: Callable[[int], str | None], fits: dict[str, tuple[Fit, int]]):
        self.name, self.variant_of, self.fits = name, variant_of, fits

    def shortest(self) -> int:
        """Periods that a series needs; every longer one has a variant too."""
        return next(n for n in count(1) if self.variant_of(n) is not None)

    def fit(self, series, last_periods, wanted, horizon: int, grid: GridConfig) -> list[dict | None]:
        out: list[dict | None] = [None] * len(series)
        groups: dict[str, list[int]] = {}
        for i, ys in enumerate(series):
            variant = self.variant_of(len(ys)) if wanted[i] else None
            if variant is not None:
                groups.setdefault(variant, []).append(i)
        for variant, members in groups.items():
            fit, points = self.fits[variant]
            results = _fit_some([series[i] for i in members], fit, points, horizon, grid)
            for i, (forecast, lower, upper, mape, mae, rmse) in zip(members, results):
                out[i] = {"model": self.name, "forecast": forecast, "lower": lower, "upper": upper,
                          "mape": mape, "mae": mae, "rmse": rmse}
        return out


def fit_models(
    packed: DataFrame, models: list, horizon: int, grid: GridConfig, wanted: dict[str, Column]
) -> DataFrame:
    """Packed series plus one result column per model, null where a series is too short or not wanted."""
    asked = [wanted.get(model.name, F.lit(True)).alias(f"_{model.name}") for model in models]
    kept = packed.columns
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in packed.schema]
    schema = ", ".join(fields + [f"{model.name} {RESULT}" for model in models])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            series = [np.asarray(ys, dtype=float) for ys in batch["ys"]]
            last = batch["last_period"].to_numpy().astype("M8[D]")
            out = batch[kept].copy()
            for model in models:
                wanted_here = batch[f"_{model.name}"].tolist()
                results = model.fit(series, last, wanted_here, horizon, grid)
                out[model.name] = pd.Series(results, index=batch.index, dtype=object)
            yield out

    return packed.select("*", *asked).mapInPandas(run, schema)
