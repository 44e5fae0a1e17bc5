"""Trees as flat arrays, walked in Arrow batches, and forecasts that roll their own features forward."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAGS = (1, 7, 14, 28)
REACH = max(LAGS)
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Forest:
    """``feature[i] <= threshold[i]`` leads from node i to ``left[i]``, else to ``right[i]``; a leaf leads to itself.

    A prediction is the sum of the ``value`` of one leaf of each tree; ``roots`` are the first nodes.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for the rows of ``x``; all trees take a step together, on as many rows as a processor cache holds."""
        sides = np.column_stack([self.left, self.right]).ravel()
        found = np.empty(len(x))
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = x[start:start + ROWS_AT_ONCE]
            base = np.arange(len(part))[:, None] * x.shape[1]
            values, node = part.ravel(), np.tile(self.roots, (len(part), 1))
            while True:
                low = values[base + self.feature[node]] <= self.threshold[node]
                following = sides[2 * node + ~low]
                if (following == node).all():
                    break
                node = following
            found[start:start + ROWS_AT_ONCE] = self.value[node].sum(axis=1)
        return found


def flat(trees: list) -> Forest:
    """Nested trees, (feature, threshold, low side, high side) or a number for a leaf, as arrays."""
    nodes: list[tuple] = []

    def lay(tree) -> int:
        place = len(nodes)
        if not isinstance(tree, tuple):
            nodes.append((0, np.inf, place, place, float(tree)))
            return place
        nodes.append(())
        feature, threshold, low, high = tree
        nodes[place] = (feature, threshold, lay(low), lay(high), 0.0)
        return place

    roots = [lay(tree) for tree in trees]
    columns = list(zip(*nodes))
    return Forest(np.array(columns[0]), np.array(columns[1], float), np.array(columns[2]), np.array(columns[3]),
                  np.array(columns[4]), np.array(roots))


SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
WEIGHT = re.compile(r"Tree \d+ \(weight (\S+)\):")


def from_model(description: str) -> Forest:
    """The trees in the text form that MLlib gives of its tree ensembles."""
    lines = iter(line.strip() for line in description.splitlines() if line.strip())

    def read(line: str, weight: float):
        split = SPLIT.match(line)
        if not split:
            return weight * float(line.removeprefix("Predict:"))
        low = read(next(lines), weight)
        next(lines)  # the Else line repeats the condition
        return int(split[1]), float(split[2]), low, read(next(lines), weight)

    return flat([read(next(lines), float(tree[1])) for tree in (WEIGHT.match(line) for line in lines) if tree])


def _dates(last: np.ndarray, step: int, freq: str) -> np.ndarray:
    if freq == "M":
        return (last.astype("M8[M]") + step + 1).astype("M8[D]") - 1
    return last + step * (7 if freq == "W" else 1)


def _features(known: np.ndarray, n: np.ndarray, last: np.ndarray, step: int, freq: str) -> np.ndarray:
    """The features of ``boosted.FEATURES`` but for the step, from the scaled values known before it."""
    week, date = known[:, -7:], _dates(last, step, freq)
    month = date.astype("M8[M]")
    return np.column_stack([
        *[known[:, -lag] for lag in LAGS], week.mean(axis=1), week.std(axis=1, ddof=1), known[:, -28:].mean(axis=1),
        (date.astype(int) + 3) % 7, month.astype(int) % 12 + 1, (date - month.astype("M8[D]")).astype(int) + 1,
        pd.DatetimeIndex(date).isocalendar().week.to_numpy(dtype=float), n - 1 + step,
    ])


def roll_forward(packed: DataFrame, forest: Forest, horizon: int, freq: str) -> DataFrame:
    """(sku, forecast) with each step's prediction, not below zero, among the values of the steps after it.

    ``packed`` needs at least ``REACH`` periods and a positive ``mean``, by which values are scaled. All series of a
    batch take a step together; only their last periods leave Spark.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            mean = batch["mean"].to_numpy()[:, None]
            known = np.stack(batch["_tail"].to_list()).astype(float) / mean
            n, last = batch["n"].to_numpy(), batch["last_period"].to_numpy().astype("M8[D]")
            for step in range(1, horizon + 1):
                ahead = forest.predict(_features(known, n, last, step, freq))
                known = np.column_stack([known, np.maximum(ahead, 0.0)])
            yield pd.DataFrame({"sku": batch["sku"], "forecast": list(known[:, REACH:] * mean)})

    tails = packed.select("sku", "mean", "n", "last_period", F.slice("ys", -REACH, REACH).alias("_tail"))
    return tails.mapInPandas(run, f"sku {packed.schema['sku'].dataType.simpleString()}, forecast array<double>")
