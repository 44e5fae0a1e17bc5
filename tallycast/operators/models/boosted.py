"""Pooled gradient-boosted trees over all items.

One model is trained on the scaled values of every item, so the work grows with the rows
and not with the number of models. It learns the next period from those before it; later steps are
predicted from its own predictions (``forest.roll_forward``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.config import SAMPLE_SEED
from tallycast.functions.dates import step_date
from tallycast.functions.scale import kept
from tallycast.operators.models import leafwise, levelwise
from tallycast.operators.models.base import band, outcome
from tallycast.operators.models.forest import LAGS, Forest, roll_forward

MIN_COMPLETE_ROWS = 10
PART_ROWS = 250_000  # training rows of one task
FEATURES = (
    "lag_1", "lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_std_7", "rolling_mean_28",
    "day_of_week", "month", "day_of_month", "week_of_year", "time_idx", "step",
)
PRESETS = {
    "gbt_leaf": {"maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 20},
    "gbt_depth": {"maxDepth": 6, "stepSize": 0.3, "minInstancesPerNode": 1},
}


def _known(origin: Column) -> dict[str, Column]:
    """Features of the values up to the zero-based ``origin``, as plain expressions that Spark compiles."""
    back = lambda k: F.get("ys", origin - k)
    scaled = lambda v: v / F.col("mean")
    added = lambda values: reduce(lambda a, b: a + b, values, F.lit(0.0))
    week = [back(k) for k in reversed(range(7))]
    week_mean = added(week) / 7
    spread = F.sqrt(added([(v - week_mean) * (v - week_mean) for v in week]) / 6)
    return {f"lag_{k}": scaled(back(k - 1)) for k in LAGS} | {
        "rolling_mean_7": scaled(week_mean),
        "rolling_std_7": scaled(spread),
        "rolling_mean_28": scaled(added([back(k) for k in reversed(range(28))]) / 28),
    }


def _of_target(target: Column, step: Column, freq: str) -> dict[str, Column]:
    """Features of the zero-based ``target`` position when ``step`` periods ahead are asked."""
    date = step_date(F.col("last_period"), target + 1 - F.col("n"), freq)
    return {
        "day_of_week": F.weekday(date),
        "month": F.month(date),
        "day_of_month": F.dayofmonth(date),
        "week_of_year": F.weekofyear(date),
        "time_idx": target,
        "step": step,
    }


def _rows(packed: DataFrame, origins: Column, steps: Column, freq: str, label: bool) -> DataFrame:
    """One row per origin (an array) and step ahead (an array): features, and the scaled value of the target.

    What is known at an origin is worked out once for all its steps.
    """
    along = ["sku", "mean", "n", "last_period", "ys", "_origin"]
    at_origins = eligible(packed).select(*along[:-1], F.explode(origins).alias("_origin"))
    known = _known(F.col("_origin"))
    at_steps = at_origins.select(*along, *[column.alias(name) for name, column in known.items()]).select(
        *along, *known, F.explode(steps).alias("_step"))
    target = F.col("_origin") + F.col("_step")
    values = {name: F.col(name) for name in known} | _of_target(target, F.col("_step"), freq)
    first = [(F.get("ys", target) / F.col("mean")).alias("label")] if label else []
    return at_steps.select("sku", "mean", *first, *[values[name].cast("double").alias(name) for name in FEATURES])


def training_rows(packed: DataFrame, horizon: int, freq: str) -> DataFrame:
    """One row per known period and step ahead, where the origin has a complete history.

    Every period is seen at every step, so the step tells nothing about the calendar.
    """
    origins = F.sequence(F.lit(max(LAGS) - 1), F.col("n") - 2)
    steps = F.sequence(F.lit(1), F.least(F.lit(horizon), F.col("n") - 1 - F.col("_origin")))
    return _rows(packed, origins, steps, freq, label=True)


def future_rows(packed: DataFrame, horizon: int, freq: str) -> DataFrame:
    """The features of each future step as far as they are known at the end of the series."""
    return _rows(packed, F.array(F.col("n") - 1), F.sequence(F.lit(1), F.lit(horizon)), freq, label=False)


def learnable() -> Column:
    """Whether a series has enough complete rows to learn from."""
    return (F.col("n") > max(LAGS) - 1 + MIN_COMPLETE_ROWS) & (F.col("mean") > 0)


def eligible(packed: DataFrame) -> DataFrame:
    return packed.filter(learnable())


def in_few_parts(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` in parts of up to about ``PART_ROWS``, at least one for each core: a tree is one job per level, each with a task per part."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // PART_ROWS)))


def with_predictions(training: DataFrame, names: Sequence[str], forest: Forest) -> DataFrame:
    """(sku, mean, label, p) of the training rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield batch[["sku", "mean", "label"]].assign(p=forest.predict(batch[list(names)].to_numpy()))

    rows = training.select("sku", "mean", "label", *names)
    return rows.mapInPandas(run, f"sku {rows.schema['sku'].dataType.simpleString()}, mean double, label double, p double")


def fit_boosted(packed: DataFrame, horizon: int, freq: str, preset: str = "gbt_leaf", trees: int = 100, leaf_wise: bool = False) -> DataFrame:
    """(sku, <preset>) for the items with enough history; needs ``mean``.

    ``leaf_wise`` grows the trees best leaf first (``leafwise.boost``), at about seven Spark jobs a tree.
    """
    names = [name for name in FEATURES if name != "step"]
    training = kept(training_rows(packed, 1, freq))
    if leaf_wise:
        forest = leafwise.boost(training, names, trees)
    else:
        count = training.count()
        forest = levelwise.boost(in_few_parts(training, count), names, count, trees, SAMPLE_SEED, **PRESETS[preset])

    actual = F.col("label") * F.col("mean")
    error = actual - F.col("p") * F.col("mean")
    hit = F.col("label") != 0
    in_sample = with_predictions(training, names, forest).groupBy("sku").agg(
        F.stddev_pop(error).alias("_sd"),
        F.sum(F.abs(error)).alias("abs"),
        F.sum(error * error).alias("sq"),
        F.sum(F.when(hit, F.abs(error / actual))).alias("ape"),
        F.sum(hit.cast("double")).alias("hits"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    forecasts = roll_forward(eligible(packed), forest, horizon, freq)
    acc = F.struct("abs", "sq", "ape", "hits", "n")
    return forecasts.join(in_sample, "sku").select(
        "sku", outcome(F.lit(preset), F.col("forecast"), *band(F.col("forecast"), F.col("_sd")), acc).alias(preset)
    )
