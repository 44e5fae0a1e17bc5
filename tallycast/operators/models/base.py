"""What the models share: result rows, accuracy, and array helpers.

A model is one struct column beside the packed series, so that choosing between models
needs no join and no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.config import BAND_Z


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def steps(horizon: int) -> Column:
    return F.sequence(F.lit(1), F.lit(horizon))


def clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


MOMENTS = "mean double, sd double, acc struct<abs: double, sq: double, err: double, ape: double, hits: double, n: double>"


def _moments(ys: pd.Series) -> pd.DataFrame:
    """Of every series its mean, sample deviation, and sums of errors against the mean, added up from the first period on."""
    found = []
    for y in ys:
        n, added = len(y), lambda values: np.add.accumulate(values)[-1] if len(values) else 0.0
        mean = added(y) / n
        error, hit = y - mean, y != 0
        sq = added(error * error)
        acc = (added(np.abs(error)), sq, added(error), added(np.abs(error[hit] / y[hit])), float(hit.sum()), float(n))
        found.append((mean, math.sqrt(sq / (n - 1)) if n > 1 else None, dict(zip(SUMS, acc))))
    return pd.DataFrame(found, columns=["mean", "sd", "acc"]).astype({"mean": float, "sd": float})


SUMS = ("abs", "sq", "err", "ape", "hits", "n")


def with_moments(packed: DataFrame) -> DataFrame:
    """Add ``mean`` and ``sd`` (null for a single period) of the series, and its errors against the mean as ``mean_errors``."""
    measured = packed.withColumn("_moments", F.pandas_udf(_moments, MOMENTS)("ys"))
    return measured.select(*packed.columns, "_moments.mean", "_moments.sd", F.col("_moments.acc").alias("mean_errors"))


def accuracy_start() -> Column:
    zero = F.lit(0.0)
    return F.struct(
        zero.alias("abs"), zero.alias("sq"), zero.alias("err"), zero.alias("ape"), zero.alias("hits"), zero.alias("n")
    )


def accuracy_step(acc: Column, actual: Column, error: Column) -> Column:
    nonzero = actual != 0
    return F.struct(
        (acc["abs"] + F.abs(error)).alias("abs"),
        (acc["sq"] + error * error).alias("sq"),
        (acc["err"] + error).alias("err"),
        (acc["ape"] + F.when(nonzero, F.abs(error / actual)).otherwise(F.lit(0.0))).alias("ape"),
        (acc["hits"] + F.when(nonzero, 1.0).otherwise(0.0)).alias("hits"),
        (acc["n"] + 1.0).alias("n"),
    )


def mape(acc: Column) -> Column:
    return F.coalesce(F.try_divide(acc["ape"], acc["hits"]) * 100, F.lit(0.0))


def mae(acc: Column) -> Column:
    return F.coalesce(F.try_divide(acc["abs"], acc["n"]), F.lit(0.0))


def rmse(acc: Column) -> Column:
    return F.coalesce(F.sqrt(F.try_divide(acc["sq"], acc["n"])), F.lit(0.0))


def accuracy(actual: Column, fitted: Column) -> Column:
    """M13 over two arrays, aligned at their ends: struct of sums for mape, mae and rmse."""
    length = F.least(F.size(actual), F.size(fitted))
    tail = lambda values: F.slice(values, F.size(values) - length + 1, length)
    pairs = F.zip_with(tail(actual), tail(fitted), lambda a, f: F.struct(a.alias("a"), (a - f).alias("e")))
    return F.aggregate(pairs, accuracy_start(), lambda acc, p: accuracy_step(acc, p["a"], p["e"]))


def outcome(model: Column, forecast: Column, lower: Column, upper: Column, acc: Column) -> Column:
    return F.struct(
        model.alias("model"),
        forecast.alias("forecast"),
        lower.alias("lower"),
        upper.alias("upper"),
        mape(acc).alias("mape"),
        mae(acc).alias("mae"),
        rmse(acc).alias("rmse"),
    )


def band(forecast: Column, sd: Column) -> tuple[Column, Column]:
    lower = F.transform(forecast, lambda f: clip(f - BAND_Z * sd))
    upper = F.transform(forecast, lambda f: f + BAND_Z * sd)
    return lower, upper
