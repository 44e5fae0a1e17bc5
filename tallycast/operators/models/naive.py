"""Last value and last season (M4, M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import SEASON_LENGTH
from tallycast.operators.models.base import accuracy, band, outcome, steps, total


def add_naive(df: DataFrame, horizon: int, freq: str) -> DataFrame:
    """Flat at the last value; judged in sample against the mean."""
    last = F.element_at("ys", -1)
    forecast = F.array_repeat(last, horizon)
    spread = F.coalesce(F.col("sd"), last * 0.1)
    return df.withColumn("naive", outcome(F.lit("naive"), forecast, *band(forecast, spread), F.col("mean_errors")))


def add_seasonal_naive(df: DataFrame, horizon: int, freq: str) -> DataFrame:
    """The value one season back, or the mean where the history does not reach."""
    season = SEASON_LENGTH[freq]
    forecast = F.transform(
        steps(horizon),
        lambda i: F.coalesce(F.get("ys", F.col("n") - season + (i - 1) % season), F.col("mean")),
    )
    early = F.array_repeat(F.col("mean"), F.least(F.col("n"), F.lit(season)))
    fitted = F.concat(early, F.slice("ys", 1, F.greatest(F.col("n") - season, F.lit(0))))
    ready = df.withColumns({"_f": forecast, "_acc": accuracy(F.col("ys"), fitted)})
    spread = F.coalesce(F.col("sd"), total(F.col("_f")) / horizon * 0.1)
    return ready.withColumn(
        "seasonal_naive", outcome(F.lit("seasonal_naive"), F.col("_f"), *band(F.col("_f"), spread), F.col("_acc"))
    ).drop("_f", "_acc")
