"""Result tables and report figures (E1-E14). Input is the nested result table of ``forecast``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import FREQUENCY_LABELS
from tallycast.functions.scale import kept
from tallycast.operators.forecast import forecast_rows, result_date
from tallycast.operators.models.base import total
from tallycast.operators.series import resample
from tallycast.sources.files import write_bundle


def forecast_table(results: DataFrame, include_bounds: bool = True) -> DataFrame:
    """E1."""
    columns = ["sku", "date", "forecast", "model"] + (["lower_bound", "upper_bound"] if include_bounds else [])
    return forecast_rows(results).select(*columns)


def forecast_summary(results: DataFrame) -> DataFrame:
    """One row per item, straight from the nested form."""
    label = F.col("frequency")
    for code, text in FREQUENCY_LABELS.items():
        label = F.when(F.col("frequency") == code, text).otherwise(label)
    return results.select(
        "sku",
        "model",
        label.alias("frequency"),
        F.size("forecast").alias("periods"),
        total(F.col("forecast")).alias("total_forecast"),
        (total(F.col("forecast")) / F.size("forecast")).alias("avg_period_forecast"),
        "mape",
        "mae",
        result_date(F.lit(1)).alias("forecast_start"),
        result_date(F.size("forecast")).alias("forecast_end"),
    )


def model_performance(results: DataFrame) -> DataFrame:
    """E3."""
    return results.select("sku", "model", "mape", "mae", "rmse")


def comparison_report(comparison: DataFrame) -> DataFrame:
    """E4."""
    return comparison.select("model", "avg_mape", "avg_mae", "win_rate").orderBy("avg_mape", "model")


def item_totals(results: DataFrame) -> DataFrame:
    return results.select("sku", "model", total(F.col("forecast")).alias("total_forecast"), "mape", "mae")


def executive_summary(results: DataFrame) -> DataFrame:
    """E5: items, total, mean error, horizon, and the share of items above 1000."""
    sums = results.select(total(F.col("forecast")).alias("t"), F.size("forecast").alias("h"), "mape")
    return sums.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(F.sum("t"), F.lit(0.0)).alias("total_forecast"),
        F.coalesce(F.avg("mape"), F.lit(0.0)).alias("avg_mape"),
        F.coalesce(F.max("h"), F.lit(0)).alias("forecast_horizon"),
        F.coalesce(F.avg((F.col("t") > 1000).cast("double")) * 100, F.lit(0.0)).alias("large_items_pct"),
    )


def top_items(results: DataFrame, n: int = 10) -> DataFrame:
    """The largest forecasts."""
    return item_totals(results).orderBy(F.desc("total_forecast"), "sku").limit(n)


def report_tables(results: DataFrame, include_bounds: bool = True) -> dict[str, DataFrame]:
    """The tables of one report, ready for ``write_bundle``."""
    return {
        "summary": forecast_summary(results),
        "forecasts": forecast_table(results, include_bounds),
        "model_performance": model_performance(results),
    }


def write_report(results: DataFrame, path: str, include_bounds: bool = True) -> None:
    """The tables of one report, from one run of the models, replacing a former report in one step."""
    once = kept(results)
    write_bundle(results.sparkSession, report_tables(once, include_bounds), path)
    once.unpersist()


def status(mape: Column) -> Column:
    """E7."""
    return F.when(mape < 15, "Good").when(mape < 30, "Fair").otherwise("Review")


def with_status(results: DataFrame) -> DataFrame:
    """E7."""
    sums = item_totals(results.withColumn("_h", F.size("forecast")))
    return sums.withColumn("status", status(F.col("mape")))


def result_summary(results: DataFrame) -> DataFrame:
    """One row; the two maps have one entry per status and per model."""
    groups = with_status(results).groupBy("status", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_forecast").alias("t"), F.sum("mape").alias("m")
    )
    whole = groups.agg(
        F.sum("n").alias("total_items"),
        F.sum("t").alias("total_forecast"),
        F.try_divide(F.sum("m"), F.sum("n")).alias("avg_mape"),
        F.collect_list(F.struct("status", "model", "n")).alias("_g"),  # statuses times models
    )

    def counts(key: str) -> Column:
        names = F.array_sort(F.array_distinct(F.col(f"_g.{key}")))
        of = lambda name: F.aggregate(F.filter("_g", lambda g: g[key] == name), F.lit(0).cast("long"), lambda n, g: n + g["n"])
        return F.map_from_entries(F.transform(names, lambda name: F.struct(name, of(name)))).alias(f"{key}_distribution")

    return whole.select("total_items", "total_forecast", "avg_mape", counts("status"), counts("model"))


def model_distribution(results: DataFrame) -> DataFrame:
    """E8."""
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("items"))


def problem_items(results: DataFrame, threshold: float = 30.0) -> DataFrame:
    """E9."""
    return results.filter(F.col("mape") > threshold).select("sku", "model", "mape")


def filter_results(
    results: DataFrame, items: DataFrame | None = None, quality: str | None = None
) -> DataFrame:
    """Items of a tier or watch-list, and one status band."""
    if items is not None:
        results = results.join(items.select("sku"), "sku", "left_semi")
    if quality is not None:
        results = results.filter(status(F.col("mape")) == quality)
    return results


def edge_periods(results: DataFrame, which: str = "first", n: int = 10) -> DataFrame:
    """The first or last ``n`` periods of each forecast."""
    if which == "first":
        return forecast_rows(results).filter(F.col("step") <= n)
    return forecast_rows(results, F.size("forecast")).filter(F.col("step") > F.col("horizon") - n).drop("horizon")


def history_and_forecast(df: DataFrame, results: DataFrame, freq: str) -> DataFrame:
    """One series per item with a ``kind`` column."""
    history = resample(df, freq).select("sku", F.col("period").alias("date"), "y", F.lit("history").alias("kind"))
    ahead = forecast_rows(results).select("sku", "date", F.col("forecast").alias("y"), F.lit("forecast").alias("kind"))
    return history.unionByName(ahead)


def export_items(results: DataFrame, choice: str = "all", items: DataFrame | None = None, top: int = 100) -> DataFrame:
    """All items, the largest ``top``, or those of a tier, watch-list or own list."""
    if choice == "all":
        return results
    if choice == "top":
        return results.orderBy(F.desc(total(F.col("forecast"))), "sku").limit(top)
    return results.join(items.select("sku"), "sku", "left_semi")


def last_days(series: DataFrame, days: int) -> DataFrame:
    """Rows within ``days`` before the item's last date; rows are one per period."""
    last = F.max("date").over(Window.partitionBy("sku"))
    return series.withColumn("_last", last).filter(F.col("date") >= F.date_sub("_last", days)).drop("_last")
