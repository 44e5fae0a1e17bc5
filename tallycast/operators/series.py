"""Regular series per item: resampling, gap filling and packing (M1-M3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.dates import period_end, step_date


def period_totals(df: DataFrame, freq: str = "D") -> DataFrame:
    """Quantity per item and period that has rows; combined before the shuffle."""
    return df.groupBy("sku", period_end(F.col("date"), freq).alias("period")).agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("y")
    )


def period_number(period: Column, freq: str) -> Column:
    """Consecutive number of a period label."""
    if freq == "M":
        return F.year(period) * 12 + F.month(period)
    days = F.datediff(period, F.lit("1970-01-04").cast("date"))  # a Sunday
    return F.floor(days / 7).cast("int") if freq == "W" else days


def pack(df: DataFrame, freq: str = "D") -> DataFrame:
    """One row per item: sku, n, last_period, ys with zeros for missing periods.

    An array holds one number per calendar period, so its length is bounded by the
    calendar and not by the number of rows. The partition count is set explicitly because
    the model folds are heavy work on few bytes, which AQE would put into few tasks.
    """
    spark = df.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    totals = period_totals(df, freq).withColumn("_i", period_number(F.col("period"), freq))
    points = F.array_sort(F.collect_list(F.struct("_i", "y", "period")))
    packed = totals.repartition(partitions, "sku").groupBy("sku").agg(points.alias("_points"))

    def with_gap(point: Column, position: Column) -> Column:
        earlier = F.get(F.col("_points"), position - 1)["_i"]
        gap = F.coalesce(point["_i"] - earlier - 1, F.lit(0))
        return F.concat(F.array_repeat(F.lit(0.0), gap), F.array(point["y"]))

    filled = packed.select(
        "sku",
        F.element_at("_points", -1)["period"].alias("last_period"),
        F.flatten(F.transform("_points", with_gap)).alias("ys"),
    )
    return filled.select("sku", F.size("ys").alias("n"), "last_period", "ys")


def unpack(packed: DataFrame, freq: str = "D") -> DataFrame:
    """Long form (sku, period, y) of packed series, without another shuffle."""
    long = packed.select("sku", "n", "last_period", F.posexplode("ys").alias("_i", "y"))
    return long.select("sku", step_date(F.col("last_period"), F.col("_i") + 1 - F.col("n"), freq).alias("period"), "y")


def resample(df: DataFrame, freq: str = "D") -> DataFrame:
    """M1: sum per day, per week ending Sunday, or per month end; missing periods are 0."""
    return unpack(pack(df, freq), freq)


def future_dates(packed: DataFrame, horizon: int, freq: str = "D") -> DataFrame:
    """M3: (sku, step, date) for steps 1..horizon."""
    steps = packed.select("sku", "last_period", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select("sku", "step", step_date(F.col("last_period"), F.col("step"), freq).alias("date"))
