"""Data quality metrics, score and abnormal-row views (Q1-Q13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import MIN_POINTS_PER_ITEM, QUALITY_BANDS, QUALITY_TEXTS
from tallycast.functions.scale import exact_quantiles


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Q2: one row per (sku, date); copies are combined before the shuffle."""
    return df.groupBy("sku", "date").agg(F.count(F.lit(1)).alias("copies"))


def quality_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q1-Q4 as one row. Counting per (sku, date) first lets one shuffle serve all metrics."""
    missing = sum(F.col(name).isNull().cast("long") for name in columns)
    per_day = df.groupBy("sku", "date").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(missing).alias("missing"),
        F.sum((F.col("quantity") < 0).cast("long")).alias("negative"),
    )
    per_item = per_day.groupBy("sku").agg(
        F.sum("copies").alias("copies"),
        F.sum(F.col("copies") - 1).alias("extra"),
        F.sum("missing").alias("missing"),
        F.sum("negative").alias("negative"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    totals = per_item.agg(
        F.sum("copies").alias("rows"),
        F.count(F.lit(1)).alias("items"),
        F.sum("extra").alias("duplicates"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negatives"),
        F.sum("missing").alias("missing_cells"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return totals.select(
        "rows",
        "items",
        "missing_cells",
        "duplicates",
        "negatives",
        (F.col("missing_cells") / (F.col("rows") * len(columns)) * 100).alias("missing_pct"),
        (F.col("duplicates") / F.col("rows") * 100).alias("duplicate_pct"),
        (F.col("negatives") / F.col("rows") * 100).alias("negative_pct"),
        F.datediff("last_date", "first_date").alias("date_range_days"),
        (F.col("rows") / F.col("items")).alias("avg_points_per_item"),
    )


def _band(value: Column, good: Column, warning: Column) -> Column:
    return F.when(good, "good").when(warning, "warning").otherwise("critical")


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q5: score 0-100, a status per metric, issue and recommendation texts."""
    row = quality_metrics(df, columns)
    missing, copies, negative = F.col("missing_pct"), F.col("duplicate_pct"), F.col("negative_pct")
    points = F.col("avg_points_per_item")
    penalty = (
        F.when(missing > 5, F.least(F.lit(20.0), missing)).otherwise(0.0)
        + F.when(F.col("duplicates") > 0, F.least(F.lit(15.0), copies * 2)).otherwise(0.0)
        + F.when(F.col("negatives") > 0, F.least(F.lit(10.0), negative * 3)).otherwise(0.0)
        + F.when(points < MIN_POINTS_PER_ITEM, 10.0).otherwise(0.0)
    )
    tests = {
        "missing": (missing > 5, missing),
        "duplicates": (F.col("duplicates") > 0, F.col("duplicates")),
        "negatives": (F.col("negatives") > 0, F.col("negatives")),
        "points": (points < MIN_POINTS_PER_ITEM, points),
    }
    found = [(test, F.format_string(QUALITY_TEXTS[key][0], figure), QUALITY_TEXTS[key][1]) for key, (test, figure) in tests.items()]
    return row.select(
        "*",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - penalty)).alias("overall_score"),
        _band(missing, missing < 5, missing < 15).alias("missing_status"),
        _band(copies, copies == 0, copies < 5).alias("duplicate_status"),
        _band(negative, negative == 0, negative < 2).alias("negative_status"),
        _band(points, points >= 12, points >= 7).alias("coverage_status"),
        F.array_compact(F.array(*[F.when(test, text) for test, text, _ in found])).alias("issues"),
        F.array_compact(F.array(*[F.when(test, F.lit(advice)) for test, _, advice in found])).alias("recommendations"),
    )


def score_band(score: Column) -> Column:
    """Q6."""
    band = F.lit(QUALITY_BANDS[-1][0])
    for name, least in reversed(QUALITY_BANDS[:-1]):
        band = F.when(score >= least, name).otherwise(band)
    return band


def rows_with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q7."""
    any_null = F.lit(False)
    for name in columns:
        any_null = any_null | F.col(name).isNull()
    return df.filter(any_null)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q8: every member of a repeated (sku, date). Only the keys are grouped, not the rows."""
    repeated = duplicate_counts(df).filter("copies > 1").select("sku", "date")
    return df.join(repeated, ["sku", "date"], "left_semi")


def negative_rows(df: DataFrame) -> DataFrame:
    """Q9."""
    return df.filter(F.col("quantity") < 0)


def outlier_rows(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Q10: rows beyond ``threshold`` sample deviations from the overall mean."""
    moments = df.agg(F.avg("quantity").alias("_mean"), F.stddev_samp("quantity").alias("_sd"))
    z = F.try_divide(F.col("quantity") - F.col("_mean"), F.col("_sd"))
    return df.crossJoin(F.broadcast(moments)).filter(F.abs(z) > threshold).drop("_mean", "_sd")  # one row


def summary_stats(df: DataFrame) -> DataFrame:
    """Q11: one row. The exact median is selected by rank, so no task holds all values."""
    median = exact_quantiles(df, [], "quantity", [0.5]).select(F.col("q")[0].alias("median_quantity"))
    totals = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.sum("quantity").alias("total_quantity"),
        F.avg("quantity").alias("mean_quantity"),
        F.stddev_samp("quantity").alias("std_quantity"),
    )
    names = df.groupBy("sku", "category").agg(F.lit(1).alias("_one"))
    distinct = names.agg(
        F.count_distinct("sku").alias("total_items"), F.count_distinct("category").alias("total_categories")
    )
    return totals.crossJoin(F.broadcast(distinct)).crossJoin(F.broadcast(median))  # one row each


def frequency_name(gap_days: Column, dates: Column) -> Column:
    """Q13: name of the spacing given the median gap in whole days."""
    name = (
        F.when(gap_days <= 1, "daily")
        .when(gap_days.between(6, 8), "weekly")
        .when(gap_days.between(28, 32), "monthly")
        .when(gap_days.between(89, 93), "quarterly")
        .when(gap_days.between(360, 370), "yearly")
        .otherwise("irregular")
    )
    return F.when(dates < 2, "unknown").otherwise(name)


def _weighted_median(gap: str, weight: str) -> Column:
    return F.floor(F.expr(f"percentile({gap}, 0.5D, {weight})"))


def item_frequency(df: DataFrame) -> DataFrame:
    """Q13 per item. A day with c rows adds c - 1 gaps of zero, so counts per day suffice."""
    in_item = Window.partitionBy("sku").orderBy("date")
    days = duplicate_counts(df).withColumn("gap", F.datediff("date", F.lag("date").over(in_item)))
    gaps = days.select(
        "sku",
        "copies",
        F.inline(F.array_compact(F.array(
            F.when(F.col("gap").isNotNull(), F.struct(F.col("gap").alias("g"), F.lit(1).cast("long").alias("w"))),
            F.when(F.col("copies") > 1, F.struct(F.lit(0).alias("g"), (F.col("copies") - 1).alias("w"))),
        ))),
    )
    medians = gaps.groupBy("sku").agg(_weighted_median("g", "w").alias("median_gap"))
    counts = days.groupBy("sku").agg(F.sum("copies").alias("data_points"))
    joined = counts.join(medians, "sku", "left")
    return joined.withColumn("frequency", frequency_name(F.col("median_gap"), F.col("data_points")))


def date_range_info(df: DataFrame) -> DataFrame:
    """Q12: one row for the whole table. Gaps are taken over counts per calendar day."""
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("copies"))
    calendar = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per calendar day
    gaps = days.withColumn("gap", F.datediff("date", F.lag("date").over(calendar)))
    pairs = gaps.select("date", "copies", F.inline(F.array(
        F.struct(F.coalesce("gap", F.lit(0)).alias("g"),
                 F.when(F.col("gap").isNull(), 0).otherwise(1).cast("long").alias("w"), F.col("copies").alias("c")),
        F.struct(F.lit(0).alias("g"), (F.col("copies") - 1).alias("w"), F.lit(0).cast("long").alias("c")),
    )))
    row = pairs.agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.datediff(F.max("date"), F.min("date")).alias("total_days"),
        F.sum("c").alias("data_points"),
        _weighted_median("g", "w").alias("median_gap"),
    )
    row = row.withColumn("detected_frequency", frequency_name(F.col("median_gap"), F.col("data_points")))
    share = F.col("data_points") / F.greatest(F.lit(1), F.col("total_days")) * 100
    return row.drop("median_gap").withColumn("coverage_pct", F.when(F.col("detected_frequency") == "daily", share))


