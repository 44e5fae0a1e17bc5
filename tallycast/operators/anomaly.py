"""Anomaly detection, review and correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import ANOMALY, ANOMALY_TEXTS, SKEW, AnomalyConfig, SkewConfig
from tallycast.functions.dates import period_end, period_sequence
from tallycast.functions.scale import altogether, exact_quantiles, ordered_rows, running
from tallycast.schema import ANOMALY_COLUMNS


def _records(df: DataFrame, value: Column, expected: Column, kind: Column, severity: Column, method: str) -> DataFrame:
    return df.select(
        "sku",
        "date",
        value.cast("double").alias("value"),
        expected.cast("double").alias("expected_value"),
        kind.alias("anomaly_type"),
        F.least(F.lit(1.0), severity).alias("severity"),
        F.lit(method).alias("method"),
    )


def detect_iqr(df: DataFrame, config: AnomalyConfig = ANOMALY, skew: SkewConfig = SKEW, split: bool | None = None) -> DataFrame:
    """A1: outside the quartile fences of the item; expected value is the median."""
    k = config.iqr_multiplier
    spread = F.col("q")[2] - F.col("q")[0]
    fences = exact_quantiles(df, ["sku"], "quantity", [0.25, 0.5, 0.75], split, skew).filter("n >= 4").select(
        "sku",
        F.col("q")[1].alias("_median"),
        spread.alias("_iqr"),
        (F.col("q")[0] - k * spread).alias("_low"),
        (F.col("q")[2] + k * spread).alias("_high"),
    )
    q = F.col("quantity")
    outside = df.join(fences, "sku").filter((q < F.col("_low")) | (q > F.col("_high")))
    kind = F.when(q > F.col("_high"), "spike").when(q >= 0, "drop").otherwise("negative")
    beyond = F.when(q > F.col("_high"), q - F.col("_high")).otherwise(F.col("_low") - q)
    return _records(outside, q, F.col("_median"), kind, beyond / (F.col("_iqr") + 1), "iqr")


def detect_zscore(df: DataFrame, config: AnomalyConfig = ANOMALY) -> DataFrame:
    """A2: far from the item mean in sample deviations."""
    moments = (
        df.groupBy("sku")
        .agg(F.avg("quantity").alias("_mean"), F.stddev_samp("quantity").alias("_sd"), F.count("quantity").alias("_n"))
        .filter((F.col("_n") >= 3) & (F.col("_sd") > 0))
    )
    q, mean = F.col("quantity"), F.col("_mean")
    z = F.abs(q - mean) / F.col("_sd")
    outside = df.join(moments, "sku").filter(z > config.z_threshold)
    return _records(outside, q, mean, F.when(q > mean, "spike").otherwise("drop"), z / (config.z_threshold * 2), "zscore")


def detect_rolling(
    df: DataFrame, config: AnomalyConfig = ANOMALY, skew: SkewConfig = SKEW, split: bool | None = None
) -> DataFrame:
    """A3: far from the mean of a centred row window; only full windows of known values count."""
    size = config.rolling_window
    back, ahead = size // 2, size - 1 - size // 2

    parts, passed = {"_count": F.count(F.lit(1))}, [{"_rows": altogether(F.sum("_count"))}]
    rows = ordered_rows(df, before=back, after=ahead, skew=skew, split=split, parts=parts, passed=passed)
    frame = rows.window().rowsBetween(-back, ahead)
    measured = rows.with_columns({
        "_mean": F.avg("quantity").over(frame),
        "_sd": F.stddev_samp("quantity").over(frame),
        "_known": F.count("quantity").over(frame),
        "_rows": rows.of_item(F.count(F.lit(1)), rows.passed("_rows")),
    }).own_rows()
    q, mean, t = F.col("quantity"), F.col("_mean"), config.rolling_threshold
    z = F.abs(q - mean) / F.col("_sd")
    outside = measured.filter(
        (F.col("_rows") >= size + 1) & (F.col("_known") == size) & (F.col("_sd") > 0)
    ).filter(z > t)
    return _records(outside, q, mean, F.when(q > mean, "spike").otherwise("drop"), z / (t * 2), "rolling")


def detect_zeros(
    df: DataFrame, config: AnomalyConfig = ANOMALY, skew: SkewConfig = SKEW, split: bool | None = None
) -> DataFrame:
    """A4: runs of zeros. A run shares its count of non-zero rows before it, across segments too."""
    other = F.when(F.col("quantity") == 0, 0).otherwise(1)

    parts = {"_others": F.sum(other), "_sum": F.sum("quantity"), "_count": F.count("quantity")}
    mean = F.try_divide(altogether(F.sum("_sum")), altogether(F.sum("_count")))
    rows = ordered_rows(df, skew=skew, split=split, parts=parts, passed=[{"_before": running("_others"), "_mean": mean}])
    upto = rows.window().rowsBetween(Window.unboundedPreceding, 0)
    found = (
        rows.with_columns({
            "_run": F.sum(other).over(upto) + F.coalesce(rows.passed("_before"), F.lit(0)),
            "_mean": rows.of_item(F.avg("quantity"), rows.passed("_mean")),
        }).own_rows()
        .filter((F.col("quantity") == 0) & F.col("sku").isNotNull())
        .groupBy("sku", "_run")
        .agg(F.count(F.lit(1)).alias("_length"), F.min("date").alias("date"), F.first("_mean").alias("_mean"))
        .filter(F.col("_length") >= config.min_zero_run)
    )
    return _records(found, F.lit(0.0), F.col("_mean"), F.lit("zero"), F.col("_length") / 10, "zero_detection")


def detect_gaps(df: DataFrame, freq: str = "D") -> DataFrame:
    """A5: runs of missing calendar periods between an item's first and last date."""
    days = df.select("sku", "date").distinct()
    if freq == "D":
        following = F.lead("date").over(Window.partitionBy("sku").orderBy("date"))  # one row per day
        gaps = (
            days.withColumn("_next", following)
            .withColumn("_length", F.datediff("_next", "date") - 1)
            .filter("_length > 0")
            .withColumn("date", F.date_add("date", 1))
        )
    else:
        span = days.groupBy("sku").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
        labels = period_sequence(period_end(F.col("_a"), freq), period_end(F.col("_b"), freq), freq)
        calendar = span.select("sku", "_b", F.posexplode(labels).alias("_pos", "date")).filter("date <= _b")
        missing = calendar.join(days, ["sku", "date"], "left_anti")
        place = F.row_number().over(Window.partitionBy("sku").orderBy("_pos"))  # one row per period
        gaps = (
            missing.withColumn("_run", F.col("_pos") - place)
            .groupBy("sku", "_run")
            .agg(F.count(F.lit(1)).alias("_length"), F.min("date").alias("date"))
        )
    return _records(gaps, F.lit(0.0), F.lit(0.0), F.lit("gap"), F.col("_length") / 7, "gap_detection")


def detect(df: DataFrame, method: str = "iqr", config: AnomalyConfig = ANOMALY, skew: SkewConfig = SKEW) -> DataFrame:
    """All items at once; an unknown method means iqr."""
    if method == "zscore":
        return detect_zscore(df, config)
    if method == "rolling":
        return detect_rolling(df, config, skew)
    if method == "zeros":
        return detect_zeros(df, config, skew)
    if method == "gaps":
        return detect_gaps(df)
    return detect_iqr(df, config, skew)


def detect_many(df: DataFrame, methods, config: AnomalyConfig = ANOMALY, skew: SkewConfig = SKEW) -> DataFrame:
    first, *rest = [detect(df, method, config, skew).select(*ANOMALY_COLUMNS) for method in methods]
    for table in rest:
        first = first.unionByName(table)
    return first


def playlist(anomalies: DataFrame, min_severity: float = 0.5) -> DataFrame:
    """A7."""
    return anomalies.filter(F.col("severity") >= min_severity).orderBy(F.desc("severity"), "sku", "date", "value")


def summary(anomalies: DataFrame) -> DataFrame:
    """One row with totals and the count per type."""
    per_type = anomalies.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("severity").alias("s")
    )
    totals = per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("avg_severity"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("anomaly_type", "n")))).alias("by_type"),  # <= 5 types
    )
    affected = anomalies.select("sku").distinct().agg(F.count(F.lit(1)).alias("items_with_anomalies"))
    return totals.crossJoin(F.broadcast(affected))  # one row


def count_by_type(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("anomalies"))


def description(kind: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, words in ANOMALY_TEXTS.items():
        text = F.when(kind == name, words).otherwise(text)
    return text


def export(anomalies: DataFrame) -> DataFrame:
    """Report columns; the action is "Pending" until one is chosen."""
    action = F.coalesce(F.col("action"), F.lit("Pending")) if "action" in anomalies.columns else F.lit("Pending")
    return anomalies.select(
        "sku",
        "date",
        "value",
        F.col("expected_value").alias("expected"),
        F.col("anomaly_type").alias("type"),
        "severity",
        "method",
        description(F.col("anomaly_type")).alias("description"),
        action.alias("action"),
    )


def filter_anomalies(
    anomalies: DataFrame, kind: str | None = None, severity_band: str | None = None, text: str = ""
) -> DataFrame:
    """A10: by type, by "high" (0.7) or "medium" (0.4) severity and above, by text in any column."""
    if kind is not None:
        anomalies = anomalies.filter(F.col("anomaly_type") == kind)
    least = {"high": 0.7, "medium": 0.4}.get(severity_band or "")
    if least is not None:
        anomalies = anomalies.filter(F.col("severity") >= least)
    if text.strip():
        shown = F.concat_ws("\u0001", "sku", F.col("date").cast("string"), "anomaly_type", "method")
        anomalies = anomalies.filter(F.lower(shown).contains(text.strip().lower()))
    return anomalies


def with_deviation(anomalies: DataFrame) -> DataFrame:
    """A11."""
    off = F.col("value") - F.col("expected_value")
    pct = F.coalesce(F.try_divide(off, F.col("expected_value")) * 100, F.lit(0.0))
    return anomalies.withColumns({"deviation": off, "deviation_pct": pct})


def apply_corrections(df: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Quantity replaced by the expected value at (sku, date); the severest anomaly wins."""
    place = F.struct(-F.col("severity"), F.col("value"), F.col("method"))
    new_values = anomalies.groupBy("sku", "date").agg(F.min_by("expected_value", place).alias("_new"))
    joined = df.join(new_values, ["sku", "date"], "left")
    return joined.withColumn("quantity", F.coalesce("_new", "quantity")).select(*df.columns)


def apply_removals(df: DataFrame, anomalies: DataFrame) -> DataFrame:
    """A13."""
    return df.join(anomalies.select("sku", "date"), ["sku", "date"], "left_anti").select(*df.columns)


def apply_actions(df: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Corrections, then removals, from an anomaly table with an ``action`` column."""
    corrected = apply_corrections(df, reviewed.filter(F.col("action") == "Auto-correct"))
    return apply_removals(corrected, reviewed.filter(F.col("action") == "Remove"))


def action_counts(reviewed: DataFrame) -> DataFrame:
    """Chosen actions, without the pending ones."""
    chosen = reviewed.filter(F.col("action") != "Pending")
    return chosen.groupBy("action").agg(F.count(F.lit(1)).alias("anomalies"))


def flagged_items(reviewed: DataFrame) -> DataFrame:
    """A14."""
    return reviewed.filter(F.col("action") == "Flag").select("sku").distinct()
