"""Volume classes, rule clusters and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.config import CLUSTER, PATTERN_LABELS, PATTERNS, TIER_LABELS, TIERS, ClusterConfig
from tallycast.functions.scale import kept, ranked


def item_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("sku").agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_volume"))


def abc_classes(df: DataFrame, a_limit: float = 80.0, b_limit: float = 130.0) -> DataFrame:
    """G1: class by the running share of volume, largest items first.

    The default limits reproduce the published behaviour (80, 80 + 50); pass
    ``b_limit=95`` for the usual split.
    """
    totals = kept(item_totals(df))
    grand = totals.agg(F.sum("total_volume").alias("_grand"))
    share = F.try_divide(F.col("running"), F.col("_grand")) * 100
    return (
        ranked(totals, "total_volume")
        .crossJoin(F.broadcast(grand))  # one row
        .withColumn("cumulative_pct", share)
        .withColumn("abc_class", F.when(share <= a_limit, "A").when(share <= b_limit, "B").otherwise("C"))
        .select("sku", "total_volume", "cumulative_pct", "abc_class")
    )


def abc_summary(classes: DataFrame) -> DataFrame:
    """Items per class and their share, with a row for every class."""
    counts = classes.groupBy("abc_class").agg(F.count(F.lit(1)).alias("items"))
    return _share_of_items(_with_all(counts, "abc_class", TIERS).fillna(0, subset=["items"]))


def _share_of_items(table: DataFrame) -> DataFrame:
    """For tables of a few rows."""
    total = table.agg(F.sum("items").alias("_all"))
    pct = F.coalesce(F.try_divide(F.col("items") * 100.0, F.col("_all")), F.lit(0.0))
    return table.crossJoin(F.broadcast(total)).withColumn("pct_of_items", pct).drop("_all")


def _with_all(table: DataFrame, column: str, values) -> DataFrame:
    every = table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(value) for value in values])).alias(column))
    return F.broadcast(every).join(table, column, "left")


def item_metrics(df: DataFrame) -> DataFrame:
    """Totals, spread and fourth-quarter share per item, in one aggregation."""
    in_q4 = F.month("date").isin(10, 11, 12)
    raw = df.groupBy("sku").agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_volume"),
        F.avg("quantity").alias("mean_volume"),
        F.stddev_samp("quantity").alias("std_volume"),
        F.coalesce(F.sum(F.when(in_q4, F.col("quantity"))), F.lit(0.0)).alias("q4_volume"),
        F.count(F.lit(1)).alias("data_points"),
    )
    cv = F.when(F.col("mean_volume") > 0, F.col("std_volume") / F.col("mean_volume")).otherwise(F.lit(0.0))
    q4 = F.when(F.col("total_volume") > 0, F.col("q4_volume") / F.col("total_volume")).otherwise(F.lit(0.0))
    return raw.withColumns({"cv": cv, "q4_concentration": q4}).drop("q4_volume")


def volume_thresholds(metrics: DataFrame, config: ClusterConfig = CLUSTER) -> DataFrame:
    """One row (a_threshold, b_threshold), the volumes at two ranks of the descending list."""
    if config.fixed_volumes:
        a, b = config.fixed_volumes
        return metrics.sparkSession.range(1).select(F.lit(float(a)).alias("a_threshold"), F.lit(float(b)).alias("b_threshold"))
    # equal volumes share one row, so the ranks need no tie order
    volumes = kept(metrics.groupBy("total_volume").agg(F.count(F.lit(1)).alias("items")))
    size = volumes.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("_all"))
    keyed = volumes.withColumn("_key", F.col("total_volume").cast("string"))
    placed = ranked(keyed, "total_volume", "_key", weight="items")

    def at(top: float) -> Column:
        index = F.least(F.floor(F.col("_all") * (100 - top) / 100), F.col("_all") - 1)
        inside = (F.col("rank") > index) & (F.col("rank") - F.col("items") <= index)
        return F.max(F.when(inside, F.col("total_volume")))

    a, b = config.top_percentiles
    return placed.crossJoin(F.broadcast(size)).agg(at(a).alias("a_threshold"), at(b).alias("b_threshold"))  # one row


def volume_tier(volume: Column, a: Column, b: Column) -> Column:
    """G5."""
    return F.when(volume >= a, "A").when(volume >= b, "B").otherwise("C")


def pattern_type(cv: Column, q4: Column, config: ClusterConfig = CLUSTER) -> Column:
    """G6."""
    return (
        F.when(q4 >= config.seasonal, "seasonal")
        .when(cv >= config.erratic, "erratic")
        .when(cv >= config.variable, "variable")
        .otherwise("steady")
    )


def _label(column: str, labels: dict[str, str]) -> Column:
    text = F.col(column)
    for value, label in labels.items():
        text = F.when(F.col(column) == value, label).otherwise(text)
    return text


def cluster_items(df: DataFrame, config: ClusterConfig = CLUSTER) -> DataFrame:
    """Tier, pattern and label per item."""
    metrics = kept(item_metrics(df))
    return (
        metrics.crossJoin(F.broadcast(volume_thresholds(metrics, config)))  # one row
        .withColumn("volume_tier", volume_tier(F.col("total_volume"), F.col("a_threshold"), F.col("b_threshold")))
        .withColumn("pattern_type", pattern_type(F.col("cv"), F.col("q4_concentration"), config))
        .withColumn("cluster", F.concat(_label("volume_tier", TIER_LABELS), F.lit(" - "), _label("pattern_type", PATTERN_LABELS)))
        .select("sku", "volume_tier", "pattern_type", "cluster", "total_volume", "cv", "q4_concentration")
    )


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """At most twelve rows, ordered by tier and pattern."""
    groups = clusters.groupBy("volume_tier", "pattern_type", "cluster").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("total_volume").alias("total_volume")
    )
    whole = groups.agg(F.sum("item_count").alias("_items"), F.sum("total_volume").alias("_volume"))
    share = F.when(F.col("_volume") > 0, F.col("total_volume") / F.col("_volume") * 100).otherwise(F.lit(0.0))
    return (
        groups.crossJoin(F.broadcast(whole))  # one row
        .withColumn("pct_of_items", F.col("item_count") / F.col("_items") * 100)
        .withColumn("pct_of_volume", share)
        .drop("_items", "_volume")
        .orderBy("volume_tier", "pattern_type")
    )


def cluster_matrix(clusters: DataFrame) -> DataFrame:
    """Tier by pattern counts, zero where no item falls."""
    counts = clusters.groupBy("volume_tier").pivot("pattern_type", list(PATTERNS)).count()
    return _with_all(counts, "volume_tier", TIERS).fillna(0, subset=list(PATTERNS))


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """All items and the fullest cell (first in tier, then pattern order)."""
    cells = matrix.select("volume_tier", F.inline(F.array(*[
        F.struct(F.lit(i).alias("pattern_rank"), F.lit(name).alias("pattern_type"), F.col(name).alias("items"))
        for i, name in enumerate(PATTERNS)
    ])))
    tier_rank = F.ascii("volume_tier")
    largest = F.max_by(F.struct("volume_tier", "pattern_type", "items"), F.struct("items", -tier_rank, -F.col("pattern_rank")))
    return cells.agg(F.sum("items").alias("total_items"), largest.alias("_top")).select(
        "total_items",
        F.col("_top.volume_tier").alias("largest_tier"),
        F.col("_top.pattern_type").alias("largest_pattern"),
        F.col("_top.items").alias("largest_items"),
    )


def select_clusters(
    clusters: DataFrame, tier: str | None = None, pattern: str | None = None, sku: str | None = None
) -> DataFrame:
    """By tier, by pattern, by both, or one item."""
    for column, value in (("volume_tier", tier), ("pattern_type", pattern), ("sku", sku)):
        if value is not None:
            clusters = clusters.filter(F.col(column) == value)
    return clusters


def navigator(items: DataFrame, group: str, text: str = "") -> DataFrame:
    """Groups with their number of items, after a search in the item name."""
    found = items.filter(F.lower("sku").contains(text.lower()))
    return found.groupBy(F.col(group).alias("group_name")).agg(F.count(F.lit(1)).alias("items"))


def navigator_items(items: DataFrame, group: str, text: str = "") -> DataFrame:
    """The members as rows (group_name, sku), however many a group has."""
    found = items.filter(F.lower("sku").contains(text.lower()))
    return found.select(F.col(group).alias("group_name"), "sku")


def item_details(clusters: DataFrame, metrics: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Cluster, forecast error and number of anomalies per item."""
    counts = anomalies.groupBy("sku").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return (
        clusters.join(metrics.select("sku", "mape"), "sku", "left")
        .join(counts, "sku", "left")
        .fillna(0, subset=["anomaly_count"])
    )
