"""Item samples and sparkline rows (B1-B4). Samples are drawn by a seeded hash of the item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import SAMPLE_SEED, SKEW, SkewConfig
from tallycast.functions.scale import Ordered, altogether, exact_quantiles, join_same, ordered_rows, running


def draw(seed: int = SAMPLE_SEED, key: str = "sku") -> Column:
    """Uniform, reproducible order of items."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))


def random_items(items: DataFrame, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """B1: n items, or all when there are fewer."""
    return items.select("sku").orderBy(draw(seed), "sku").limit(n)


def stratified_items(items: DataFrame, group: str, n: int, groups: int | None = None, seed: int = SAMPLE_SEED) -> DataFrame:
    """B2: max(1, n // groups) items of each group, n in all; all items when there are no more.

    The per-group limit is a literal, so Spark trims each group before the shuffle.
    """
    size = items.agg(F.count(F.lit(1)).alias("items"), F.count_distinct(group).alias("groups")).first()
    if size["items"] <= n:
        return items.select("sku", group)
    per_group = max(1, n // (groups or max(1, size["groups"])))
    place = F.row_number().over(Window.partitionBy(group).orderBy(draw(seed), "sku"))
    chosen = items.select("sku", group).withColumn("_place", place).filter(F.col("_place") <= per_group)
    return chosen.orderBy(group, "_place").limit(n).select("sku", group)


def representative_items(totals: DataFrame, n: int = 20, seed: int = SAMPLE_SEED) -> DataFrame:
    """N // 4 items of each volume quarter (closed at both ends), without repeats."""
    count = totals.count()
    if count <= n:
        return totals.select("sku")
    marks = exact_quantiles(totals, [], "total_volume", [0.0, 0.25, 0.5, 0.75, 1.0])
    volume = F.col("total_volume")
    bands = F.array_compact(F.array(*[
        F.when((volume >= F.col("q")[i]) & (volume <= F.col("q")[i + 1]), F.lit(i)) for i in range(4)
    ]))
    banded = totals.crossJoin(F.broadcast(marks)).select("sku", F.explode(bands).alias("_band"))  # one row
    place = F.row_number().over(Window.partitionBy("_band").orderBy(draw(seed), "sku"))
    chosen = banded.withColumn("_place", place).filter(F.col("_place") <= n // 4)
    return chosen.select("sku").distinct().orderBy("sku").limit(n)


def _numbered(df: DataFrame, skew: SkewConfig, split: bool | None) -> Ordered:
    passed = [{"_ahead": running("_rows"), "_n": altogether(F.sum("_rows"))}]
    return ordered_rows(df, skew=skew, split=split, parts={"_rows": F.count(F.lit(1))}, passed=passed)


def sparkline_order(
    df: DataFrame, by: str = "name", top: int = 20, skew: SkewConfig = SKEW, split: bool | None = None
) -> DataFrame:
    """The first ``top`` items by name, volume_high, volume_low or trend.

    Trend is the mean of the later half of the item's values less that of the earlier half.
    """
    finite = df.filter(F.col("quantity").isNotNull() & ~F.isnan("quantity") & (F.abs("quantity") != float("inf")))
    if by == "trend":
        rows = _numbered(finite, skew, split)
        placed = rows.with_columns({"_x": rows.row_index(), "_n": rows.of_item(F.count(F.lit(1)), rows.passed("_n"))}).own_rows()
        early = F.col("_x") < F.floor(F.col("_n") / 2)
        halves = placed.groupBy("sku").agg(
            F.avg(F.when(early, F.col("quantity"))).alias("_first"),
            F.avg(F.when(~early, F.col("quantity"))).alias("_second"),
        )
        measured = halves.select("sku", F.coalesce(F.col("_second") - F.col("_first"), F.lit(0.0)).alias("measure"))
    else:
        measured = finite.groupBy("sku").agg(F.sum("quantity").alias("measure"))
    order = {"name": [F.asc("sku")], "volume_low": [F.asc("measure"), F.asc("sku")]}
    return measured.orderBy(*order.get(by, [F.desc("measure"), F.asc("sku")])).limit(top)


def sparkline_rows(
    df: DataFrame, by: str = "name", top: int = 20, skew: SkewConfig = SKEW, split: bool | None = None
) -> DataFrame:
    """Date-ordered finite values of the chosen items, one row per value."""
    finite = df.filter(F.col("quantity").isNotNull() & ~F.isnan("quantity") & (F.abs("quantity") != float("inf")))
    chosen = sparkline_order(df, by, top, skew, split).select("sku")

    rows = _numbered(join_same(finite, chosen, ["sku"], "left_semi", small=True), skew, split)  # top rows
    placed = rows.with_columns({"position": rows.row_index()}).own_rows()
    return placed.select("sku", "position", "date", F.col("quantity").alias("y"))
