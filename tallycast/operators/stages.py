"""Watch-lists, session counts, stage tables and user functions per series (K1-K5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.schema import Mapping
from tallycast.sources.files import read_bundle, write_bundle

MAPPING_TABLE = "_mapping"


def add_bookmarks(bookmarks: DataFrame, new: DataFrame) -> DataFrame:
    """K1: upsert by sku; an existing entry keeps its time and takes the latest note."""
    both = bookmarks.unionByName(new)
    return both.groupBy("sku").agg(F.max_by("note", "added_at").alias("note"), F.min("added_at").alias("added_at"))


def remove_bookmarks(bookmarks: DataFrame, items: DataFrame) -> DataFrame:
    """K1."""
    return bookmarks.join(items.select("sku"), "sku", "left_anti")


def with_bookmarked(items: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """K1: adds the test ``is_bookmarked``."""
    marks = bookmarks.select("sku", F.lit(True).alias("is_bookmarked"))
    return items.join(marks, "sku", "left").fillna(False, subset=["is_bookmarked"])


def flag_items(flagged: DataFrame, new: DataFrame) -> DataFrame:
    """K2."""
    return flagged.select("sku").unionByName(new.select("sku")).distinct()


def session_summary(df: DataFrame, anomalies: DataFrame, results: DataFrame, bookmarks: DataFrame, quality: DataFrame) -> DataFrame:
    """K3: one row of counts over the stage tables."""
    def size(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias(name))

    row = size(df, "rows")
    for part in (
        size(df.select("sku").distinct(), "skus"),
        size(df.select("category").distinct(), "categories"),
        quality.select(F.col("overall_score").alias("quality_score")),
        size(results, "forecasts_count"),
        size(anomalies, "anomalies_count"),
        size(bookmarks, "bookmarks_count"),
    ):
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row


def save_stages(spark: SparkSession, path: str, tables: dict[str, DataFrame], mapping: Mapping) -> None:
    """K4: all stage tables and the mapping, replacing the ones saved before in one step."""
    settings = spark.createDataFrame(sorted(mapping.as_dict().items()), "role string, column string")
    write_bundle(spark, {**tables, MAPPING_TABLE: settings}, path)


def load_stages(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], Mapping]:
    """K4: the last complete save."""
    tables = read_bundle(spark, path)
    mapping = Mapping(**{row["role"]: row["column"] for row in tables.pop(MAPPING_TABLE).collect()})  # <= 6 rows
    return tables, mapping


def apply_per_item(packed: DataFrame, function: Callable[[str, list[float]], dict], schema: str) -> DataFrame:
    """K5: ``function(sku, ys)`` on each packed series, in Arrow batches.

    Items come packed per calendar period, so one call holds a bounded series and not all
    raw rows of the item.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([function(sku, ys) for sku, ys in zip(batch["sku"], batch["ys"])])

    return packed.select("sku", "ys").mapInPandas(run, schema)
