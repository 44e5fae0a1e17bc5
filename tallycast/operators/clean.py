"""Repairs of missing, repeated, negative and outlying values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.config import SKEW, SkewConfig
from tallycast.functions.dates import period_end, period_sequence
from tallycast.functions.scale import earlier, later, ordered_rows


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != "row_id"]


def fill_neighbour(
    df: DataFrame,
    columns: Sequence[str],
    forward: bool = True,
    skew: SkewConfig = SKEW,
    split: bool | None = None,
) -> DataFrame:
    """nearest known value before (or after) the row within its item.

    Backward the rows are numbered and read from the last one, because a frame that ends at the last row is
    read anew for every row.
    """
    edge, side = (F.max_by, earlier) if forward else (F.min_by, later)
    place = F.struct("date", "row_id")
    parts = {f"_edge_{name}": edge(F.col(name), F.when(F.col(name).isNotNull(), place)) for name in columns}
    passed = [{f"_next_{name}": side(f"_edge_{name}") for name in columns}]
    rows = ordered_rows(df, skew=skew, split=split, parts=parts, passed=passed)
    window = rows.window()
    if not forward:
        rows = rows.with_columns({"_place": F.row_number().over(window)})
        window = Window.partitionBy(*rows.keys).orderBy(F.desc("_place"))
    frame = window.rowsBetween(Window.unboundedPreceding, 0)
    filled = {name: F.coalesce(F.last(name, ignorenulls=True).over(frame), rows.passed(f"_next_{name}")) for name in columns}
    return rows.with_columns(filled).own_rows().select(*df.columns)


def fill_zero(df: DataFrame) -> DataFrame:
    """numeric columns only."""
    return df.fillna(0, subset=_numeric(df))


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """overall mean of each numeric column."""
    names = list(columns or _numeric(df))
    means = df.agg(*[F.avg(name).alias(f"_mean_{name}") for name in names])
    filled = {
        name: F.coalesce(F.col(name), F.col(f"_mean_{name}").cast(df.schema[name].dataType)) for name in names
    }
    return df.crossJoin(F.broadcast(means)).withColumns(filled).select(*df.columns)  # one row


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F4."""
    return df.dropna(subset=list(columns))


def collapse_duplicates(df: DataFrame, method: str = "sum") -> DataFrame:
    """one row per (sku, date): quantity summed or averaged, first known value of the rest."""
    quantity = F.avg("quantity") if method == "mean" else F.coalesce(F.sum("quantity"), F.lit(0.0))
    others = [name for name in df.columns if name not in ("sku", "date", "quantity", "row_id")]
    first_known = [
        F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("row_id"))).alias(name) for name in others
    ]
    return (
        df.groupBy("sku", "date")
        .agg(F.min("row_id").alias("row_id"), quantity.alias("quantity"), *first_known)
        .select(*df.columns)
    )


def keep_first(df: DataFrame) -> DataFrame:
    """an aggregate, not a row number, so that copies are dropped before the shuffle."""
    whole = F.struct(*df.columns)
    return df.groupBy("sku", "date").agg(F.min_by(whole, F.col("row_id")).alias("_row")).select("_row.*")


def remove_duplicates(df: DataFrame, method: str = "sum") -> DataFrame:
    return keep_first(df) if method == "first" else collapse_duplicates(df, method)


def fix_negatives(df: DataFrame, method: str = "zero") -> DataFrame:
    """F7."""
    fixed = F.abs("quantity") if method == "absolute" else F.when(F.col("quantity") < 0, 0.0).otherwise(F.col("quantity"))
    return df.withColumn("quantity", fixed)


def fix_outliers(df: DataFrame, method: str = "remove", threshold: float = 3.0) -> DataFrame:
    """F8: outside mean +- threshold * sample deviation: dropped or capped. Nulls stay."""
    moments = df.agg(F.avg("quantity").alias("_m"), F.stddev_samp("quantity").alias("_s"))
    bounded = df.crossJoin(F.broadcast(moments))  # one row
    low = F.col("_m") - threshold * F.col("_s")
    high = F.col("_m") + threshold * F.col("_s")
    usable = F.col("_s") > 0
    if method == "cap":
        value = F.when(usable & (F.col("quantity") < low), low).when(usable & (F.col("quantity") > high), high)
        out = bounded.withColumn("quantity", F.coalesce(value, F.col("quantity")))
    else:
        beyond = usable & ((F.col("quantity") < low) | (F.col("quantity") > high))
        out = bounded.filter(~F.coalesce(beyond, F.lit(False)))
    return out.select(*df.columns)


FIX_ORDER = ("missing", "duplicates", "negative", "outliers")


def fill_missing(df: DataFrame, method: str = "ffill", columns: Sequence[str] = (), skew: SkewConfig = SKEW) -> DataFrame:
    columns = list(columns) or [name for name in df.columns if name not in ("sku", "date", "row_id")]
    if method == "zero":
        return fill_zero(df)
    if method == "mean":
        return fill_mean(df)
    if method == "remove":
        return drop_missing(df, columns)
    return fill_neighbour(df, columns, forward=method != "bfill", skew=skew)


def apply_fixes(df: DataFrame, fixes: dict[str, str], skew: SkewConfig = SKEW) -> DataFrame:
    """``{kind: method}`` applied in the fixed order, as one plan."""
    unknown = set(fixes) - set(FIX_ORDER)
    if unknown:
        raise ValueError(f"unknown fix type: {sorted(unknown)[0]}")
    for kind in FIX_ORDER:
        if kind not in fixes:
            continue
        method = fixes[kind]
        if kind == "missing":
            df = fill_missing(df, method, skew=skew)
        elif kind == "duplicates":
            df = remove_duplicates(df, method)
        elif kind == "negative":
            df = fix_negatives(df, method)
        else:
            df = fix_outliers(df, method)
    return df


def fill_date_gaps(df: DataFrame, freq: str = "D") -> DataFrame:
    """a row of nulls for each calendar period of an item that has no row.

    Only the missing dates are generated and added; existing rows are not shuffled.
    """
    per_item = df.groupBy("sku").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    first, last = period_end(F.col("_a"), freq), period_end(F.col("_b"), freq)
    if freq != "D":  # labels beyond the last date are not part of the range
        last = F.when(last > F.col("_b"), _previous_label(last, freq)).otherwise(last)
    calendar = per_item.filter(first <= last).select(
        "sku", F.explode(period_sequence(first, last, freq)).alias("date")
    )
    missing = calendar.join(df.select("sku", "date").distinct(), ["sku", "date"], "left_anti")
    kept = df if freq == "D" else df.join(calendar, ["sku", "date"], "left_semi")
    return kept.unionByName(missing, allowMissingColumns=True)


def _previous_label(label, freq: str):
    return F.date_sub(label, 7) if freq == "W" else F.last_day(F.add_months(label, -1))
