"""Projection of user tables to the canonical schema, and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.config import DATE_FORMATS
from tallycast.functions.dates import date_text, parse_date, to_date_with
from tallycast.schema import Mapping

SEPARATOR = "\u0001"


def settled_format(df: DataFrame, name: str) -> str | None:
    """The one known format that most values of a text column fit; month first where two fit as many.

    Day and month have one order in a column, whatever a single value would allow. The counts
    are taken over distinct texts, of which dates have few.
    """
    texts = df.groupBy(F.trim(F.col(name)).alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    fits = [
        F.sum(F.when(to_date_with(F.col("_text"), spark_format).isNotNull(), F.col("_n")).otherwise(0)).alias(f"f{i}")
        for i, (_, spark_format) in enumerate(DATE_FORMATS)
    ]
    row = texts.agg(*fits).first()
    counts = [row[f"f{i}"] or 0 for i in range(len(DATE_FORMATS))]
    month_first = [spark_format.startswith("M") for _, spark_format in DATE_FORMATS]
    best = max(range(len(counts)), key=lambda i: (counts[i], month_first[i], -i))
    return DATE_FORMATS[best][1] if counts[best] else None


def in_calendar(date: Column) -> Column:
    """Dates that 64-bit nanoseconds can hold; others are missing, which bounds the calendar of an item."""
    return F.when(date.between(F.lit("1677-09-22").cast("date"), F.lit("2262-04-11").cast("date")), date)


def to_date(df: DataFrame, name: str) -> Column:
    """Dates of a column: by its settled format or else any known one; numbers are read as yyyymmdd."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        settled = settled_format(df, name)
        fitting = [to_date_with(F.trim(F.col(name)), settled)] if settled else []
        return in_calendar(F.coalesce(*fitting, parse_date(F.col(name))))
    if isinstance(kind, T.NumericType):
        digits = F.col(name).try_cast("bigint").cast("string")
        return in_calendar(F.when(digits.rlike(r"^\d{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")))
    return in_calendar(F.col(name).cast("date"))


def to_number(name: str) -> Column:
    """A number, or null for other text and for NaN (which Spark would sort above all numbers)."""
    number = F.col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_promo(df: DataFrame, name: str) -> Column:
    """yes/true/y count as 1 and no/false/n as 0; anything else is read as a whole number."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.StringType):
        return F.coalesce(F.col(name).try_cast("double").try_cast("int"), F.lit(0))
    word = F.lower(F.trim(F.col(name)))
    number = F.when(word.isin("yes", "true", "y"), 1).when(word.isin("no", "false", "n"), 0)
    return F.coalesce(number, word.try_cast("double").try_cast("int"), F.lit(0))


def conform(df: DataFrame, mapping: Mapping, row_id: str | None = None) -> DataFrame:
    """One projection to the canonical schema; rows without a usable date go."""
    sku = F.trim(F.col(mapping.sku).cast("string"))
    category = F.trim(F.col(mapping.category).cast("string")) if mapping.category else F.substring(sku, 1, 3)
    price = to_number(mapping.price) if mapping.price else F.lit(None).cast("double")
    promo = to_promo(df, mapping.promo) if mapping.promo else F.lit(None).cast("int")
    order = F.col(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    date = to_date(df, mapping.date)
    if isinstance(df.schema[mapping.date].dataType, T.StringType):
        date = F.explode(F.array_compact(F.array(date)))  # drops bad dates without parsing twice
    return df.select(
        order.alias("row_id"),
        date.alias("date"),
        sku.alias("sku"),
        to_number(mapping.quantity).alias("quantity"),
        category.alias("category"),
        price.alias("price"),
        promo.alias("promo"),
    ).filter(F.col("date").isNotNull())


def item_rows(df: DataFrame, sku: str) -> DataFrame:
    """C2."""
    return df.filter(F.col("sku") == sku)


def rows_of_items(df: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose item is in ``items``."""
    return df.join(items.select("sku"), "sku", "left_semi")


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """C4: case-insensitive substring in any displayed column."""
    shown = [F.col(name).cast("string") for name in (columns or df.columns)]
    return df.filter(F.lower(F.concat_ws(SEPARATOR, *shown)).contains(text.strip().lower()))


def sort_by(df: DataFrame, column: str, descending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """C5."""
    first = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(first, *tie)


def items(df: DataFrame) -> DataFrame:
    """Distinct items with their category; the alphabetically first when there are several."""
    return df.groupBy("sku").agg(F.min("category").alias("category"))


def categories(df: DataFrame) -> DataFrame:
    return df.select("category").distinct()


def category_items(df: DataFrame) -> DataFrame:
    """Long form (category, sku), so that a category of any size is just many rows."""
    return df.select("category", "sku").distinct()


def format_shares(df: DataFrame, column: str, order: str = "row_id", sample: int = 100) -> DataFrame:
    """Share of the first ``sample`` values that each known format parses, one row each."""
    head = df.filter(F.col(column).isNotNull()).orderBy(order).limit(sample)
    text = F.trim(F.col(column))
    shares = [
        F.avg(to_date_with(text, spark_format).isNotNull().cast("double")).alias(f"f{i}")
        for i, (_, spark_format) in enumerate(DATE_FORMATS)
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("format_rank"), F.lit(name).alias("format"), F.col(f"f{i}").alias("share"))
        for i, (name, _) in enumerate(DATE_FORMATS)
    ])
    return head.agg(*shares).select(F.inline(rows))


def detect_date_format(df: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """One row (format, share); null format unless more than 80 % parse."""
    best = F.max_by(F.struct("format", "share"), F.struct("share", -F.col("format_rank"))).alias("best")
    row = format_shares(df, column, order).agg(best)
    return row.select(
        F.when(F.col("best.share") > 0.8, F.col("best.format")).alias("format"),
        F.col("best.share").alias("share"),
    )


def standardize_dates(df: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """Replace text dates by dates: by the detected format, and what it can't read by any known one.

    The format is settled first (one small row), so nearly all rows are parsed once.
    """
    found = detect_date_format(df, column, order).first()["format"]
    fitting = [] if found is None else [to_date_with(F.trim(F.col(column)), dict(DATE_FORMATS)[found])]
    return df.withColumn(column, F.coalesce(*fitting, parse_date(F.col(column))))


def strip_times(df: DataFrame) -> DataFrame:
    """C11: date text without time in every column with "date" in its name."""
    return df.withColumns({name: date_text(F.col(name)) for name in df.columns if "date" in name.lower()})


def display(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns that exist, or the first ten."""
    names = [name for name in columns if name in df.columns] if columns else df.columns[:10]
    return df.select(*names)


def finite_or_zero(value: Column) -> Column:
    """A number, or 0 for what is not a finite number."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, number).otherwise(F.lit(0.0))
