"""The given tables read as demand data, in Spark and in SQL, and the query register."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

ITEM_KEY = {"part": ("l_partkey", "l_suppkey"), "supp": ("l_suppkey", "l_partkey")}
ROW_ID = "(l_orderkey * 8 + l_linenumber) * 131072 + {other} % 131072"
PROMO = "cast(round(l_discount * 100) as int)"
DIRTY = "case when l_returnflag = 'R' then -nullif(l_quantity, 13) else nullif(l_quantity, 13) end"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def demand(spark: SparkSession, folder: str, by: str = "part", category: bool = False, quantity: str = "l_quantity") -> DataFrame:
    """lineitem in the canonical schema; the part table is joined only when its type is asked."""
    key, other = ITEM_KEY[by]
    lines = table(spark, folder, "lineitem")
    kind = "cast(null as string)"
    if category:
        lines = lines.join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
        kind = "p_type"
    return lines.selectExpr(
        f"{ROW_ID.format(other=other)} as row_id",
        "cast(l_shipdate as date) as date",
        f"cast({key} as string) as sku",
        f"{quantity} as quantity",
        f"{kind} as category",
        "l_extendedprice / l_quantity as price",
        f"{PROMO} as promo",
    )


def dirty(spark: SparkSession, folder: str, by: str = "part") -> DataFrame:
    return demand(spark, folder, by, quantity=DIRTY)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id as row_id", "cast(ts as date) as date", "cast(user_id as string) as sku", "value as quantity",
        "event_type as category", "cast(null as double) as price", "cast(null as int) as promo",
    )


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """An export as a user would bring it: own column names, dates as text."""
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part")
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        f"{ROW_ID.format(other='l_suppkey')} as row_id",
        "date_format(l_shipdate, 'dd/MM/yyyy') as trx_date",
        "concat(' P-', l_partkey, ' ') as product_id",
        "p_type as category_group",
        "l_quantity as sales_qty",
        "floor(l_extendedprice / l_quantity * 100 + 0.5) / 100D as unit_price",
        "case when l_discount > 0.05 then 'yes' else 'no' end as is_promo",
    )


def demand_sql(by: str = "part", category: bool = False, quantity: str = "l_quantity", name: str = "demand") -> str:
    key, other = ITEM_KEY[by]
    source = "lineitem JOIN part ON p_partkey = l_partkey" if category else "lineitem"
    kind = "p_type" if category else "CAST(NULL AS VARCHAR)"
    return f"""{name} AS (
        SELECT {ROW_ID.format(other=other)} AS row_id, CAST(l_shipdate AS DATE) AS date, CAST({key} AS VARCHAR) AS sku,
               {quantity} AS quantity, {kind} AS category, l_extendedprice / l_quantity AS price, {PROMO} AS promo
        FROM {source})"""


def events_sql(name: str = "demand") -> str:
    return f"""{name} AS (
        SELECT event_id AS row_id, CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS sku, value AS quantity,
               event_type AS category, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS INTEGER) AS promo
        FROM events)"""


RAW_SQL = f"""raw AS (
    SELECT {ROW_ID.format(other='l_suppkey')} AS row_id, strftime(l_shipdate, '%d/%m/%Y') AS trx_date,
           ' P-' || l_partkey || ' ' AS product_id, p_type AS category_group, l_quantity AS sales_qty,
           floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0 AS unit_price,
           CASE WHEN l_discount > 0.05 THEN 'yes' ELSE 'no' END AS is_promo
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _parts(spec: str) -> list[tuple[str, str]]:
    return [tuple((item.strip() + ":s").split(":")[:2]) for item in spec.split(",")]


def _scales(kind: str) -> tuple[float, float]:
    """Rounding in two steps, so that the last bit of a sum cannot tip an exact half."""
    digits = int(kind[1:] or 6)
    return 10.0 ** (digits + 3), 10.0 ** digits


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Columns of ``spec``: ``name`` as is, ``name:i`` whole number, ``name:d4`` rounded number."""
    columns = []
    for name, kind in _parts(spec):
        column = F.col(name)
        if kind == "i":
            column = column.cast("bigint")
        elif kind.startswith("d"):
            column = column.cast("double")
            for scale in _scales(kind):
                column = F.rint(column * scale) / scale
            column = column + 0.0
        columns.append(column.alias(name))
    return df.select(*columns)


def shape_sql(sql: str, spec: str) -> str:
    columns = []
    for name, kind in _parts(spec):
        text = f'"{name}"'
        if kind == "i":
            text = f"CAST({text} AS BIGINT)"
        elif kind.startswith("d"):
            text = f"CAST({text} AS DOUBLE)"
            for scale in _scales(kind):
                text = f"round_even({text} * CAST({scale!r} AS DOUBLE), 0) / CAST({scale!r} AS DOUBLE)"
            text = f"{text} + CAST(0 AS DOUBLE)"
        columns.append(f'{text} AS "{name}"')
    return f"SELECT {', '.join(columns)} FROM ({sql}) AS result"


@dataclass
class Register:
    """Queries of one module with the SQL that gives the same rows."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, spec: str, sql: str | None, query: Query) -> None:
        self.queries[name] = lambda spark, folder: shape(query(spark, folder), spec)
        if sql is not None:
            self.oracles[name] = shape_sql(sql, spec)
