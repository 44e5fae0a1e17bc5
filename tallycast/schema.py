"""Canonical column names and the mapping from user columns to roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DEMAND = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("sku", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("promo", T.IntegerType()),
])

ANOMALY_COLUMNS = ("sku", "date", "value", "expected_value", "anomaly_type", "severity", "method")


@dataclass(frozen=True)
class Mapping:
    """Which user column plays which role; optional roles may be absent."""

    date: str
    sku: str
    quantity: str
    category: str | None = None
    price: str | None = None
    promo: str | None = None

    def as_dict(self) -> dict[str, str]:
        return {role: name for role, name in vars(self).items() if name is not None}
