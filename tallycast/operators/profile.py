"""Which column plays which role: scores, best mapping, validation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.config import (
    DETECTION_TEXTS, MAPPING_ERRORS, PROMO_WORDS, REQUIRED_ROLES, ROLE_KEYWORDS, ROLE_THRESHOLD, ROLES,
)
from tallycast.functions.dates import parse_date
from tallycast.schema import Mapping

SAMPLE = 100
PARSED = 20
MERGED_IN = 64  # groups of tasks whose samples are merged first


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "object"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.IntegralType):
        return "int"
    return "bool" if isinstance(dtype, T.BooleanType) else "other"


def _first_known(count: int, k: int = SAMPLE):
    """Keeps, per task and column, the ``k`` known values of least place; a batch beyond them is passed over."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [np.zeros(0, np.int64)] * count
        values: list[list[str]] = [[] for _ in range(count)]
        for batch in batches:
            place = batch.column(0).to_numpy()
            for c in range(count):
                wanted = batch.column(c + 1).is_valid().to_numpy(zero_copy_only=False)
                if len(places[c]) == k:
                    wanted = wanted & (place < places[c][-1])
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                at = at[np.argsort(place[at], kind="stable")[:k]]
                both = np.concatenate([places[c], place[at]])
                texts = values[c] + batch.column(c + 1).take(pa.array(at)).to_pylist()
                order = np.argsort(both, kind="stable")[:k]
                places[c], values[c] = both[order], [texts[i] for i in order]
        pos = np.repeat(np.arange(count, dtype=np.int32), [len(p) for p in places])
        texts = [text for part in values for text in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos), pa.array(np.concatenate([np.zeros(0, np.int64), *places])), pa.array(texts, pa.string())], ["_at", "place", "value"])
    return work


def sample_values(df: DataFrame, order: str | None = "row_id") -> DataFrame:
    """First 100 known values of each column as (pos, column, kind, rank, value) text rows.

    One scan of the table; a task hands on at most 100 values per column, and these are merged in two steps.
    """
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))) if order else F.monotonically_increasing_id()
    fields = [(position, field) for position, field in enumerate(df.schema) if field.name != order]
    texts = [F.col(f"`{field.name}`").cast("string").alias(f"c{i}") for i, (_, field) in enumerate(fields)]
    found = df.select(place.alias("place"), *texts).mapInArrow(_first_known(len(fields)), "_at int, place long, value string")

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE)

    shares = found.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(MERGED_IN)))
    about = F.array(*[
        F.struct(F.lit(position).alias("pos"), F.lit(field.name).alias("column"), F.lit(kind_of(field.dataType)).alias("kind"))
        for position, field in fields
    ])
    merged = first(first(shares, "_at", "_share").drop("rank"), "_at")
    return merged.withColumn("_about", F.get(about, F.col("_at"))).select("_about.*", "place", "value", "rank")


def _keyword(role: str, points: float) -> Column:
    name = F.lower(F.trim("column"))
    found = reduce(lambda a, b: a | b, [F.contains(name, F.lit(word)) for word in ROLE_KEYWORDS[role]])
    return F.when(found, points).otherwise(0.0)


def _share(test: Column, among: Column | None = None) -> Column:
    flag = F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)
    return F.coalesce(F.avg(flag if among is None else F.when(among, flag)), F.lit(0.0))


def column_stats(sample: DataFrame) -> DataFrame:
    """One row per column with every share the scores need (at most 100 values each).

    A text column whose sampled values all read as numbers is numeric: CSV columns are text.
    """
    value, text = F.col("value"), F.lower("value")
    number = value.try_cast("double")
    first = F.col("rank") <= PARSED
    reads_as = (
        F.when((F.col("kind") != "object") | F.bool_or(number.isNull() | F.isnan(number)), F.col("kind"))
        .when(F.bool_and(value.rlike(r"^\s*[+-]?\d+\s*$")), "int").otherwise("float")
    )
    return sample.groupBy("pos", "column", "kind").agg(
        reads_as.alias("_kind"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("value").alias("distinct_values"),
        _share(parse_date(value).isNotNull(), first).alias("date_share"),
        _share(value.rlike(r"^[A-Za-z0-9\-_]+$"), first).alias("code_share"),
        _share(number >= 0, number.isNotNull()).alias("nonnegative_share"),
        _share(number == F.floor(number), number.isNotNull()).alias("whole_share"),
        _share(number > 0, number.isNotNull()).alias("positive_share"),
        _share(value.rlike(r"\.\d{2}$"), number.isNotNull()).alias("cents_share"),
        _share(text.isin(*PROMO_WORDS)).alias("binary_share"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), 1, 5)
        .alias("sample_values"),
    ).drop("kind").withColumnRenamed("_kind", "kind")


def role_scores(stats: DataFrame) -> DataFrame:
    """Six scores per column."""
    kind, unique = F.col("kind"), F.col("distinct_values") / F.col("n")
    text = kind == "object"
    numeric = kind.isin("int", "float")

    def points(test: Column, value: Column | float) -> Column:
        return F.when(test, value).otherwise(0.0)

    scores = {
        "date": _keyword("date", 0.4)
        + F.when(kind == "datetime", 0.5).when(text, F.col("date_share") * 0.4).otherwise(0.0),
        "sku": _keyword("sku", 0.4)
        + points((unique > 0.01) & (unique < 0.5), 0.3)
        + points(text, 0.2 + F.col("code_share") * 0.2),
        "quantity": _keyword("quantity", 0.4)
        + points(numeric, 0.3 + F.col("nonnegative_share") * 0.15 + F.col("whole_share") * 0.15),
        "category": _keyword("category", 0.4)
        + F.when(unique < 0.1, 0.3).when(unique < 0.3, 0.2).otherwise(0.0)
        + points(text, 0.2),
        "price": _keyword("price", 0.4)
        + points(kind == "float", 0.3 + F.col("positive_share") * 0.2 + F.col("cents_share") * 0.1),
        "promo": _keyword("promo", 0.5)
        + points(F.col("distinct_values") <= 5, 0.3)
        + F.col("binary_share") * 0.2,
    }
    return stats.withColumns({f"{role}_score": F.least(F.lit(1.0), score) for role, score in scores.items()})


def profile(df: DataFrame, order: str | None = "row_id", threshold: float = ROLE_THRESHOLD) -> DataFrame:
    """Best role per column, its confidence, and all scores. Ties go to the earlier role."""
    scored = role_scores(column_stats(sample_values(df, order)))
    pairs = F.array(*[
        F.struct(F.col(f"{role}_score").alias("score"), F.lit(-i).alias("rank"), F.lit(role).alias("role"))
        for i, role in enumerate(ROLES)
    ])
    best = scored.withColumn("_best", F.array_max(pairs))
    entries = [part for role in ROLES for part in (F.lit(role), F.col(f"{role}_score"))]
    return best.select(
        "pos",
        "column",
        "kind",
        F.when(F.col("_best.score") >= threshold, F.col("_best.role")).otherwise("unknown").alias("detected_type"),
        F.col("_best.score").alias("confidence"),
        *[f"{role}_score" for role in ROLES],
        F.create_map(*entries).alias("all_scores"),
        "sample_values",
    )


def best_mapping(profiled: DataFrame, threshold: float = ROLE_THRESHOLD) -> dict[str, str]:
    """In role order, the best unused column at or above the threshold."""
    rows = profiled.select("pos", "column", *[f"{role}_score" for role in ROLES]).orderBy("pos").collect()  # one per column
    mapping: dict[str, str] = {}
    for role in ROLES:
        free = [row for row in rows if row["column"] not in mapping.values() and row[f"{role}_score"] >= threshold]
        if free:
            mapping[role] = max(free, key=lambda row: row[f"{role}_score"])["column"]
    return mapping


def detection_summary(profiled: DataFrame) -> DataFrame:
    """P9."""
    kind, sure = F.col("detected_type"), F.col("confidence") >= 0.8
    unknown = kind == "unknown"
    text = lambda state: F.replace(F.lit(DETECTION_TEXTS[state]), F.lit("{role}"), F.upper(kind))
    message = F.when(unknown, text("unknown")).when(sure, text("sure")).otherwise(text("unsure"))
    message = F.replace(message, F.lit("{name}"), F.col("column"))
    state = F.when(unknown, "warning").when(sure, "good").otherwise("uncertain")
    return profiled.select(
        "column", kind.alias("type"), "confidence", message.alias("message"), state.alias("status"), "sample_values"
    )


def validate_mapping(mapping: dict[str, str], df: DataFrame) -> list[str]:
    """P10: problems found; empty when the mapping can be used."""
    errors = [MAPPING_ERRORS[role] for role in REQUIRED_ROLES if not mapping.get(role)]
    used: set[str] = set()
    for name in mapping.values():
        if name not in df.columns:
            errors.append(MAPPING_ERRORS["absent"].format(name=name))
        if name in used:
            errors.append(MAPPING_ERRORS["twice"].format(name=name))
        used.add(name)
    return errors


def to_mapping(mapping: dict[str, str], df: DataFrame) -> Mapping:
    errors = validate_mapping(mapping, df)
    if errors:
        raise ValueError("; ".join(errors))
    return Mapping(**mapping)
