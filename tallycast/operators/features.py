"""Feature engineering: the twenty curated features and their importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import (
    ALL_20,
    FEATURE_SETS,
    FEATURE_TEXTS,
    IMPACT_LEVELS,
    SKEW,
    TIER_FEATURE_SET,
    SkewConfig,
)
from tallycast.functions.dates import days_to_holiday, is_holiday
from tallycast.functions.scale import Ordered, altogether, earlier, ordered_rows, running

LONGEST_REACH = 28
MONTHS = range(13)  # 0: no date


def features_of(feature_set: str | Sequence[str]) -> tuple[str, ...]:
    """A named set, an impact level ("High", "Medium", "Low"), or a list of names."""
    if not isinstance(feature_set, str):
        return tuple(name for name in ALL_20 if name in set(feature_set))
    if feature_set in IMPACT_LEVELS:
        return IMPACT_LEVELS[feature_set]
    if feature_set == "Low":
        rated = {name for names in IMPACT_LEVELS.values() for name in names}
        return tuple(name for name in ALL_20 if name not in rated)
    return FEATURE_SETS.get(feature_set, ALL_20)


def _calendar(name: str) -> Column:
    date = F.col("date")
    return {
        "year": lambda: F.year(date),
        "month": lambda: F.month(date),
        "week_of_year": lambda: F.weekofyear(date),
        "day_of_week": lambda: F.weekday(date),
        "is_weekend": lambda: (F.weekday(date) >= 5).cast("int"),
        "is_holiday": lambda: is_holiday(date),
        "days_to_holiday": lambda: days_to_holiday(date),
    }[name]()


CALENDAR = ("year", "month", "week_of_year", "day_of_week", "is_weekend", "is_holiday", "days_to_holiday")
PRICE = ("price_change_pct", "price_relative_to_avg")
PROMO = ("promo_flag", "promo_intensity")


def _row_features(rows: Ordered, names: Sequence[str]) -> dict[str, Column]:
    """Everything that looks at neighbouring rows, over one sort."""
    w = rows.window()
    quantity = F.col("quantity")
    made: dict[str, Column] = {}
    for name in names:
        kind, _, size = name.rpartition("_")
        if kind == "lag":
            made[name] = F.lag(quantity, int(size)).over(w)
        elif kind == "rolling_mean":
            made[name] = F.avg(quantity).over(w.rowsBetween(1 - int(size), 0))
        elif kind == "rolling_std":
            made[name] = F.stddev_samp(quantity).over(w.rowsBetween(1 - int(size), 0))
    if "price_change_pct" in names:
        last_known = F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        before = F.coalesce(last_known, rows.passed("_price_before"))
        change = F.try_divide(F.coalesce(F.col("price"), before), before) - 1
        made["price_change_pct"] = F.coalesce(change, F.lit(0.0))
    if "trend_component" in names:
        made["_x"] = rows.row_index()
    return made


def create_features(
    df: DataFrame,
    feature_set: str | Sequence[str] = "all_20",
    skew: SkewConfig = SKEW,
    split: bool | None = None,
    with_price: bool = True,
    with_promo: bool = True,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Features for all items; one exchange of the rows and one sort by date.

    ``beside`` (one row per item) is looked up before the rows are widened; its columns go along.
    """
    names = [
        name for name in features_of(feature_set)
        if (with_price or name not in PRICE) and (with_promo or name not in PROMO)
    ]
    if all(name in CALENDAR or name == "promo_flag" for name in names):
        return df.select("*", *[(_promo_flag() if name == "promo_flag" else _calendar(name)).alias(name) for name in names])
    parts, passed = _summary(names)
    numbered = "trend_component" in names
    rows = ordered_rows(df, before=LONGEST_REACH, skew=skew, split=split, parts=parts, passed=passed, numbered=numbered,
                        beside=beside)
    rows = rows.with_columns(_row_features(rows, names))
    rows = rows.with_columns(_item_statistics(rows, names))
    if "seasonal_index" in names:
        average = F.get(F.array(*[f"_month_{m}" for m in MONTHS]), F.coalesce(F.month("date"), F.lit(0)))
        if rows.split:
            by_month = F.get(rows.passed("_months"), F.coalesce(F.month("date"), F.lit(0)))
            average = F.when(F.col("_passed").isNotNull(), by_month).otherwise(average)
        rows = rows.with_columns({"_avg_month": average})

    derived = {
        "price_relative_to_avg": lambda: F.when(F.col("_avg_price") > 0, F.col("price") / F.col("_avg_price")).otherwise(1.0),
        "promo_flag": _promo_flag,
        "promo_intensity": lambda: F.when(F.col("_max_promo") > 0, F.col("promo") / F.col("_max_promo")).otherwise(0.0),
        "seasonal_index": lambda: F.when(F.col("_avg_quantity") > 0, F.col("_avg_month") / F.col("_avg_quantity")).otherwise(1.0),
        "trend_component": lambda: F.coalesce(F.col("_slope"), F.lit(0.0)) * F.col("_x"),
    }
    columns = [
        derived[name]().alias(name) if name in derived else _calendar(name).alias(name) if name in CALENDAR else F.col(name)
        for name in names
    ]
    along = [name for name in beside.columns if name != "sku"] if beside is not None else []
    return rows.own_rows().select(*df.columns, *along, *columns)


def _promo_flag() -> Column:
    return F.coalesce((F.col("promo") > 0).cast("int"), F.lit(0))


def _summary(names: Sequence[str]) -> tuple[dict[str, Column], list[dict[str, Column]]]:
    """What the segments of an item tell each other: last price, rows ahead, and totals for the item's statistics."""
    parts: dict[str, Column] = {}
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    if "price_change_pct" in names:
        parts["_last_price"] = F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("date", "row_id")))
        first["_price_before"] = earlier("_last_price")
    if "price_relative_to_avg" in names:
        parts |= {"_price_sum": F.sum("price"), "_price_count": F.count("price")}
        first["_avg_price"] = F.try_divide(altogether(F.sum("_price_sum")), altogether(F.sum("_price_count")))
    if "promo_intensity" in names:
        parts["_promo"] = F.max("promo")
        first["_max_promo"] = altogether(F.max("_promo"))
    if "seasonal_index" in names:
        here = "quantity) FILTER (WHERE coalesce(month(date), 0) = "
        parts |= {f"_{kind}_{m}": F.expr(f"{kind}({here}{m})") for kind in ("sum", "count") for m in MONTHS}
        total = lambda kind, m: f"sum(_{kind}_{m}) OVER (PARTITION BY sku)"
        first["_months"] = F.expr(f"array({', '.join(f'try_divide({total('sum', m)}, {total('count', m)})' for m in MONTHS)})")
        known = " + ".join(f"coalesce({total('sum', m)}, 0D)" for m in MONTHS)
        first["_avg_quantity"] = F.expr(f"try_divide({known}, {' + '.join(total('count', m) for m in MONTHS)})")
    if "trend_component" in names:
        quantity = F.coalesce(F.col("quantity"), F.lit(0.0))
        parts |= {"_rows": F.count(F.lit(1)), "_quantity": F.sum(quantity), "_moment": F.sum(quantity * F.col("_i"))}
        first |= {"_ahead": running("_rows"), "_n": altogether(F.sum("_rows")).cast("double"), "_all": altogether(F.sum("_quantity"))}
        moment = altogether(F.sum(F.col("_ahead") * F.col("_quantity") + F.col("_moment")))
        n, middle = F.col("_n"), (F.col("_n") - 1) / 2
        second["_slope"] = F.try_divide((moment - middle * F.col("_all")) / (n - 1), (n * n - 1) / 12)
    return parts, [step for step in (first, second) if step]


def _item_statistics(rows: Ordered, names: Sequence[str]) -> dict[str, Column]:
    made: dict[str, Column] = {}
    if "price_relative_to_avg" in names:
        made["_avg_price"] = rows.of_item(F.avg("price"), rows.passed("_avg_price"))
    if "promo_intensity" in names:
        made["_max_promo"] = rows.of_item(F.max("promo"), rows.passed("_max_promo"))
    if "seasonal_index" in names:
        made["_avg_quantity"] = rows.of_item(F.avg("quantity"), rows.passed("_avg_quantity"))
        # every month over the window of the item, so that the widened rows aren't sorted again by month
        item, month = Window.partitionBy(*rows.keys), F.coalesce(F.month("date"), F.lit(0))
        made |= {f"_month_{m}": F.avg(F.when(month == m, F.col("quantity"))).over(item) for m in MONTHS}
    if "trend_component" in names:
        x, known = F.col("_x").cast("double"), F.coalesce(F.col("quantity"), F.lit(0.0))
        item = Window.partitionBy(*rows.keys)
        slope = F.try_divide(F.covar_samp(x, known).over(item), F.var_pop(x).over(item))
        made["_slope"] = F.when(F.col("_passed").isNotNull(), rows.passed("_slope")).otherwise(slope) if rows.split else slope
    return made


def create_features_by_tier(
    df: DataFrame, tiers: DataFrame, skew: SkewConfig = SKEW, split: bool | None = None
) -> DataFrame:
    """Each item gets its tier's set (C when it has no tier); other features stay null."""
    made = create_features(df, "all_20", skew, split, beside=tiers.select("sku", F.col("volume_tier").alias("_tier")))
    tier = F.coalesce(F.col("_tier"), F.lit("C"))
    columns = []
    for name in ALL_20:
        wanted = [t for t, chosen in TIER_FEATURE_SET.items() if name in FEATURE_SETS[chosen]]
        columns.append(F.when(tier.isin(*wanted), F.col(name)).alias(name))
    return made.select(*df.columns, *columns)


def feature_importance(
    featured: DataFrame, features: Sequence[str], target: str = "quantity", listwise: bool = False
) -> DataFrame:
    """Absolute correlation with the target, scaled to sum 1.

    Correlations use the rows where both values are known, or with ``listwise`` only rows
    where all features are.
    """
    names = [name for name in features if name in featured.columns and name != target]
    source = featured.dropna(subset=[*names, target]) if listwise else featured
    strengths = [
        F.coalesce(F.nanvl(F.abs(F.corr(F.col(name).cast("double"), F.col(target))), F.lit(0.0)), F.lit(0.0)).alias(name)
        for name in names
    ]
    table = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("strength")) for name in names])
    long = source.agg(*strengths).select(F.inline(table))
    total = F.sum("strength").over(Window.partitionBy(F.lit(0)))  # one row per feature
    share = F.coalesce(F.try_divide(F.col("strength"), total), F.lit(0.0))
    return long.select("feature", share.alias("importance")).orderBy(F.desc("importance"), "feature")


def feature_report(importance: DataFrame) -> DataFrame:
    """Importance with its text, a printed percentage, and a band."""
    text = F.lit("custom feature")
    for name, words in FEATURE_TEXTS.items():
        text = F.when(F.col("feature") == name, words).otherwise(text)
    value = F.col("importance")
    band = F.when(value >= 0.1, "high").when(value >= 0.05, "medium").otherwise("low")
    return importance.select(
        "feature",
        "importance",
        F.format_string("%.1f%%", value * 100).alias("importance_pct"),
        text.alias("description"),
        band.alias("band"),
    )
