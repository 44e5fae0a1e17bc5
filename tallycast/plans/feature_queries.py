"""Feature engineering (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.config import ALL_20, FEATURE_SETS, FEATURE_TEXTS, TIER_FEATURE_SET
from tallycast.functions.dates import holidays
from tallycast.operators import classify, features, forecast, series
from tallycast.plans.classify_queries import cluster_sql
from tallycast.plans.data import Register, demand, demand_sql

R = Register()
KEY = "sku, date, row_id:i"
INTEGERS = {"year", "month", "week_of_year", "day_of_week", "is_weekend", "is_holiday", "days_to_holiday", "promo_flag"}


def spec(names) -> str:
    return ", ".join(f"{name}:{'i' if name in INTEGERS else 'd'}" for name in names)


HOLIDAY_LIST = """[make_date({y}, 1, 1), make_date({y}, 7, 4), make_date({y}, 12, 25), make_date({y}, 12, 31),
    make_date({y}, 11, 1) + CAST((11 - isodow(make_date({y}, 11, 1))) % 7 + 21 AS INT),
    make_date({y}, 11, 1) + CAST((11 - isodow(make_date({y}, 11, 1))) % 7 + 22 AS INT)]"""
_HOLIDAYS = HOLIDAY_LIST.format(y="year(date)")


def features_sql(source: str = demand_sql("supp")) -> str:
    """CTE list ending in ``featured`` with all twenty features of the view ``demand`` that ``source`` defines."""
    return f"""{source}, base AS (
        SELECT *, row_number() OVER w - 1 AS x, last_value(price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM demand WINDOW w AS (PARTITION BY sku ORDER BY date, row_id)), featured AS (
        SELECT sku, date, row_id, quantity, price, promo,
            lag(quantity, 1) OVER w AS lag_1, lag(quantity, 7) OVER w AS lag_7, lag(quantity, 28) OVER w AS lag_28,
            avg(quantity) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7,
            avg(quantity) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS rolling_mean_28,
            stddev_samp(quantity) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_std_7,
            stddev_samp(quantity) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS rolling_std_28,
            year(date) AS year, month(date) AS month, weekofyear(date) AS week_of_year, isodow(date) - 1 AS day_of_week,
            CAST(isodow(date) >= 6 AS INT) AS is_weekend,
            CAST(list_contains({_HOLIDAYS}, date) AS INT) AS is_holiday,
            list_min(list_filter({_HOLIDAYS}, lambda h: h >= date)) - date AS days_to_holiday,
            coalesce(coalesce(price, before) / nullif(before, 0) - 1, 0) AS price_change_pct,
            CASE WHEN avg(price) OVER i > 0 THEN price / avg(price) OVER i ELSE 1 END AS price_relative_to_avg,
            CASE WHEN promo > 0 THEN 1 ELSE 0 END AS promo_flag,
            CASE WHEN max(promo) OVER i > 0 THEN promo / max(promo) OVER i ELSE 0 END AS promo_intensity,
            CASE WHEN avg(quantity) OVER i > 0 THEN avg(quantity) OVER (PARTITION BY sku, month(date)) / avg(quantity) OVER i ELSE 1 END AS seasonal_index,
            coalesce(covar_samp(x, coalesce(quantity, 0)) OVER i / nullif(var_pop(x) OVER i, 0), 0) * x AS trend_component
        FROM base WINDOW w AS (PARTITION BY sku ORDER BY date, row_id), i AS (PARTITION BY sku))"""


FEATURED = "WITH " + features_sql()


def _only(names):
    return lambda s, d: features.create_features(demand(s, d, "supp"), names)


for _name, _features in {
    "w1_lags": ("lag_1", "lag_7", "lag_28"),
    "w2_rolling_means": ("rolling_mean_7", "rolling_mean_28"),
    "w3_rolling_stds": ("rolling_std_7", "rolling_std_28"),
    "w4_calendar": ("year", "month", "week_of_year", "day_of_week"),
    "w5_weekend": ("is_weekend",),
    "w7_is_holiday": ("is_holiday",),
    "w8_days_to_holiday": ("days_to_holiday",),
    "w9_price_change": ("price_change_pct",),
    "w10_price_relative": ("price_relative_to_avg",),
    "w11_promo_flag": ("promo_flag",),
    "w12_promo_intensity": ("promo_intensity",),
    "w13_seasonal_index": ("seasonal_index",),
    "w14_trend": ("trend_component",),
    "w15_all_20": ALL_20,
    "w15_top_10": FEATURE_SETS["top_10"],
    "w15_basic_5": FEATURE_SETS["basic_5"],
    "w15_high_impact": features.features_of("High"),
}.items():
    R.add(_name, f"{KEY}, {spec(_features)}", f"{FEATURED} SELECT * FROM featured", _only(_features))

_VETERANS = HOLIDAY_LIST.format(y="y")[:-1] + ", make_date(y, 11, 11)]"
R.add("w6_holidays", "y:i, holiday, observed:i", f"""WITH years AS (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS y FROM lineitem),
    days AS (SELECT y, unnest({_VETERANS}) AS holiday FROM years)
    SELECT y, holiday, count(l_shipdate) AS observed FROM days LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) = holiday GROUP BY ALL""",
      lambda s, d: demand(s, d).groupBy(F.year("date").alias("y"), "date").agg(F.count("*").alias("n"))
      .groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("date", "n"))).alias("m"))
      .select("y", "m", F.explode(holidays(F.col("y"), veterans_day=True)).alias("holiday"))
      .withColumn("observed", F.coalesce(F.try_element_at("m", F.col("holiday")), F.lit(0))))


def _tier_case(name: str) -> str:
    tiers = [t for t, chosen in TIER_FEATURE_SET.items() if name in FEATURE_SETS[chosen]]
    return f"CASE WHEN volume_tier IN ({', '.join(repr(t) for t in tiers)}) THEN {name} END AS {name}"


R.add("w16_by_tier", f"{KEY}, {spec(ALL_20)}", f"""WITH {features_sql()}, c AS (SELECT sku, volume_tier FROM (WITH {cluster_sql('supp')} SELECT * FROM clusters))
    SELECT sku, date, row_id, {', '.join(_tier_case(name) for name in ALL_20)} FROM featured JOIN c USING (sku)""",
      lambda s, d: features.create_features_by_tier(demand(s, d, "supp"), classify.cluster_items(demand(s, d, "supp"))))


def _importance(spark, folder):
    return features.feature_importance(features.create_features(demand(spark, folder, "supp")), ALL_20)


IMPORTANCE_SQL = f"""{FEATURED}, c AS (SELECT {', '.join(f"coalesce(CASE WHEN stddev_pop({n}) > 0 THEN abs(corr({n}, quantity)) END, 0) AS {n}" for n in ALL_20)} FROM featured),
    long AS (SELECT feature, strength FROM (UNPIVOT c ON COLUMNS(*) INTO NAME feature VALUE strength)),
    importance AS (SELECT feature, strength / sum(strength) OVER () AS importance FROM long)"""
R.add("w17_importance", "feature, importance:d", f"{IMPORTANCE_SQL} SELECT * FROM importance", _importance)
R.add("w18_report", "feature, importance:d, importance_pct, description, band", f"""{IMPORTANCE_SQL}, texts(feature, description) AS (
    VALUES {', '.join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in FEATURE_TEXTS.items())})
    SELECT *, format('{{:.1f}}%', importance * 100) AS importance_pct,
        CASE WHEN importance >= 0.1 THEN 'high' WHEN importance >= 0.05 THEN 'medium' ELSE 'low' END AS band
    FROM importance JOIN texts USING (feature)""", lambda s, d: features.feature_report(_importance(s, d)))

WEEKS_SQL = """totals AS (SELECT sku, CAST(date_trunc('week', date) AS DATE) + 6 AS period, sum(quantity) AS y FROM demand GROUP BY ALL),
    calendar AS (SELECT sku, CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE) AS period FROM totals GROUP BY sku),
    series AS (SELECT sku, period, coalesce(y, 0.0) AS y FROM calendar LEFT JOIN totals USING (sku, period))"""
R.add("w19_model_matrix", "sku, period, y:d, lag_1:d, lag_7:d, lag_14:d, lag_28:d, rolling_mean_7:d, rolling_std_7:d, rolling_mean_28:d, "
      "day_of_week:i, month:i, day_of_month:i, week_of_year:i, time_idx:i", f"""WITH {demand_sql('supp')}, {WEEKS_SQL}
    SELECT sku, period, y, {', '.join(f'lag(y, {k}) OVER w AS lag_{k}' for k in (1, 7, 14, 28))},
        CASE WHEN count(*) OVER w7 = 7 THEN avg(y) OVER w7 END AS rolling_mean_7, CASE WHEN count(*) OVER w7 = 7 THEN stddev_samp(y) OVER w7 END AS rolling_std_7,
        CASE WHEN count(*) OVER w28 = 28 THEN avg(y) OVER w28 END AS rolling_mean_28, isodow(period) - 1 AS day_of_week, month(period) AS month,
        day(period) AS day_of_month, weekofyear(period) AS week_of_year, row_number() OVER w - 1 AS time_idx
    FROM series WINDOW w AS (PARTITION BY sku ORDER BY period), w7 AS (PARTITION BY sku ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
        w28 AS (PARTITION BY sku ORDER BY period ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""",
      lambda s, d: forecast.model_matrix(series.resample(demand(s, d, "supp"), "W")))
