"""Series, models, selection and back-testing (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.config import COMPARED_MODELS, ENSEMBLE_MEMBERS, SAMPLE_SEED, GridConfig
from tallycast.functions.dates import horizon_periods
from tallycast.operators import classify, forecast, series
from tallycast.operators.models import additive, arima, boosted, forest, leafwise
from tallycast.operators.models.base import with_moments
from tallycast.plans.classify_queries import cluster_sql
from tallycast.plans.data import Register, demand, demand_sql, events, events_sql
from tallycast.plans.forecast_sql import (
    arima_sql,
    ensemble_sql,
    likelihood_sql,
    long_sql,
    naive_sql,
    nested,
    seasonal_naive_sql,
    series_sql,
    smoothing_sql,
    theta_sql,
)

R = Register()
SUPP = "WITH " + demand_sql("supp")
EVENTS = "WITH " + events_sql()
H = 12
LONG = "sku, model, step:i, date, forecast:d, lower_bound:d, upper_bound:d"
ERRORS = "sku, model, mape:d, mae:d, rmse:d"


def _supp(spark, folder):
    return demand(spark, folder, "supp")


for _freq, _name in (("D", "daily"), ("W", "weekly"), ("M", "monthly")):
    R.add(f"m1_resample_{_name}", "sku, period, y:d", f"{SUPP}, {series_sql(_freq)} SELECT * FROM series",
          lambda s, d, f=_freq: series.resample(_supp(s, d), f))
R.add("m2_horizon_periods", "frequency, periods:i, sku", f"""{SUPP} SELECT DISTINCT frequency, CASE frequency WHEN 'D' THEN 90 WHEN 'W' THEN 12 ELSE 3 END AS periods, sku
    FROM demand, (VALUES ('D'), ('W'), ('M')) v(frequency)""",
      lambda s, d: _supp(s, d).select("sku").distinct().select("sku", F.inline(F.array(*[
          F.struct(F.lit(f).alias("frequency"), F.lit(horizon_periods(90, f)).alias("periods")) for f in "DWM"]))))
for _freq, _name in (("D", "daily"), ("W", "weekly"), ("M", "monthly")):
    _label = {"D": "last_period + CAST(step AS INT)", "W": "last_period + CAST(7 * step AS INT)",
              "M": "last_day(CAST(date_trunc('month', last_period) + to_months(CAST(step AS INT)) AS DATE))"}[_freq]
    R.add(f"m3_future_{_name}", "sku, step:i, date", f"{SUPP}, {series_sql(_freq)} SELECT sku, step, {_label} AS date FROM packed, range(1, {H + 1}) r(step)",
          lambda s, d, f=_freq: series.future_dates(series.pack(_supp(s, d), f), H, f))


def _rows(df, models, freq, grid_horizon=H):
    return forecast.model_rows(forecast.run_models(series.pack(df, freq), models, grid_horizon, freq), models, freq)


def _model(name, freq, source, spec=LONG):
    def query(spark, folder):
        rows = _rows(source(spark, folder), [name], freq)
        return forecast.forecast_rows(rows) if spec == LONG else rows
    return query


def _check(query_name, model, freq, source, head, part, extra=""):
    """Forecast rows and error measures of one model against its SQL."""
    R.add(query_name, LONG, f"{head}, {series_sql(freq)}, {part}, shown AS ({nested(model)}) {long_sql('shown', freq)}", _model(model, freq, source))
    R.add(f"{query_name}_errors", ERRORS, f"{head}, {series_sql(freq)}, {part} {nested(model)}", _model(model, freq, source, ERRORS))


_check("m4_naive", "naive", "D", _supp, SUPP, naive_sql(H))
_check("m5_seasonal_naive", "seasonal_naive", "W", _supp, SUPP, seasonal_naive_sql(52, H))
_check("m5_seasonal_naive_short", "seasonal_naive", "W", events, EVENTS, seasonal_naive_sql(52, H))
_check("m6_smoothing_monthly", "exponential_smoothing", "M", _supp, SUPP, smoothing_sql(12, H))
_check("m6_smoothing_no_season", "exponential_smoothing", "W", events, EVENTS, smoothing_sql(1, H))
DAILY_SQL = f"""{smoothing_sql(7, H, 'seasoned', 'n >= 14')}, {smoothing_sql(1, H, 'plain', 'n BETWEEN 2 AND 13')},
    exponential_smoothing AS (SELECT * FROM seasoned UNION ALL SELECT * FROM plain)"""
_check("m6_smoothing_daily", "exponential_smoothing", "D", events, EVENTS, DAILY_SQL)
_check("m7_arima", "arima", "W", _supp, SUPP, arima_sql(H))
for _name, _model_name, _freq in (("m6_refined", "exponential_smoothing", "M"), ("m7_exact", "arima", "W")):
    R.add(_name, LONG, None, lambda s, d, m=_model_name, f=_freq: forecast.forecast_rows(forecast.model_rows(
        forecast.run_models(series.pack(_supp(s, d), f), [m], H, f, GridConfig(refine=True)), [m], f)))
POINTS = [(0.5, -0.3), (-0.4, 0.6), (0.9, -0.95), (0.0, 0.99)]
R.add("m7_likelihood", "sku, phi:d, theta:d, loglik:d", f"{SUPP}, {series_sql('W')}, {likelihood_sql(POINTS)} SELECT * FROM likelihood",
      lambda s, d: arima.likelihoods(series.pack(_supp(s, d), "W"), POINTS))
_check("m8_theta", "theta", "M", _supp, SUPP, theta_sql(12, H))
MEMBERS_SQL = f"{smoothing_sql(12, H)}, {arima_sql(H)}, {theta_sql(12, H)}"
_check("m12_ensemble", "ensemble", "M", _supp, SUPP, f"{MEMBERS_SQL}, {ensemble_sql(ENSEMBLE_MEMBERS)}")

R.add("m9_additive", LONG, None, _model("additive", "W", _supp))
R.add("m9_trend_bends", "sku, period, slope_change:d", None, lambda s, d: additive.trend_bends(series.pack(_supp(s, d), "W"), "W"))
R.add("m9_bend_moments", "sku, place:i, period, hinge_sum:d, hinge_square:d, hinge_y:d", f"""{SUPP}, {series_sql('W')},
    counted AS (SELECT *, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS INT) AS history FROM packed),
    spread AS (SELECT *, least(25, history - 1) AS places FROM counted),
    placed AS (SELECT *, unnest(range(1, places + 1)) AS k FROM spread WHERE places > 0),
    rooted AS (SELECT *, CAST(round_even(k * ((history - 1) / CAST(places AS DOUBLE)), 0) AS INT) AS place FROM placed),
    hinged AS (SELECT *, list_transform(range(0, n), lambda i: greatest(i - place, 0) / CAST(n - 1 AS DOUBLE)) AS h FROM rooted)
    SELECT sku, place, last_period - CAST(7 * (n - 1 - place) AS INT) AS period, list_sum(h) AS hinge_sum,
        list_sum(list_transform(h, lambda x: x * x)) AS hinge_square, list_sum(list_transform(list_zip(h, ys), lambda p: p[1] * p[2])) AS hinge_y FROM hinged""",
      lambda s, d: additive.trend_bends(series.pack(_supp(s, d), "W"), "W"))
R.add("m10_gbt_leaf", ERRORS, None, _model("gbt_leaf", "W", _supp, ERRORS))
R.add("m10_gbt_depth", ERRORS, None, _model("gbt_depth", "W", _supp, ERRORS))
R.add("m10_training_rows", "step:i, month:i, n:i, label:d, lag_1:d, lag_28:d, rolling_mean_7:d", f"""{SUPP}, {series_sql('W')}, s AS (SELECT *, list_avg(ys) AS m FROM packed),
    t AS (SELECT *, unnest(range(28, n)) AS i FROM s WHERE n > 37 AND m > 0),
    r AS (SELECT *, unnest(range(1, least({H}, i - 27) + 1)) AS step FROM t)
    SELECT step, month(last_period + CAST(7 * (i + 1 - n) AS INT)) AS month, count(*) AS n, avg(ys[i + 1] / m) AS label, avg(ys[i - step + 1] / m) AS lag_1,
        avg(ys[i - step - 26] / m) AS lag_28, avg(list_avg(ys[i - step - 5:i - step + 1]) / m) AS rolling_mean_7 FROM r GROUP BY ALL""",
      lambda s, d: boosted.training_rows(with_moments(series.pack(_supp(s, d), "W")), H, "W").groupBy("step", "month").agg(
          F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("label", "lag_1", "lag_28", "rolling_mean_7")]))
R.add("m11_future_features", "sku, step:i, lag_1:d, lag_7:d, lag_14:d, lag_28:d, rolling_mean_7:d, rolling_std_7:d, rolling_mean_28:d, day_of_week:i, "
      "month:i, day_of_month:i, week_of_year:i, time_idx:i", f"""{SUPP}, {series_sql('W')}, s AS (SELECT *, list_avg(ys) AS m FROM packed), f AS (
    SELECT *, last_period + CAST(7 * step AS INT) AS p FROM s, range(1, {H + 1}) r(step) WHERE n > 37 AND m > 0)
    SELECT sku, step, ys[n] / m AS lag_1, ys[n - 6] / m AS lag_7, ys[n - 13] / m AS lag_14, ys[n - 27] / m AS lag_28, list_avg(ys[n - 6:n]) / m AS rolling_mean_7,
        list_stddev_samp(ys[n - 6:n]) / m AS rolling_std_7, list_avg(ys[n - 27:n]) / m AS rolling_mean_28, isodow(p) - 1 AS day_of_week, month(p) AS month,
        day(p) AS day_of_month, weekofyear(p) AS week_of_year, n - 1 + step AS time_idx FROM f""",
      lambda s, d: boosted.future_rows(with_moments(series.pack(_supp(s, d), "W")), H, "W"))

# a small forest, written once as trees and once as SQL, over the features by name
SMALL_FOREST = (
    ("lag_1", 1.0, ("rolling_mean_7", 0.9, 0.7, 0.95), 1.2),
    ("month", 6, -0.1, ("lag_7", 1.1, 0.05, 0.15)),
    ("rolling_std_7", 0.5, ("lag_28", 0.8, 0.02, -0.02), ("rolling_mean_28", 1.0, -0.3, 0.1)),
    ("day_of_month", 15, ("lag_14", 1.3, 0.01, 0.03), -0.01),
    ("week_of_year", 26, ("day_of_week", 3, 0.0, 0.2), ("time_idx", 330, 0.04, -0.9)),
)


def _numbered(tree):
    return (boosted.FEATURES.index(tree[0]), tree[1], _numbered(tree[2]), _numbered(tree[3])) if isinstance(tree, tuple) else tree


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"CAST({tree} AS DOUBLE)"
    return f"CASE WHEN {tree[0]} <= {tree[1]} THEN {_tree_sql(tree[2])} ELSE {_tree_sql(tree[3])} END"


R.add("m11_roll_forward", "sku, step:i, forecast:d", f"""WITH RECURSIVE {SUPP.removeprefix('WITH ')}, {series_sql('W')},
    roll AS (
        SELECT sku, n, last_period, list_avg(ys) AS m, list_transform(ys, lambda y: y / list_avg(ys)) AS zs, 0 AS step, CAST(0 AS DOUBLE) AS v
        FROM packed WHERE n > 37 AND list_avg(ys) > 0
        UNION ALL
        SELECT sku, n, last_period, m, list_append(zs, greatest(0, p)), step, greatest(0, p) FROM (
            SELECT *, {" + ".join(_tree_sql(tree) for tree in SMALL_FOREST)} AS p FROM (
                SELECT sku, n, last_period, m, zs, step + 1 AS step, zs[-1] AS lag_1, zs[-7] AS lag_7, zs[-14] AS lag_14, zs[-28] AS lag_28,
                    list_avg(zs[-7:]) AS rolling_mean_7, list_stddev_samp(zs[-7:]) AS rolling_std_7, list_avg(zs[-28:]) AS rolling_mean_28,
                    isodow(last_period + CAST(7 * (step + 1) AS INT)) - 1 AS day_of_week, month(last_period + CAST(7 * (step + 1) AS INT)) AS month,
                    day(last_period + CAST(7 * (step + 1) AS INT)) AS day_of_month, weekofyear(last_period + CAST(7 * (step + 1) AS INT)) AS week_of_year,
                    n + step AS time_idx
                FROM roll WHERE step < {H}))
    )
    SELECT sku, step, v * m AS forecast FROM roll WHERE step > 0""",
      lambda s, d: forest.roll_forward(
          boosted.eligible(with_moments(series.pack(_supp(s, d), "W"))), forest.flat([_numbered(t) for t in SMALL_FOREST]), H, "W"
      ).select("sku", F.posexplode("forecast").alias("_i", "forecast")).withColumn("step", F.col("_i") + 1))

# the root's children under a fixed split and fixed bins
SHOWN = {"lag_1": [0.5, 0.8, 1.0, 1.2, 1.5], "rolling_mean_7": [0.8, 0.9, 1.0, 1.1], "month": [3.0, 6.0, 9.0]}


def _histograms(spark, folder):
    rows = boosted.training_rows(with_moments(series.pack(_supp(spark, folder), "W")), 1, "W")
    tree = leafwise.Growing()
    sides = tree.split(0, 0, 2)
    return leafwise.histograms(leafwise.binned(rows, list(SHOWN), list(SHOWN.values())), tree, sides, len(SHOWN))


R.add("m10_leaf_histograms", "node:i, feature:i, bin:i, rest:d, n:i", f"""{SUPP}, {series_sql('W')}, s AS (SELECT *, list_avg(ys) AS m FROM packed),
    t AS (SELECT *, unnest(range(28, n)) AS i FROM s WHERE n > 37 AND m > 0),
    x AS (SELECT ys[i + 1] / m AS label, ys[i] / m AS lag_1, list_avg(ys[i - 6:i]) / m AS rolling_mean_7,
        month(last_period + CAST(7 * (i + 1 - n) AS INT)) AS month FROM t),
    long AS ({" UNION ALL ".join(
        f"SELECT CASE WHEN lag_1 <= 1.0 THEN 1 ELSE 2 END AS node, {i} AS feature, len(list_filter({ends}, lambda e: e < {name})) AS bin, label FROM x"
        for i, (name, ends) in enumerate(SHOWN.items()))})
    SELECT node, feature, bin, sum(label) AS rest, count(*) AS n FROM long GROUP BY ALL""", _histograms)

# --- choice -----------------------------------------------------------------------------


def choice_sql(models) -> str:
    union = " UNION ALL ".join(nested(name, rank=i) for i, name in enumerate(models))
    return f"results AS (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY mape, model_rank) = 1)"


SIMPLE_SQL = f"{naive_sql(H)}, {seasonal_naive_sql(12, H)}, {smoothing_sql(12, H)}, {choice_sql(('naive', 'seasonal_naive', 'exponential_smoothing'))}"
R.add("m13_accuracy", "sku, model, mape:d, mae:d, rmse:d", f"""{SUPP}, {series_sql('D')}, {naive_sql(H)}, {seasonal_naive_sql(7, H)}
    {nested('naive')} UNION ALL {nested('seasonal_naive')}""", lambda s, d: _rows(_supp(s, d), ["naive", "seasonal_naive"], "D"))
R.add("m14_simple_choice", LONG, f"{SUPP}, {series_sql('M')}, {SIMPLE_SQL} {long_sql('results', 'M')}",
      lambda s, d: forecast.forecast_rows(forecast.forecast(_supp(s, d), "simple", H * 30, "M")))
R.add("m14_simple_models", ERRORS, f"{SUPP}, {series_sql('M')}, {SIMPLE_SQL} SELECT * FROM results",
      lambda s, d: forecast.forecast(_supp(s, d), "simple", H * 30, "M"))
R.add("m15_fallback", LONG, f"{EVENTS}, {series_sql('W')}, {smoothing_sql(1, H)}, shown AS ({nested('exponential_smoothing')}) {long_sql('shown', 'W')}",
      lambda s, d: forecast.forecast_rows(_rows(events(s, d), ["arima"], "W")))


def _tiers(spark, folder):
    return classify.cluster_items(_supp(spark, folder))


SUPP_CLUSTERS = "WITH " + cluster_sql("supp")
R.add("m16_strategy", "sku, strategy", f"""{SUPP_CLUSTERS} SELECT sku, CASE WHEN volume_tier = 'C' THEN 'simple' ELSE 'balanced' END AS strategy FROM clusters""",
      lambda s, d: forecast.with_strategy(series.pack(_supp(s, d), "M"), _tiers(s, d), "balanced"))
R.add("m16_batch", LONG, None, lambda s, d: forecast.forecast_rows(forecast.forecast_batch(_supp(s, d), _tiers(s, d), "balanced", H * 30, "M")))
R.add("m16_batch_simple_tier", ERRORS, f"""{SUPP_CLUSTERS}, {series_sql('M')}, {SIMPLE_SQL}
    SELECT * FROM results WHERE sku IN (SELECT sku FROM clusters WHERE volume_tier = 'C')""",
      lambda s, d: forecast.forecast_batch(_supp(s, d), _tiers(s, d), "balanced", H * 30, "M")
      .join(_tiers(s, d).filter("volume_tier = 'C'"), "sku", "left_semi"))
R.add("m17_advanced_items", "sku, date, quantity:d, row_id:i", f"{SUPP_CLUSTERS} SELECT * FROM demand WHERE sku IN (SELECT sku FROM clusters WHERE volume_tier = 'A')",
      lambda s, d: forecast.items_for_advanced(_supp(s, d), _tiers(s, d)))

# --- back-testing -----------------------------------------------------------------------


def backtest_sql(freq: str, h: int, models: str, names) -> str:
    whole = series_sql(freq).replace("packed AS", "history AS")
    scores = " UNION ALL ".join(
        f"SELECT sku, '{name}' AS model, {i} AS model_rank, test, forecast[1:len(test)] AS f FROM {name} JOIN held USING (sku)" for i, name in enumerate(names))
    pairs = "list_zip(list_transform(list_zip(test, f), lambda p: p[1] - p[2]), test)"
    return f"""{whole}, held AS (SELECT *, CASE WHEN n > {h} THEN ys[n - {h} + 1:] ELSE ys[n:] END AS test FROM history WHERE n >= 14),
    packed AS (SELECT sku, n - len(test) AS n, last_period, ys[1:n - len(test)] AS ys FROM held), {models},
    tested AS (SELECT sku, model, model_rank, coalesce(list_avg(list_transform(list_filter({pairs}, lambda p: p[2] <> 0), lambda p: abs(p[1] / p[2]))), 0) * 100 AS mape,
        list_avg(list_transform({pairs}, lambda p: abs(p[1]))) AS mae FROM ({scores})),
    wins AS (SELECT model, count(*) AS wins FROM (SELECT * FROM tested QUALIFY row_number() OVER (PARTITION BY sku ORDER BY mape, model_rank) = 1) GROUP BY model),
    comparison AS (SELECT model, avg(mape) AS avg_mape, avg(mae) AS avg_mae, coalesce(max(wins), 0) / (SELECT count(*) FROM history) AS win_rate
        FROM tested LEFT JOIN wins USING (model) GROUP BY model)"""


FIVE_SQL = f"{naive_sql(H)}, {seasonal_naive_sql(12, H)}, {MEMBERS_SQL}"
COMPARISON = "model, avg_mape:d, avg_mae:d, win_rate:d"
R.add("m18_compare_models", COMPARISON, f"{SUPP}, {backtest_sql('M', H, FIVE_SQL, COMPARED_MODELS)} SELECT * FROM comparison",
      lambda s, d: forecast.compare_models(_supp(s, d), H, "M", sample_size=None))
R.add("m18_backtest_items", "sku, model, mape:d, mae:d", f"{SUPP}, {backtest_sql('D', 30, naive_sql(30) + ', ' + seasonal_naive_sql(7, 30), ('naive', 'seasonal_naive'))} SELECT * FROM tested",
      lambda s, d: forecast.backtest(_supp(s, d), 30, "D", None, ("naive", "seasonal_naive")))
def sampled_sql(items: int) -> str:
    return f"""WITH {demand_sql('supp', name='everything')}, sample AS (SELECT sku FROM (SELECT DISTINCT sku FROM everything) ORDER BY md5('{SAMPLE_SEED}:' || sku), sku LIMIT {items}),
    demand AS (SELECT * FROM everything WHERE sku IN (SELECT sku FROM sample)), {backtest_sql('M', H, FIVE_SQL, COMPARED_MODELS)} SELECT * FROM comparison"""


R.add("m18_compare_sample", COMPARISON, sampled_sql(50), lambda s, d: forecast.compare_models(_supp(s, d), H, "M", 50))
