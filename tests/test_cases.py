"""Small cases with results worked out by hand (FIXTURES.md section 3)."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallycast.config import CLUSTER
from tallycast.functions.dates import days_to_holiday, horizon_periods, is_holiday, parse_date, shape_of, thanksgiving
from tallycast.operators import anomaly, classify, clean, conform, features, forecast, profile, quality, report, sampling, series, stages
from tallycast.schema import DEMAND, Mapping
from tallycast.sources import files

START = date(2024, 1, 1)
DEMO = {
    "WIDGET-A1": [150, 165, 180, 140, 155, 170, 185, 210],
    "WIDGET-B2": [80, 95, 100, 70, 85, 100, 110, 100],
    "GADGET-X": [60, 45, 80, 75, 55, 50, 65, 70],
}


def demand(spark, values, start=START, sku="a", price=None, promo=None):
    rows = [
        (i, start + timedelta(days=i), sku, None if q is None else float(q), "c", price[i] if price else None, promo[i] if promo else None)
        for i, q in enumerate(values)
    ]
    return spark.createDataFrame(rows, DEMAND)


@pytest.fixture(scope="module")
def demo(spark):
    first, *rest = [demand(spark, values, sku=sku) for sku, values in DEMO.items()]
    for other in rest:
        first = first.union(other)
    return first


def test_totals_and_abc(demo):
    totals = {r["sku"]: r["total_volume"] for r in classify.item_metrics(demo).collect()}
    assert totals == {sku: float(sum(values)) for sku, values in DEMO.items()}
    classes = {r["sku"]: (round(r["cumulative_pct"], 6), r["abc_class"]) for r in classify.abc_classes(demo).collect()}
    assert classes == {"WIDGET-A1": (52.2158, "A"), "WIDGET-B2": (80.732177, "B"), "GADGET-X": (100.0, "B")}


def test_cluster_tiers(demo):
    limits = classify.volume_thresholds(classify.item_metrics(demo)).first()
    assert (limits["a_threshold"], limits["b_threshold"]) == (1355.0, 740.0)
    clusters = {r["sku"]: (r["volume_tier"], r["pattern_type"]) for r in classify.cluster_items(demo).collect()}
    assert clusters == {"WIDGET-A1": ("A", "steady"), "WIDGET-B2": ("B", "steady"), "GADGET-X": ("C", "steady")}
    fixed = {r["sku"]: r["volume_tier"] for r in classify.cluster_items(demo, CLUSTER.with_volumes(1000, 600)).collect()}
    assert fixed == {"WIDGET-A1": "A", "WIDGET-B2": "B", "GADGET-X": "C"}


def test_trend_slope(demo):
    rows = features.create_features(demo.filter("sku = 'WIDGET-A1'"), ["trend_component"]).orderBy("date").collect()
    values = DEMO["WIDGET-A1"]
    middle = sum(values) / 8
    slope = sum((i - 3.5) * (v - middle) for i, v in enumerate(values)) / 7 / 5.25
    assert [r["trend_component"] for r in rows] == pytest.approx([slope * i for i in range(8)])


def test_naive_and_seasonal_naive(demo):
    item = demo.filter("sku = 'WIDGET-A1'")
    fitted = forecast.run_models(series.pack(item, "D"), ["naive", "seasonal_naive"], 3, "D").first()
    values = DEMO["WIDGET-A1"]
    mean = sum(values) / 8
    assert fitted["naive"]["forecast"] == [210.0] * 3
    assert fitted["naive"]["mape"] == pytest.approx(sum(abs(v - mean) / v for v in values) / 8 * 100)
    assert fitted["seasonal_naive"]["forecast"] == [165.0, 180.0, 140.0]
    expected = [mean] * 7 + [150]
    assert fitted["seasonal_naive"]["mape"] == pytest.approx(sum(abs(v - f) / v for v, f in zip(values, expected)) / 8 * 100)


def test_iqr_case(spark):
    found = anomaly.detect_iqr(demand(spark, [10, 10, 11, 12, 12, 13, 50])).collect()
    assert [(r["value"], r["expected_value"], r["anomaly_type"], r["severity"]) for r in found] == [(50.0, 12.0, "spike", 1.0)]
    assert anomaly.detect_iqr(demand(spark, [1, 1, 50])).count() == 0


def test_zscore_case(spark):
    found = anomaly.detect_zscore(demand(spark, [10] * 11 + [100])).first()
    assert (found["expected_value"], found["anomaly_type"]) == (17.5, "spike")
    assert found["severity"] == pytest.approx(0.529238, abs=1e-6)
    assert anomaly.detect_zscore(demand(spark, [5] * 10)).count() == 0


def test_zero_runs(spark):
    found = anomaly.detect_zeros(demand(spark, [5, 0, 0, 0, 7, 0, 0])).collect()
    assert [(r["date"], r["severity"]) for r in found] == [(START + timedelta(days=1), 0.3)]
    assert found[0]["expected_value"] == pytest.approx(12 / 7)


def test_gaps(spark):
    days = [0, 1, 4, 8]
    df = spark.createDataFrame([(i, START + timedelta(days=d), "a", 1.0, "c", None, None) for i, d in enumerate(days)], DEMAND)
    found = sorted((r["date"].day, round(r["severity"] * 7)) for r in anomaly.detect_gaps(df).collect())
    assert found == [(3, 2), (6, 3)]


def test_rolling_needs_more_rows_than_the_window(spark):
    config = anomaly.AnomalyConfig(rolling_threshold=1.5)
    assert anomaly.detect_rolling(demand(spark, [1, 1, 1, 9, 1, 1, 1]), config).count() == 0
    assert anomaly.detect_rolling(demand(spark, [1, 1, 1, 9, 1, 1, 1, 1]), config).count() == 1


def test_thanksgiving_and_holidays(spark):
    row = spark.range(1).select(thanksgiving(F.lit(2018)).alias("a"), thanksgiving(F.lit(2023)).alias("b")).first()
    assert (row["a"], row["b"]) == (date(2018, 11, 22), date(2023, 11, 23))
    day = F.make_date(F.lit(2023), F.lit(11), F.lit(25))
    row = spark.range(1).select(days_to_holiday(day).alias("d"), is_holiday(day).alias("h")).first()
    assert (row["d"], row["h"]) == (30, 0)


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, START, "a", None, "c", None, 1), (2, START, "a", None, "d", 3.0, None), (3, START, "b", 4.0, "e", 1.0, 0)], DEMAND
    )
    merged = {r["sku"]: r for r in clean.collapse_duplicates(df).collect()}
    assert merged["a"]["quantity"] == 0.0
    assert (merged["a"]["category"], merged["a"]["price"], merged["a"]["promo"]) == ("c", 3.0, 1)
    assert {r["row_id"] for r in clean.keep_first(df).collect()} == {1, 3}
    assert {r["row_id"] for r in quality.duplicate_rows(df).collect()} == {1, 2}


def test_outliers_keep_nulls(spark):
    df = demand(spark, [11] * 10 + [100, None])
    left = [r["quantity"] for r in clean.fix_outliers(df).collect()]
    assert len(left) == 11 and None in left and 100.0 not in left
    assert clean.fix_outliers(demand(spark, [5, 5, 5])).count() == 3


def test_fixes_in_fixed_order_and_unknown_fix(spark):
    df = demand(spark, [4, None, -6])
    fixed = clean.apply_fixes(df, {"negative": "absolute", "missing": "ffill"}).orderBy("row_id").collect()
    assert [r["quantity"] for r in fixed] == [4.0, 4.0, 6.0]
    with pytest.raises(ValueError):
        clean.apply_fixes(df, {"spelling": "zero"})


def test_fill_stays_inside_the_item(spark):
    df = demand(spark, [1, 2]).union(demand(spark, [None, 5], sku="b"))
    filled = {(r["sku"], r["date"].day): r["quantity"] for r in clean.fill_neighbour(df, ["quantity"]).collect()}
    assert filled[("b", 1)] is None


def test_single_row_item(spark):
    row = classify.cluster_items(demand(spark, [5])).first()
    assert (row["cv"], row["pattern_type"]) == (None, "steady")
    autumn = classify.cluster_items(demand(spark, [5], start=date(2024, 11, 5))).first()
    assert autumn["pattern_type"] == "seasonal"


def test_dates_and_promo_words(spark):
    rows = [("2024-13-01", "x"), ("25/12/2023", "YES"), ("12/25/2023", "no"), ("20231225", "2"), ("Dec 25, 2023", None),
            ("25 December 2023", "maybe"), ("2023-12-25 10:11:12", "0")]
    raw = spark.createDataFrame([(d, " AB12 ", "3", p) for d, p in rows], "d string, s string, q string, p string")
    out = conform.conform(raw, Mapping("d", "s", "q", promo="p")).collect()
    assert [r["date"] for r in out] == [date(2023, 12, 25)] * 6
    assert [r["promo"] for r in out] == [1, 0, 2, 0, 0, 0]
    assert {(r["sku"], r["category"], r["quantity"]) for r in out} == {("AB12", "AB1", 3.0)}
    assert shape_of("d/M/yyyy") == r"^\d{1,2}/\d{1,2}/\d{4}$"
    assert raw.select(parse_date(F.lit("no date")).alias("x")).first()["x"] is None


def test_price_features(spark):
    df = demand(spark, [1, 1, 1, 1], price=[0.0, 5.0, None, 10.0], promo=[0, 2, 4, 0])
    rows = features.create_features(df, ["price_change_pct", "price_relative_to_avg", "promo_flag", "promo_intensity"]).orderBy("date").collect()
    assert [r["price_change_pct"] for r in rows] == [0.0, 0.0, 0.0, 1.0]
    assert [r["price_relative_to_avg"] for r in rows] == [0.0, 1.0, None, 2.0]
    assert [(r["promo_flag"], r["promo_intensity"]) for r in rows] == [(0, 0.0), (1, 0.5), (1, 1.0), (0, 0.0)]


def test_feature_sets():
    assert features.features_of("High") == ("lag_1", "lag_7", "rolling_mean_7", "seasonal_index", "trend_component")
    assert len(features.features_of("Low")) == 10
    assert features.features_of(["month", "lag_1"]) == ("lag_1", "month")


def test_resample_fills_gaps(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 3), "a", 2.0, "c", None, None), (2, date(2024, 1, 22), "a", 3.0, "c", None, None)], DEMAND)
    weekly = [(r["period"], r["y"]) for r in series.resample(df, "W").orderBy("period").collect()]
    assert weekly == [(date(2024, 1, 7), 2.0), (date(2024, 1, 14), 0.0), (date(2024, 1, 21), 0.0), (date(2024, 1, 28), 3.0)]
    assert [r["y"] for r in series.resample(df, "M").collect()] == [5.0]
    months = series.future_dates(series.pack(df, "M"), 2, "M").orderBy("step").collect()
    assert [r["date"] for r in months] == [date(2024, 2, 29), date(2024, 3, 31)]
    assert [horizon_periods(30, f) for f in "DWM"] == [30, 4, 1]


def test_short_series_fall_back_under_their_own_name(spark):
    short = demand(spark, [3, 4, 5]).union(demand(spark, [7], sku="one"))
    fitted = {r["sku"]: r for r in forecast.run_models(series.pack(short, "D"), ["arima", "theta", "additive", "ensemble"], 2, "D").collect()}
    assert fitted["a"]["arima"]["model"] == "exponential_smoothing"
    assert fitted["one"]["arima"]["model"] == "naive"
    assert fitted["one"]["ensemble"]["forecast"] == [7.0, 7.0]


def test_batch_gives_c_items_the_simple_models(spark):
    wave = [10 + i % 7 for i in range(40)]
    df = demand(spark, wave, sku="top").union(demand(spark, wave, sku="low"))
    tiers = spark.createDataFrame([("top", "A"), ("low", "C")], "sku string, volume_tier string")
    rows = {r["sku"]: r for r in forecast.forecast_batch(df, tiers, "balanced", 7).collect()}
    assert rows["low"]["model"] in ("naive", "seasonal_naive", "exponential_smoothing")
    assert rows["top"]["model"] in ("exponential_smoothing", "arima", "theta", "additive")
    assert all(len(r["forecast"]) == 7 for r in rows.values())
    assert report.forecast_table(forecast.forecast(df, "simple", 7)).count() == 14


def test_backtest_skips_short_items(spark):
    df = demand(spark, list(range(1, 30))).union(demand(spark, [1, 2, 3], sku="short"))
    stats = {r["model"]: r for r in forecast.compare_models(df, 5, "D", None).collect()}
    assert set(stats) == set(forecast.COMPARED_MODELS)
    assert sum(r["win_rate"] for r in stats.values()) == pytest.approx(0.5)


def test_profile_mapping_and_validation(spark):
    raw = spark.createDataFrame(
        [(i, f"2024-01-{i % 28 + 1:02d}", f"SKU{i % 9}", float(i % 11), round(1.25 + i % 4, 2), ["yes", "no"][i % 2]) for i in range(60)],
        "row_id long, order_date string, sku_code string, sales_qty double, unit_price double, promo string")
    found = profile.best_mapping(profile.profile(raw), 0.7)
    assert found["date"] == "order_date" and found["sku"] == "sku_code" and found["quantity"] == "sales_qty" and found["promo"] == "promo"
    assert profile.validate_mapping(found, raw) == []
    assert profile.validate_mapping({"date": "x", "sku": "sku_code"}, raw) == ["Quantity/Sales column is required", "Column 'x' not found in data"]
    assert "mapped twice" in profile.validate_mapping({"date": "promo", "sku": "promo", "quantity": "sales_qty"}, raw)[0]
    with pytest.raises(ValueError):
        profile.to_mapping({"date": "order_date"}, raw)


def test_samples(spark):
    items = spark.range(100).select(F.col("id").cast("string").alias("sku"), (F.col("id") % 4).cast("string").alias("g"), F.col("id").cast("double").alias("total_volume"))
    assert sampling.random_items(items, 10).count() == 10
    groups = sampling.stratified_items(items, "g", 10).groupBy("g").count().collect()
    assert all(r["count"] == 2 for r in groups) and len(groups) == 4
    assert sampling.stratified_items(items, "g", 500).count() == 100
    assert 15 <= sampling.representative_items(items, 20).count() <= 20


def test_files(spark, tmp_path, demo):
    target = str(tmp_path / "demo.csv")
    files.write_csv(demo, target)
    assert files.load(spark, target).count() == demo.count()
    files.write_parquet(demo, str(tmp_path / "demo.parquet"), ["category"])
    assert files.load(spark, str(tmp_path / "demo.parquet")).count() == demo.count()
    latin = tmp_path / "latin.csv"
    latin.write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    assert files.read_csv(spark, str(latin)).first()["name"] == "café"
    for bad in ("x.xyz", "noending"):
        with pytest.raises(ValueError):
            files.load(spark, str(tmp_path / bad))
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError):
        files.load(spark, str(empty))


def test_stage_tables_survive(spark, tmp_path, demo):
    mapping = Mapping("date", "sku", "quantity")
    stages.save_stages(spark, str(tmp_path / "s"), {"demand": demo}, mapping)
    tables, back = stages.load_stages(spark, str(tmp_path / "s"))
    assert back == mapping and tables["demand"].count() == demo.count()


def test_review_actions(spark):
    df = demand(spark, [1, 2, 3])
    reviewed = spark.createDataFrame(
        [("a", START, 9.0, 7.0, 0.4, "iqr", "Auto-correct"), ("a", START, 9.0, 8.0, 0.9, "zscore", "Auto-correct"),
         ("a", START + timedelta(days=1), 2.0, 1.0, 0.5, "iqr", "Remove"), ("a", START, 2.0, 1.0, 0.5, "iqr", "Flag"),
         ("b", START, 2.0, 1.0, 0.5, "iqr", "Pending")],
        "sku string, date date, value double, expected_value double, severity double, method string, action string")
    out = [r["quantity"] for r in anomaly.apply_actions(df, reviewed).orderBy("date").collect()]
    assert out == [8.0, 3.0]
    assert {r["action"]: r["anomalies"] for r in anomaly.action_counts(reviewed).collect()} == {"Auto-correct": 2, "Remove": 1, "Flag": 1}
    assert [r["sku"] for r in anomaly.flagged_items(reviewed).collect()] == ["a"]


@pytest.mark.parametrize("freq", ["D", "W", "M"])
def test_additive_uses_the_labels_of_the_series(spark, freq):
    import numpy as np

    from tallycast.functions.dates import step_date
    from tallycast.operators.models.additive import period_days

    last = {"D": date(2024, 2, 28), "W": date(2024, 3, 3), "M": date(2024, 1, 31)}[freq]
    labels = spark.range(-3, 3).select(F.unix_date(step_date(F.lit(last), F.col("id").cast("int"), freq)).alias("d"))
    expected = sorted(r["d"] for r in labels.collect())
    assert period_days(np.datetime64(last), 4, 2, freq).tolist() == expected


def test_additive_continues_a_line(spark):
    line = demand(spark, [100 + 2 * i for i in range(800)])
    fitted = forecast.run_models(series.pack(line, "D"), ["additive"], 5, "D").first()["additive"]
    assert fitted["forecast"] == pytest.approx([100 + 2 * (800 + i) for i in range(5)], rel=0.01)
    assert fitted["mape"] < 1


def test_smoothing_learns_a_season(spark):
    week = [5, 10, 20, 40, 20, 10, 5]
    item = demand(spark, [week[i % 7] for i in range(70)])
    fitted = forecast.run_models(series.pack(item, "D"), ["exponential_smoothing", "theta"], 7, "D").first()
    assert fitted["exponential_smoothing"]["forecast"] == pytest.approx(week, abs=1e-6)
    assert fitted["theta"]["forecast"] == pytest.approx(week, abs=1.0)


def test_boosted_model_beats_the_mean(spark):
    week = [5, 10, 20, 40, 20, 10, 5]
    df = demand(spark, [week[i % 7] for i in range(140)]).union(demand(spark, [3 * week[i % 7] for i in range(140)], sku="b"))
    df = df.union(demand(spark, [1, 2, 3], sku="short"))
    packed = series.pack(df, "D")
    rows = {r["sku"]: r["gbt_leaf"] for r in forecast.run_models(packed, ["gbt_leaf"], 7, "D").select("sku", "gbt_leaf").collect()}
    assert rows["a"]["model"] == rows["b"]["model"] == "gbt_leaf"
    assert rows["b"]["mape"] < 20
    assert rows["b"]["forecast"] == pytest.approx([3 * v for v in rows["a"]["forecast"]], rel=1e-6)
    assert rows["short"]["model"] == "exponential_smoothing"
