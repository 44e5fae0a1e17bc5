"""Work that must not grow faster than the rows: no item ordered in one task, no interpreted folds, no fits that nobody reads."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.config import GridConfig, SkewConfig
from tallycast.functions import scale
from tallycast.operators import clean, features, forecast, series
from tallycast.operators.models import arima, boosted, forest
from tallycast.operators.models.base import with_moments

START = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def sales(spark, rows):
    made = [(i, START + dt.timedelta(days=day), sku, quantity) for i, (sku, day, quantity) in enumerate(rows)]
    schema = "row_id long, date date, sku string, quantity double"
    df = spark.createDataFrame(made, schema)
    return df.select("row_id", "date", "sku", "quantity", F.lit(None).cast("string").alias("category"),
                     F.lit(2.0).alias("price"), F.lit(1).alias("promo"))


def weekly(spark, weeks=60):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(sku, 7 * w, float(rng.integers(0, 9))) for sku in "ab" for w in range(weeks)]
    return series.pack(sales(spark, [*rows, ("short", 0, 2.0), ("short", 21, 4.0)]), "W")


def test_training_rows_are_compiled(spark):
    rows = boosted.training_rows(with_moments(weekly(spark)), 12, "W").select(*boosted.FEATURES, "label")
    top = plan(rows).split("Generate")[0]
    assert "lambda" not in top and "aggregate(" not in top
    assert rows.count() == 2 * sum(min(12, i - 27) for i in range(28, 60))


def test_boosting_parts_follow_the_rows(spark):
    rows = spark.range(100, numPartitions=64)
    cores = spark.sparkContext.defaultParallelism
    assert boosted.in_few_parts(rows, 100).rdd.getNumPartitions() == min(64, cores)
    assert boosted.in_few_parts(rows, 64 * boosted.PART_ROWS).rdd.getNumPartitions() == 64


def test_forest_walks_rows_in_pieces():
    trees = forest.flat([(0, 0.5, (1, 0.2, 1.0, 2.0), 3.0), 10.0])
    x = np.random.Generator(np.random.PCG64(1)).random((3 * forest.ROWS_AT_ONCE + 5, 2))
    x[7] = np.nan  # to the right
    wanted = np.where(x[:, 0] <= 0.5, np.where(x[:, 1] <= 0.2, 1.0, 2.0), 3.0) + 10.0
    assert (trees.predict(x) == wanted).all() and not len(trees.predict(x[:0]))


@pytest.mark.parametrize("before, after", [(0, 0), (3, 2), (70, 70)])
def test_cuts_are_those_of_an_ordered_item(spark, before, after, monkeypatch):
    monkeypatch.setattr(scale, "SAMPLES", 8)
    monkeypatch.setattr(scale, "ORDERED_ONE_OF", 4)  # coarse segments of 32 rows
    places = [("hot", i * 37 % 400, 1.0) for i in range(300)] + [(None, i % 50, 1.0) for i in range(150)]
    df = sales(spark, places).withColumn("date", F.when(F.col("row_id") % 9 != 0, F.col("date")))
    cuts = scale.find_cuts(df, "sku", scale.ORDER, before, after, SkewConfig(hot_rows=10))
    found = {(r["sku"], r["n"]): tuple(r[c] and r[c]["row_id"] for c in ("at", "from", "until")) for r in cuts.table.collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["sku"], []).append(((r["date"] is not None, r["date"] or START, r["row_id"]), r["row_id"]))
    wanted, between = {}, max(10, before, after)
    for sku, members in rows.items():
        ids = [row for _, row in sorted(members)]
        at = lambda n: ids[n - 1] if 1 <= n <= len(ids) else None  # noqa: B023, E731
        wanted |= {(sku, n // between): (at(n), at(n - before), at(n + after)) for n in range(between, len(ids) + 1, between)}
    assert found == wanted


def test_backward_fill_reads_no_frame_anew(spark):
    filled = clean.fill_neighbour(sales(spark, [("a", i, float(i) if i % 3 == 0 else None) for i in range(8)]), ["quantity"], forward=False)
    assert "unboundedfollowing" not in plan(filled).lower().replace(" ", "")
    assert [r.quantity for r in filled.orderBy("row_id").collect()] == [0, 3, 3, 3, 6, 6, 6, None]


def test_months_need_no_sort_of_their_own(spark):
    rows = sales(spark, [("a", 0, 1.0), ("a", 1, 3.0), ("a", 40, 8.0)])
    made = features.create_features(rows, ["seasonal_index"])
    assert not re.search(r"_seg#\d+, _w\d+#\d+\]", plan(made))  # windows are of the item alone
    assert [round(r.seasonal_index, 6) for r in made.orderBy("row_id").collect()] == [0.5, 0.5, 2.0]


def test_errors_against_the_mean_need_no_fold(spark):
    fitted = forecast.run_models(weekly(spark), ["naive"], 4, "W")
    assert "aggregate(" not in plan(fitted.select("naive.mape"))
    r = fitted.filter("sku = 'short'").first()
    assert r["mean"] == 1.5 and round(r["sd"], 9) == round((11 / 3) ** 0.5, 9)
    assert round(r["naive"]["mape"], 9) == round((0.25 + 0.625) / 2 * 100, 9) and r["naive"]["mae"] == 1.5


def test_a_fallback_is_fitted_only_where_it_is_needed(spark):
    packed = weekly(spark)
    fitted = {r["sku"]: r for r in forecast.run_models(packed, ["arima"], 4, "W").collect()}
    assert fitted["a"]["arima"]["model"] == "arima" and fitted["a"]["exponential_smoothing"]["model"] == "naive"
    assert fitted["short"]["arima"]["model"] == fitted["short"]["exponential_smoothing"]["model"] == "exponential_smoothing"
    both = {r["sku"]: r for r in forecast.run_models(packed, ["arima", "exponential_smoothing"], 4, "W").collect()}
    assert both["a"]["exponential_smoothing"]["model"] == "exponential_smoothing"


def test_likelihood_of_shared_points_is_that_of_own_points():
    rng = np.random.Generator(np.random.PCG64(5))
    y, n, grid = rng.random((6, 40)), np.array([40, 40, 33, 20, 12, 10]), GridConfig()
    shared = np.array([[0.5, -0.3, 0.1]]), np.array([[-0.9, 0.4, 0.0]])
    own = [np.repeat(p, 6, axis=0) for p in shared]
    assert (arima.deviance(y, n, *shared) == arima.deviance(y, n, *own)).all()
    assert arima.likeliest(y, n, grid).shape == (6, 2)
