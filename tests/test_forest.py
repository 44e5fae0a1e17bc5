"""Flattened trees against MLlib, and rolled-forward forecasts against a plain loop."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from tallycast.operators.models import forest


def test_flattened_trees_predict_as_the_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    table = pd.DataFrame(x, columns=list("abcd"))
    table["label"] = np.sin(x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2]
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(table))
    model = GBTRegressor(maxIter=8, maxDepth=4, stepSize=0.3).fit(rows)
    expected = [r.prediction for r in model.transform(rows).select("prediction").collect()]
    trees = forest.from_model(model.toDebugString)
    assert len(trees.roots) == 8
    assert trees.predict(x) == pytest.approx(expected)
    assert len(trees.predict(x[:0])) == 0


@pytest.mark.parametrize("freq", ["D", "W", "M"])
def test_each_step_enters_the_features_of_the_next(spark, freq):
    rng = np.random.default_rng(5)
    trees = forest.flat([(0, 1.0, (4, 0.9, 0.7, -0.2), 1.2), (8, 6, -0.1, (1, 1.1, 0.05, 0.15)), (5, 0.5, 0.02, (3, 0.8, 0.1, 0.0)), 0.01])
    series = {f"s{i}": rng.uniform(0, 9, size).tolist() for i, size in enumerate((28, 40, 41))}
    last = {"D": datetime.date(2024, 2, 27), "W": datetime.date(2023, 12, 24), "M": datetime.date(2023, 11, 30)}[freq]
    packed = spark.createDataFrame(
        [(sku, ys, len(ys), float(np.mean(ys)), last) for sku, ys in series.items()],
        "sku string, ys array<double>, n int, mean double, last_period date")
    found = {r.sku: r.forecast for r in forest.roll_forward(packed, trees, 9, freq).collect()}
    for sku, ys in series.items():
        mean = float(np.mean(ys))
        known = [y / mean for y in ys]
        for step in range(1, 10):
            date = pd.Timestamp(last) + {"D": pd.Timedelta(days=step), "W": pd.Timedelta(weeks=step), "M": pd.offsets.MonthEnd(step)}[freq]
            week = known[-7:]
            p = (0.7 if np.mean(week) <= 0.9 else -0.2) if known[-1] <= 1.0 else 1.2
            p += -0.1 if date.month <= 6 else 0.05 if known[-7] <= 1.1 else 0.15
            p += 0.02 if np.std(week, ddof=1) <= 0.5 else 0.1 if known[-28] <= 0.8 else 0.0
            known.append(max(0.0, p + 0.01))
        assert found[sku] == pytest.approx([v * mean for v in known[-9:]])
    assert forest.roll_forward(packed.limit(0), trees, 9, freq).count() == 0


@pytest.mark.parametrize("count", [900, 14_000])
def test_packed_boosting_grows_the_trees_of_mllib(spark, count):
    """All rows, and a sample of them, as candidates for splits; a constant feature, one of few values and one with many zeros."""
    from tallycast.operators.models import levelwise

    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=count), rng.integers(0, 5, count), np.full(count, 6.0), rng.exponential(size=count) * (rng.random(count) < 0.4), rng.normal(size=count)])
    y = 2 + x[:, 0] * (x[:, 1] > 2) - np.sqrt(x[:, 3]) + 0.1 * rng.normal(size=count)
    names = ["a", "b", "c", "d", "e"]
    rows = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "label"])).repartition(3).cache()
    for given in ({"maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 20}, {"maxDepth": 5, "stepSize": 0.3, "minInstancesPerNode": 1}):
        model = GBTRegressor(maxIter=4, seed=42, **given).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
        expected, found = forest.from_model(model.toDebugString), levelwise.boost(rows, names, count, 4, 42, **given)
        assert len(found.value) == len(expected.value)
        assert np.allclose(found.predict(x), expected.predict(x), rtol=0, atol=1e-9)


def test_training_rows_are_packed(spark):
    from tallycast.operators.models import levelwise

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12))
    names = [f"f{i}" for i in range(12)]
    rows = spark.createDataFrame(pd.DataFrame(np.column_stack([x, x[:, 0]]), columns=[*names, "label"]))
    places = [levelwise.split_places(x[:, i], 700.0, 31) for i in range(12)]
    bundles = levelwise.Bundles.of([len(ends) + 1 for ends in places])
    chunks = levelwise.packed(rows, names, places, bundles).collect()
    assert sum(len(c.codes) + len(c.rest) for c in chunks) == 700 * 20
    for f in range(12):
        found = [bundles.bins(f)[levelwise._arrays(bytes(c.codes), bytes(c.rest))[0][bundles.bundle[f]]] for c in chunks]
        assert sorted(np.concatenate(found)) == sorted(np.searchsorted(places[f], x[:, f]))
    with pytest.raises(Exception, match="missing feature or label"):
        levelwise.packed(rows.selectExpr(*names, "null + label as label"), names, places, bundles).collect()


def test_a_sample_larger_than_expected_gives_more_bins(spark):
    from tallycast.operators.models import levelwise

    x = np.arange(1.0, 1001.0)
    places = [levelwise.split_places(x, 950.0, 31), levelwise.split_places(x % 7, 1000.0, 31)]
    assert len(places[0]) > 31 and len(places[1]) == 6
    bundles = levelwise.Bundles.of([len(ends) + 1 for ends in places])
    rows = spark.createDataFrame(pd.DataFrame({"a": x, "b": x % 7, "label": x}))
    chunks = levelwise.packed(rows, ["a", "b"], places, bundles).rdd.map(lambda row: (bytes(row[0]), bytes(row[1])))
    found = levelwise.measure(chunks, levelwise.Tree(), [0], bundles, 0)
    for f, values in enumerate((x, x % 7)):
        bins = np.searchsorted(places[f], values)
        assert found[1, 0, f].tolist() == np.bincount(bins, minlength=found.shape[3]).tolist()
        assert np.allclose(found[0, 0, f], np.bincount(bins, x, found.shape[3]))
