"""The split form of skew-prone operators gives the rows of the plain form."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallycast.config import AnomalyConfig, SkewConfig
from tallycast.functions.scale import exact_quantiles, ordered_rows, ranked
from tallycast.operators import anomaly, clean, features, sampling
from tallycast.plans.data import demand, dirty

TINY = SkewConfig(hot_rows=60)


def rows(df):
    parts = [
        F.round(F.col(f.name), 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema
    ]
    return sorted(map(str, df.select(*parts).collect()))


@pytest.fixture(scope="module")
def skewed(spark, folder):
    """One item and the null item hold a third of the rows each, many on one day or without a date; ids clump by split."""
    df = dirty(spark, folder, "part")
    unique = F.row_number().over(Window.orderBy("row_id", "sku", "date", "price"))  # merged items repeat ids
    df = df.withColumn("n", unique.cast("long"))
    split = F.when(F.col("n") % 5 < 3, 1).otherwise(F.col("n") % 11).cast("long")
    df = df.withColumn("row_id", F.shiftleft(split, 33) + F.col("n"))
    third = F.col("n") % 3
    day = F.when((third < 2) & (F.col("n") % 2 == 0), F.lit("1998-03-05").cast("date")).when(F.col("n") % 13 != 0, F.col("date"))
    name = F.when(third == 0, "hot").when(third == 2, F.col("sku"))
    df = df.withColumns({"sku": name, "date": day}).drop("n")
    df = df.withColumn("price", F.when(F.col("promo") > 2, F.col("price")))
    return df.persist()


def test_the_hot_item_is_split(skewed):
    split = ordered_rows(skewed, before=28, skew=TINY, split=True)
    for item in (F.col("sku") == "hot", F.col("sku").isNull()):
        segments = split.df.filter(item & F.col("_own")).groupBy("_seg").count().collect()
        assert len(segments) > 10
        assert max(row["count"] for row in segments) <= 2 * TINY.hot_rows
    assert rows(split.own_rows()) == rows(skewed)


@pytest.mark.parametrize("operator", [
    lambda df, **k: features.create_features(df, "all_20", **k),
    lambda df, **k: clean.fill_neighbour(df, ["quantity", "price"], True, **k),
    lambda df, **k: clean.fill_neighbour(df, ["quantity", "price"], False, **k),
    lambda df, **k: anomaly.detect_rolling(df, AnomalyConfig(rolling_threshold=1.8), **k),
    lambda df, **k: anomaly.detect_zeros(df.withColumn("quantity", F.when(F.col("quantity") > 8, F.col("quantity")).otherwise(0.0)), **k),
    lambda df, **k: anomaly.detect_iqr(df, AnomalyConfig(iqr_multiplier=0.3), **k),
    lambda df, **k: sampling.sparkline_order(df, "trend", 500, **k),
    lambda df, **k: sampling.sparkline_rows(df, "volume_high", 20, **k),
])
def test_split_and_plain_agree(skewed, operator):
    plain = rows(operator(skewed, split=False))
    assert plain
    assert rows(operator(skewed, skew=TINY, split=True)) == plain
    assert rows(operator(skewed, skew=TINY)) == plain


def test_features_choose_the_way_per_item(skewed):
    plain = rows(features.create_features(skewed, "all_20", split=False))
    assert rows(features.create_features(skewed, "all_20", skew=TINY)) == plain


@pytest.mark.parametrize("skew", [TINY, SkewConfig(hot_rows=0)])
def test_quantiles_by_rank_equal_percentile(spark, skewed, skew):
    values = skewed.withColumn("quantity", F.col("quantity") * 1.37 - F.col("price") / 1000)
    plain = exact_quantiles(values, ["sku"], "quantity", [0.0, 0.1, 0.5, 0.99, 1.0], split=False)
    ranks = exact_quantiles(values, ["sku"], "quantity", [0.0, 0.1, 0.5, 0.99, 1.0], split=True, skew=skew)
    flat = lambda df: rows(df.select("sku", F.col("n").cast("long").alias("n"), *[F.col("q")[i].alias(f"q{i}") for i in range(5)]))
    assert flat(ranks) == flat(plain)
    total = exact_quantiles(values, [], "quantity", [0.5], split=True).first()["q"][0]
    assert total == pytest.approx(exact_quantiles(values, [], "quantity", [0.5], split=False).first()["q"][0])


def test_plans_are_built_without_a_job(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    clean.fill_neighbour(skewed, ["quantity"])
    anomaly.detect_iqr(skewed)
    anomaly.detect_zeros(skewed)
    features.create_features(skewed, "all_20")
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("slots", [4, 1024])
def test_ranked_with_many_ties(spark, slots):
    items = spark.range(3000).select(
        F.col("id").cast("string").alias("sku"),
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 0, -1.5).otherwise(F.sqrt("id")).alias("v"),
    )
    got = ranked(items, "v", buckets=8, slots=slots).collect()
    expected = sorted(items.withColumn("h", F.md5(F.col("sku").cast("binary"))).collect(), key=lambda r: (-r["v"], r["h"]))
    running = 0.0
    by_sku = {row["sku"]: row for row in got}
    for place, row in enumerate(expected, start=1):
        running += row["v"]
        assert by_sku[row["sku"]]["rank"] == place
        assert by_sku[row["sku"]]["running"] == pytest.approx(running)
