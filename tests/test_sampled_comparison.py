"""The sampled comparison: 50 items as registered, and a sample smaller than the table."""

from tallycast.operators import forecast
from tallycast.plans import catalog
from tallycast.plans.forecast_queries import H, _supp, sampled_sql


def test_registered_comparison_asks_for_fifty_items(spark, folder):
    folder = folder.replace("0.001", "0.01")
    assert _supp(spark, folder).select("sku").distinct().count() > 50
    found = catalog.queries()["m18_compare_sample"](spark, folder).collect()
    fifty = forecast.compare_models(_supp(spark, folder), H, "M", 50).collect()
    assert {(r.model, round(r.avg_mape, 6)) for r in found} == {(r.model, round(r.avg_mape, 6)) for r in fifty}


def test_comparison_of_six_items_matches_sql(spark, duck, folder):
    def query(s, d):
        return forecast.compare_models(_supp(s, d), H, "M", 6).select("model", "avg_mape", "avg_mae", "win_rate")

    names = query(spark, folder).columns
    assert _supp(spark, folder).select("sku").distinct().count() > 6
    left = sorted(tuple(r[n] for n in names) for r in query(spark, folder).collect())
    right = sorted(tuple(r) for r in duck.execute(f"SELECT {', '.join(names)} FROM ({sampled_sql(6)})").fetchall())
    assert len(left) == len(right) == 5
    assert all(a[0] == b[0] and all(abs(x - y) <= 1e-6 * max(1, abs(y)) for x, y in zip(a[1:], b[1:])) for a, b in zip(left, right))
