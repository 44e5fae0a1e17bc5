"""The trend with changing slope: planted bends, conditions of the minimum, plain descent on the whole problem."""

import numpy as np
import pytest

from tallycast.operators import series
from tallycast.operators.models import additive
from tests.test_cases import START, demand

LAST = np.datetime64("2024-03-03")


def bent(rng, n, bend, noise=2.0):
    t = np.arange(n)
    return 200 + 0.5 * t - 2.5 * np.maximum(t - bend, 0) + rng.normal(0, noise, n)


def test_planted_bend_is_found_and_continued():
    rng = np.random.default_rng(1)
    for bend in (40, 70, 100):
        ys = bent(rng, 150, bend)
        model = additive.Additive("W")
        (changes,), _ = model.slope_changes([ys], [LAST])
        places = additive.bend_places(150)
        near = np.abs(places - bend) <= 8
        assert changes[near].sum() / 149 == pytest.approx(-2.5, rel=0.25)
        assert np.abs(changes[~near]).sum() < 0.25 * np.abs(changes[near]).sum()
        ahead = np.array(model.fit([ys], [LAST], [True], 6, None)[0]["forecast"])
        t = np.arange(150, 156)
        assert np.abs(ahead - np.maximum(200 + 0.5 * t - 2.5 * (t - bend), 0)).max() < 12


def test_changes_meet_the_conditions_of_the_minimum():
    rng = np.random.default_rng(2)
    table = [bent(rng, n, n // 2, noise) for n in (5, 12, 40, 90, 200) for noise in (0.1, 5.0, 40.0)]
    changes, weights = additive.Additive("W").slope_changes(table, [LAST] * len(table))
    for ys, change, weight in zip(table, changes, weights):
        top = np.abs(ys).max()
        days = additive.period_days(LAST, len(ys), 0, "W")
        gram, target, _ = additive.normal_equations(days, ys[None] / top, False)
        pull = target[0] - gram @ (change / top)
        off = np.where(change != 0, np.abs(pull - weight * np.sign(change)), np.maximum(np.abs(pull) - weight, 0))
        assert off.max(initial=0) <= 1e-5 * weight + 1e-12


def test_elimination_gives_the_minimum_of_the_whole_problem():
    """Plain coordinate descent over all columns at once, the other terms included."""
    rng = np.random.default_rng(3)
    ys = bent(rng, 30, 12)
    days = additive.period_days(LAST, 30, 0, "W")
    (change,), (weight,) = additive.Additive("W").slope_changes([ys], [LAST])
    top = np.abs(ys).max()
    base, hinges = additive._design(days, days[-1] - days[0], False), additive.bend_columns(days, 30)
    penalty = np.full(base.shape[1], additive.RIDGE * 30)
    penalty[:2] = 1e-9

    def loss(c):
        rest = ys / top - hinges @ c
        w = np.linalg.solve(base.T @ base + np.diag(penalty), base.T @ rest)
        return ((rest - base @ w) ** 2).sum() / 2 + (penalty * w * w).sum() / 2 + weight * np.abs(c).sum()

    least = loss(change / top)
    for _ in range(300):
        step = np.zeros(len(change))
        step[rng.integers(len(change))] = rng.normal(0, 10.0 ** rng.integers(-6, 0))
        assert loss(change / top + step) >= least - 1e-9


def test_bends_of_odd_series(spark):
    assert additive.bend_places(0).tolist() == additive.bend_places(2).tolist() == []
    assert len(additive.bend_places(1000)) == additive.BENDS
    both = demand(spark, [3.0] * 9, sku="flat").union(demand(spark, [4.0], sku="one")).union(demand(spark, [0.0] * 9, sku="zero"))
    rows = additive.trend_bends(series.pack(both, "D"), "D").collect()
    assert {r["sku"] for r in rows} == {"flat", "zero"}
    assert all(abs(r["slope_change"]) < 1e-3 for r in rows)
    assert min(r["period"] for r in rows) > START
    assert additive.trend_bends(series.pack(both.limit(0), "D"), "D").count() == 0
