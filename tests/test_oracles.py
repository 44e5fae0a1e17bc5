"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import pytest

import __spark_entry__ as entry
from tallycast.plans import catalog
from tests.oracle import compare

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
ROWS_ONLY = {"m9_additive", "m9_trend_bends", "m10_gbt_leaf", "m10_gbt_depth", "m16_batch", "m6_refined", "m7_exact"}
MAY_BE_EMPTY = {"e9_problem_items", "e10_filter_results", "a1_iqr_negative", "a10_filter", "g11_select_clusters", "c4_search"}


def test_only_fits_without_sql_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, folder, name):
    problem, rows, _, _ = compare(spark, duck, folder, QUERIES[name], ORACLES[name])
    assert not problem
    assert rows > 0 or name in MAY_BE_EMPTY


def test_flagship(spark):
    df = entry.entry(spark)
    assert 0 < df.count() <= 12
