"""The registered queries of the subpackage: names, SQL where there is any, whole results."""

import pytest

import __spark_entry__ as entry
from tallycast.llm import queries
from tests.oracle import compare


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_matches_sql(spark, duck, folder, name):
    problem, rows, _, _ = compare(spark, duck, folder, queries.queries()[name], queries.oracles()[name])
    assert not problem and rows > 0


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracles()) - {"op11_spelling"}))
def test_query_covers_its_table(spark, folder, name):
    found = queries.queries()[name](spark, folder)
    key = "vec_id" if "vec_id" in found.columns else "doc_id"
    source = spark.read.parquet(f"{folder}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet")
    assert found.select(key).distinct().count() == source.select(key).distinct().count()
