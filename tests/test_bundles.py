"""Bundles of tables: replaced together, whole after a failed save, readable while replaced."""

import pytest
from pyspark.sql import functions as F

from tallycast.operators import stages
from tallycast.schema import Mapping
from tallycast.sources import files

MAPPING = Mapping("d", "s", "q", None, None, None)


def tables(spark, number):
    one = spark.range(3).select("id", F.lit(number).alias("n"))
    return {"one": one, "two": one.filter("id > 0")}


def values(found):
    return {name: sorted(tuple(r) for r in table.collect()) for name, table in found.items()}


def state(number):
    return {"one": [(i, number) for i in range(3)], "two": [(i, number) for i in (1, 2)]}


def test_a_save_killed_in_the_middle_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "stages")
    stages.save_stages(spark, path, tables(spark, 1), MAPPING)
    broken = {"one": tables(spark, 2)["one"], "two": tables(spark, 2)["two"].withColumn("n", F.raise_error(F.lit("killed")).cast("int"))}
    with pytest.raises(Exception, match="killed"):
        stages.save_stages(spark, path, broken, MAPPING)
    found, mapping = stages.load_stages(spark, path)
    assert values(found) == state(1) and mapping == MAPPING
    stages.save_stages(spark, path, tables(spark, 3), MAPPING)
    assert values(stages.load_stages(spark, path)[0]) == state(3)


def test_reader_keeps_its_state_and_a_table_may_replace_itself(spark, tmp_path):
    path = str(tmp_path / "b")
    files.write_bundle(spark, tables(spark, 1), path)
    old = files.read_bundle(spark, path)
    files.write_bundle(spark, {name: t.withColumn("n", F.col("n") + 1) for name, t in old.items()}, path)
    assert values(old) == state(1)
    assert values(files.read_bundle(spark, path)) == state(2)
    assert files.drop_old_saves(spark, path) == 1
    assert files.drop_old_saves(spark, path) == 0
    assert values(files.read_bundle(spark, path)) == state(2)


def test_tables_of_a_save_are_those_it_named(spark, tmp_path):
    path = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        files.read_bundle(spark, path)
    assert files.drop_old_saves(spark, path) == 0
    files.write_bundle(spark, tables(spark, 1), path)
    files.write_bundle(spark, {"two": tables(spark, 2)["two"]}, path, "csv")
    assert values(files.read_bundle(spark, path)) == {"two": [("1", "2"), ("2", "2")]}
    with pytest.raises(KeyError, match="one"):
        files.read_bundle(spark, path, ["one"])


def test_saves_at_once_leave_one_whole_state(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "b")
    files.write_bundle(spark, tables(spark, 1), path)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: files.write_bundle(spark, tables(spark, n), path), (2, 3, 4)))
    assert values(files.read_bundle(spark, path)) in [state(n) for n in (2, 3, 4)]
