"""CSV files with line breaks in values, cut anywhere: the rows and their order as one task reads them."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tallycast.sources import csv_records, files

PIECES = ["a", "bb", ",", '"', '""', "\n", "\n\n", " ", "é", "x,y", '",', ',"', "1.50", "\t", "\n,", '"\n"']


@pytest.fixture
def tiny_parts(spark):
    saved = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for name, value in saved.items():
        spark.conf.set(name, value)


def texts(seed, rows):
    rng = random.Random(seed)
    return [["".join(rng.choices(PIECES, k=rng.randrange(6))) for _ in range(3)] for _ in range(rows)]


def write(path, rows, line_end="\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as out:
        csv.writer(out, lineterminator=line_end, quoting=csv.QUOTE_ALL).writerows([["one", "two", "with.dot"], *rows])


def read(spark, path, **options):
    found = files.read_csv(spark, str(path), row_id="n", **options)
    assert found.columns == ["one", "two", "with.dot", "n"]
    return [list(row[:3]) for row in sorted(found.collect(), key=lambda row: row["n"])]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_rows_and_order_are_those_written(spark, tmp_path, tiny_parts, size, line_end):
    rows = texts(size, 60)
    write(tmp_path / "a.csv", rows, line_end)
    tiny_parts(size)
    assert read(spark, tmp_path / "a.csv") == rows
    found = files.read_csv(spark, str(tmp_path / "a.csv"), row_id="n")
    assert found.select("n").distinct().count() == len(rows)
    if size == 7:
        assert csv_records.parts(spark, str(tmp_path / "a.csv")).count() > 50


def test_folder_of_files_with_a_long_value_over_many_parts(spark, tmp_path, tiny_parts):
    first, second = texts(1, 20), texts(2, 20)
    first[3][1] = "line\n" * 200 + '"' * 40  # over many parts, some of which begin no record
    write(tmp_path / "a.csv", first)
    write(tmp_path / "b.csv", second)
    tiny_parts(50)
    assert read(spark, tmp_path) == first + second


def test_latin1_and_quotes_inside_plain_values(spark, tmp_path, tiny_parts):
    rows = [["é\nü", '5" pipe', "x"], ["ß", "", 'say "hi", then\n"bye"']]
    write(tmp_path / "a.csv", rows, encoding="latin-1")
    tiny_parts(9)
    assert read(spark, tmp_path / "a.csv") == rows
    plain = 'one,two,with.dot\nq,5" pipe,x\nr,"6"" pipe\nlong",y\n\ns,7" pipe,"z"\n,"",\n'
    (tmp_path / "b.csv").write_text(plain)
    expected = [["q", '5" pipe', "x"], ["r", '6" pipe\nlong', "y"], ["s", '7" pipe', "z"], [None, "", None]]
    assert read(spark, tmp_path / "b.csv") == expected
    whole = files.read_csv(spark, str(tmp_path / "b.csv"), "UTF-8", True)
    assert [list(row) for row in whole.collect()] == expected


def test_files_without_line_breaks_or_with_bare_carriage_returns(spark, tmp_path, tiny_parts):
    tiny_parts(16)
    (tmp_path / "a.csv").write_text('one,two,with.dot\n1,2,3\n"4","5,""",6\n')
    assert read(spark, tmp_path / "a.csv") == [["1", "2", "3"], ["4", '5,"', "6"]]
    assert read(spark, tmp_path / "a.csv", encoding="UTF-8", line_breaks=False) == [["1", "2", "3"], ["4", '5,"', "6"]]
    (tmp_path / "b.csv").write_bytes(b'one,two,with.dot\n1,"a\rb",3\n4,"c\nd",6\n')
    assert read(spark, tmp_path / "b.csv") == [["1", "a\rb", "3"], ["4", "c\nd", "6"]]


def test_load_names_the_order(spark, tmp_path):
    write(tmp_path / "a.csv", [["x\ny", "", "z"]])
    assert files.load(spark, str(tmp_path / "a.csv"), row_id="n").columns[-1] == "n"
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert files.load(spark, str(tmp_path / "p.parquet"), row_id="n").agg(F.count_distinct("n")).first()[0] == 3
    (tmp_path / "e.csv").write_text("one,two\n")
    with pytest.raises(ValueError, match="no data"):
        files.load(spark, str(tmp_path / "e.csv"), row_id="n")
