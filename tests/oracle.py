"""Runs queries on Spark and their SQL on DuckDB over the same tables and compares the rows.

``python -m tests.oracle [--sf sf0.01] [name or prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = os.environ.get("TALLYCAST_TESTDATA", "/root/testdata")


def make_spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


def _key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def compare(spark, con, folder: str, query, sql: str | None) -> tuple[str, int, float, float]:
    """(problem or '', rows, Spark seconds, SQL seconds)."""
    start = time.time()
    df = query(spark, folder)
    names = sorted(df.columns)
    left = sorted((tuple(_cell(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    spent = time.time() - start
    if sql is None:
        return "", len(left), spent, 0.0
    start = time.time()
    result = con.execute(sql)
    columns = [item[0] for item in result.description]
    rows = result.fetchall()
    sql_spent = time.time() - start
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}", len(left), spent, sql_spent
    order = [columns.index(n) for n in names]
    right = sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}", len(left), spent, sql_spent
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {names}: {wrong[0][0]} against {wrong[0][1]}", len(left), spent, sql_spent
    return "", len(left), spent, sql_spent


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry

    scale = "sf0.01"
    if arguments[:1] == ["--sf"]:
        scale, arguments = arguments[1], arguments[2:]
    folder = f"{DATA}/{scale}"
    spark, con = make_spark(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if arguments and not any(name == a or name.startswith(a) for a in arguments):
            continue
        try:
            problem, rows, spent, sql_spent = compare(spark, con, folder, query, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem, rows, spent, sql_spent = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0.0, 0.0
        failed += bool(problem)
        state = "FAIL " + problem if problem else ("ok" if name in oracles else "rows only")
        print(f"{name:28s} rows={rows:<8d} spark={spent:6.2f}s sql={sql_spent:6.2f}s {state}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
