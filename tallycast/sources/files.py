"""CSV and Parquet readers and writers, and the bundle of tables kept per stage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallycast.functions.scale import kept
from tallycast.sources.csv_records import parts, read_records

# What Spark would trim or mix up by default: blanks at the edges, and empty text with null.
EXACT_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
SUFFIX_FORMAT = {"csv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet"}


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, line_breaks: bool | None = None, row_id: str | None = None
) -> DataFrame:
    """All columns as text; roles are typed later by ``conform``.

    Without an encoding, UTF-8 is used unless a line is not valid UTF-8; then the file is
    Latin-1. ``line_breaks`` says whether quoted values hold line breaks. Without it, a line with an odd number of
    quotes tells. Give both, and the pass over the lines that finds them out is saved.

    With ``row_id``, a column of that name holds the ingest order as a unique long, and a file with line breaks is
    read by all tasks; without it one task reads such a file, in order. A file that has carriage returns
    other than before a line feed stays with one task, as they may end lines.
    """
    if row_id is not None:
        return _read_csv_in_order(spark, path, encoding, line_breaks, row_id)
    if encoding is None or line_breaks is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
        found = spark.read.text(path).agg(
            F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)).alias("damaged"),
            F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("odd"),
        ).first()
        encoding = encoding or _encoding(found["damaged"])
        line_breaks = found["odd"] if line_breaks is None else line_breaks
    return spark.read.options(**_csv_options(line_breaks), encoding=encoding).csv(path)


def _encoding(damaged: bool) -> str:
    return "ISO-8859-1" if damaged else "UTF-8"


def _csv_options(line_breaks: bool) -> dict:
    # Spark takes what equals nullValue as null; with the default, "", that would be quoted empty text too
    return {**EXACT_CSV, "nullValue": "\0", "multiLine": line_breaks}


def _read_csv_in_order(spark: SparkSession, path: str, encoding: str | None, line_breaks: bool | None, row_id: str) -> DataFrame:
    if line_breaks is not False:
        known = kept(parts(spark, path))
        flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in
                 (("crosses", F.col("crosses")), ("bare", F.col("bare")), ("damaged", ~F.col("valid")))]
        found = known.agg(*flags).first()
        encoding = encoding or _encoding(found["damaged"])
        if found["crosses"] and not found["bare"]:
            options = _csv_options(True)
            schema = spark.read.options(**options, encoding=encoding).csv(path).schema  # reads one header
            return read_records(spark, path, known, schema, options, encoding, row_id)
        line_breaks = found["crosses"] or found["bare"]
    return with_row_id(read_csv(spark, path, encoding, line_breaks), row_id)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_format(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in SUFFIX_FORMAT:
        raise ValueError(f"unsupported file type: .{suffix}")
    return SUFFIX_FORMAT[suffix]


def load(spark: SparkSession, path: str, fmt: str | None = None, row_id: str | None = None) -> DataFrame:
    """Read by suffix, or by ``fmt`` when given; an empty table is an error. ``row_id`` names a column of the ingest order."""
    fmt = fmt or file_format(path)
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported file type: {fmt}")
    if fmt == "csv":
        table = read_csv(spark, path, row_id=row_id)
    else:
        table = read_parquet(spark, path) if row_id is None else with_row_id(read_parquet(spark, path), row_id)
    if table.isEmpty():
        raise ValueError("file contains no data")
    return table


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Ingest order as a unique long: split number in the high bits, row in the low bits."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text that reads back as it was: blanks kept, empty text in quotes, null as nothing."""
    df.write.mode(mode).options(**EXACT_CSV).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def preview(df: DataFrame, rows: int = 1000, order: str = "row_id") -> DataFrame:
    """First rows in ingest order: a top-k per split, never a full sort."""
    return df.orderBy(order).limit(rows)


# --- bundles: tables that are replaced together -------------------------------------------------

COMMIT = "number long, folder string, format string, tables array<string>"


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """One row for each complete save under ``path``; None where nothing was saved."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_commit(spark: SparkSession, path: str) -> Row | None:
    """The save that readers see: the highest number, of equal ones the last folder name."""
    found = _commits(spark, path)
    return None if found is None else found.orderBy(F.desc("number"), F.desc("folder")).first()


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Replace all tables under ``path`` in one step.

    The tables go to a folder of their own; a row that names the folder is then written under ``commits``. It is
    one file, which Spark puts in place by one rename (or one upload), so a reader sees the whole former state or the
    whole new one, and a save that was killed leaves the former state. Of saves at the same time one is seen. A table
    may be made from the bundle it replaces. Former states stay readable until ``drop_old_saves``.
    """
    writer = {"parquet": write_parquet, "csv": write_csv}[fmt]
    before = last_commit(spark, path)
    folder = f"save-{uuid.uuid4().hex}"
    for name, table in tables.items():
        writer(table, f"{path.rstrip('/')}/{folder}/{name}")
    row = (before.number + 1 if before else 1, folder, fmt, sorted(tables))
    spark.createDataFrame([row], COMMIT).coalesce(1).write.parquet(f"{path.rstrip('/')}/commits/{folder}")


def read_bundle(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the last complete save, or those of ``names``; all of the same save."""
    commit = last_commit(spark, path)
    if commit is None:
        raise FileNotFoundError(f"no complete save under {path}")
    unknown = sorted(set(names or ()) - set(commit.tables))
    if unknown:
        raise KeyError(f"not in the last save: {', '.join(unknown)}")
    reader = {"parquet": read_parquet, "csv": read_csv}[commit.format]
    return {name: reader(spark, f"{path.rstrip('/')}/{commit.folder}/{name}") for name in names or commit.tables}


def drop_old_saves(spark: SparkSession, path: str) -> int:
    """Delete the folders under ``path`` of saves before the last complete one; how many there were.

    Folders that no commit names are left, as a save may be writing them. Call it when no reader uses a former state.
    """
    found, last = _commits(spark, path), last_commit(spark, path)
    if last is None:
        return 0
    dropped = 0
    for row in found.filter(F.col("folder") != last.folder).select("folder").collect():  # one short row for each save
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{row.folder}")
        dropped += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return dropped
