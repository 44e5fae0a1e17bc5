"""Shared folder, Arrow batches, candidate groups in bounded blocks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tallycast-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallycast-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def release(df: DataFrame) -> None:
    """Delete a table made by ``keep`` that nothing will read again."""
    spark, path = df.sparkSession, getattr(df, "kept_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the bytes of the Arrow batches that ``df`` is passed to Python in, whatever the text lengths.

    Lowers the session's limit where it is above ``BATCH_BYTES``.
    """
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmg]?)b?", str(conf.get(key)).strip().lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` takes an iterator of record batches and yields record batches."""
    return small_batches(df).mapInArrow(work, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The values as UTF-8 bytes without copying the whole column; null as empty."""
    whole = pa.array([], pa.binary()) if len(column) == 0 else column.cast(pa.large_binary())
    for value in whole:
        yield value.as_py() or b""


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(name)) for name in names]


# --- candidate groups -------------------------------------------------------------------------


def joined(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the corpus, as a merge join.

    Spark sizes a table by the files it is read from, not by the rows that an explode makes of each, and would
    broadcast millions of rows it takes for a few megabytes.
    """
    return left.join(right.hint("merge"), on, how)


def paired_blocks(members: DataFrame, keys: Sequence[str], member: str, block_rows: int) -> DataFrame:
    """Rows of groups with two or more members, dealt out so that no task needs a whole group.

    A group is cut by the hash of its member into blocks of about ``block_rows``; every pair
    of blocks (``_i`` <= ``_j``) becomes a group of its own, and each row, with its block
    ``_b``, goes to the pairs its block takes part in. Any two members of a group meet in
    exactly one of these. Counting combines before its shuffle; singletons go no further.
    """
    keys = list(keys)
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    dealt = joined(members, counts, keys).withColumn("_blocks", blocks).withColumn(
        "_b", F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("_blocks")).cast("int")
    )
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(
        F.least("_b", k).alias("_i"), F.greatest("_b", k).alias("_j")
    ))
    return dealt.select(*members.columns, "_b", F.inline(others))


def grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group in one partition, its rows next to each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, start of each group) with every group of a ``grouped`` partition in one piece."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        starts = _starts(rows, keys)
        cut = int(starts[-1])
        if cut:
            yield rows.slice(0, cut), starts[:-1]
        rest = rows.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, _starts(rest, keys)


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    changed = np.zeros(rows.num_rows, bool)
    changed[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def pairs_within(starts: np.ndarray, total: int, blocks: tuple[np.ndarray, np.ndarray, np.ndarray],
                 at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs a < b of rows that share a group: all of a block with itself, else one of each block.

    ``blocks`` holds each row's own block and the two blocks of its group.
    """
    own, first, second = blocks
    ends = np.append(starts[1:], total)
    follows = np.repeat(ends, ends - starts) - np.arange(total) - 1  # rows after this one in its group
    upto = np.cumsum(follows)
    begin = 0
    while begin < total:
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + at_once, side="right"))
        end = min(total, max(end, begin + 1))
        count = follows[begin:end]
        a = np.repeat(np.arange(begin, end), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        meets = (first[a] == second[a]) | (own[a] != own[b])
        yield a[meets], b[meets]
        begin = end


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 linked by (a, b): the smallest row reachable."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return label


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b longs); two vertices share a root if connected.

    Rounds of contraction: each vertex points to its smallest neighbour, pointers are
    doubled until they end at a local minimum, and the edges between different ends form
    the next, at most half as large, graph. All tables stay distributed; each round is
    written to the shared folder, so lost executors repeat a round at most.
    """
    edges = keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = keep(both.groupBy("a").agg(F.min("b").alias("p")).select(
            F.col("a").alias("v"), F.least("a", "p").alias("p")))
        while True:
            above = parents.select(F.col("v").alias("p"), F.col("p").alias("_pp"))
            jumped = keep(parents.join(above, "p").select("v", F.col("_pp").alias("p"), (F.col("p") != F.col("_pp")).alias("moved")))
            release(parents)
            parents = jumped
            if parents.filter("moved").isEmpty():
                break
        rounds.append(parents.select("v", "p"))
        ends = [parents.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b")]
        linked = edges.join(ends[0], "a").join(ends[1], "b").filter("pa <> pb")
        following = keep(linked.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        release(edges)
        edges = following
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = rounds[0].withColumnRenamed("p", "root")
    for later in rounds[1:]:
        later = later.select(F.col("v").alias("root"), F.col("p").alias("_next"))
        found = found.join(later, "root", "left").select("v", F.coalesce("_next", "root").alias("root"))
    return found
