"""Near-duplicate vectors by lattice hashing: E8 cells in several tables, neighbouring cells probed.

A random rotation splits a unit vector into blocks of eight coordinates, one table each. Two
vectors with cosine >= c lie at most D = sqrt(2 - 2c) apart, so in at least one table their
blocks lie at most D / sqrt(tables) apart. Blocks are decoded to the nearest point of the E8
lattice, scaled so that half that distance is ``REACH`` of its covering radius; a vector is entered
in every neighbouring cell that a point within half the distance could fall into. The two then
meet in the cell of the middle of their blocks: no pair is missed. Candidates are verified by
cosine in double precision.

A link is counted once, in the table where its blocks are nearest and in the cell of their
middle. Cells of any size are compared block by block (``common.paired_blocks``); only link
counts per vector and one link to a smaller vector leave a block, never its pairs. Equal vectors
of one label are one entry with a weight.

Defined results: only vectors with equal, non-null labels are compared; vectors that are null,
empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
different lengths; repeated rows are vectors of their own and link with each other; a null
``vec_id`` never is a component id unless its group has no other; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm import common

COSINE = 0.98
REACH = 0.25
SEED = 20_240_229
BLOCK_ROWS = 512
ROWS_AT_ONCE = 1024
SLACK = 1e-5


@cache
def neighbours() -> np.ndarray:
    """The E8 points of squared norm 2 and 4, in halves: 240 + 2160 rows of eight integers."""
    found = []
    for count, size in ((2, 2), (4, 2), (1, 4)):  # whole coordinates +-1 twice or four times, +-2 once
        for places in combinations(range(8), count):
            for signs in product((-size, size), repeat=count):
                row = [0] * 8
                for place, value in zip(places, signs):
                    row[place] = value
                found.append(row)
    for signs in product((-1, 1), repeat=8):  # half coordinates, even sum
        for place in (None, *range(8)):
            row = [s * 3 if i == place else s for i, s in enumerate(signs)]
            if sum(row) % 4 == 0:
                found.append(row)
    points = np.array(found, np.int64)
    return points[(points ** 2).sum(1) <= 16]


def nearest(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row, in halves."""
    def even_sum(x: np.ndarray) -> np.ndarray:
        whole = np.rint(x)
        odd = np.flatnonzero(whole.sum(1) % 2 != 0)
        off = x[odd] - whole[odd]
        worst = np.abs(off).argmax(1)
        whole[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return whole

    first, second = even_sum(points), even_sum(points - 0.5) + 0.5
    closer = ((points - second) ** 2).sum(1) < ((points - first) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], second, first)).astype(np.int64)


@cache
def rotation(tables: int) -> np.ndarray:
    """The same random rotation of 8 * tables coordinates everywhere."""
    normal = np.random.Generator(np.random.PCG64(SEED + tables)).standard_normal((8 * tables, 8 * tables))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _cell_keys(sums: np.ndarray, table: np.ndarray, label: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of cells, from the cell's weighted coordinate sums."""
    named = _mixed(sums + _mixed(label.astype(np.int64).view(np.uint64) * np.uint64(1_000_003) + table.astype(np.uint64)))
    return _mixed(named + np.uint64(length)).view(np.int64)


def _weighted(points: np.ndarray) -> np.ndarray:
    return (points.view(np.uint64) * FACTORS).sum(axis=1, dtype=np.uint64)


def unit_blocks(vectors: np.ndarray) -> np.ndarray:
    """(vectors, tables, 8): rotated blocks of the normalised rows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the norm
    vectors = vectors / np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    tables = -(-vectors.shape[1] // 8)
    padded = np.zeros((len(vectors), 8 * tables))
    padded[:, :vectors.shape[1]] = vectors
    return (padded @ rotation(tables)).reshape(len(vectors), tables, 8)


def cell_size(tables: int, cosine: float, reach: float) -> float:
    return np.sqrt((2 - 2 * cosine) / tables) / 2 / reach


def probed_cells(vectors: np.ndarray, label: np.ndarray, cosine: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table, key) of every cell that each vector is entered in."""
    blocks = unit_blocks(vectors)
    tables = blocks.shape[1]
    points = np.ascontiguousarray(blocks.reshape(-1, 8)) / cell_size(tables, cosine, reach)
    around = neighbours()
    norms = np.sqrt((around ** 2).sum(1)) / 2
    limits = (norms ** 2 / 2 - (reach + SLACK) * norms).astype(np.float32)  # beyond it a neighbour can't be reached
    directions = (around / 2).T.astype(np.float32)
    around_sums = _weighted(around)
    rows, sums = [], []
    for at in range(0, len(points), ROWS_AT_ONCE):
        own = nearest(points[at:at + ROWS_AT_ONCE])
        offset = (points[at:at + ROWS_AT_ONCE] - own / 2).astype(np.float32)
        row, neighbour = np.nonzero(offset @ directions >= limits)
        own_sums = _weighted(own)
        rows += [at + np.arange(len(own)), at + row]
        sums += [own_sums, own_sums[row] + around_sums[neighbour]]
    rows, sums = np.concatenate(rows), np.concatenate(sums)
    row, table = rows // tables, rows % tables
    return row, table, _cell_keys(sums, table, label[row], vectors.shape[1])


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows filled up with zeros to the longest, length of each)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(lengths), int(lengths.max(initial=0))))
    found[np.arange(found.shape[1]) < lengths[:, None]] = flat
    return found, lengths


def _entries(cosine: float, reach: float):
    def work(batches):
        for batch in batches:
            label, group, vec = common.columns(batch, "label", "group_id", "vec")
            label, group = label.to_numpy(), group.to_numpy()
            vectors, lengths = _matrix(vec)
            for length in np.unique(lengths):
                of_length = np.flatnonzero(lengths == length)
                for at in range(0, len(of_length), ROWS_AT_ONCE):
                    part = of_length[at:at + ROWS_AT_ONCE]
                    row, table, key = probed_cells(vectors[part, :length], label[part], cosine, reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(table.astype(np.int32)), pa.array(group[part][row])], ["_key", "_table", "group_id"])

    return work


def _verified(cosine: float, reach: float):
    def counted_here(blocks, key, table, label, length, a, b):
        """Pairs whose nearest table and middle cell are the ones they met in."""
        off = ((blocks[a] - blocks[b]) ** 2).sum(axis=2)
        here = off.argmin(axis=1) == table[a]
        middle = (blocks[a, table[a]] + blocks[b, table[a]]) / 2 / cell_size(blocks.shape[1], cosine, reach)
        return here & (_cell_keys(_weighted(nearest(middle)), table[a], label[a], length) == key[a])

    def work(batches):
        for rows, starts in common.whole_runs(batches, ("_key", "_i", "_j")):
            key, table, group, label, weight, own, first, second = (
                rows.column(c).to_numpy() for c in ("_key", "_table", "group_id", "label", "weight", "_b", "_i", "_j"))
            vectors, lengths = _matrix(rows.column("vec").combine_chunks())
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            norms = np.sqrt((scaled ** 2).sum(axis=1))
            links = np.zeros(len(key), np.int64)
            found_a, found_b = [], []
            for a, b in common.pairs_within(starts, len(key), (own, first, second), at_once=50_000):
                alike = (label[a] == label[b]) & (lengths[a] == lengths[b]) & (table[a] == table[b])
                a, b = a[alike], b[alike]
                near = np.einsum("ij,ij->i", scaled[a], scaled[b]) / (norms[a] * norms[b]) >= cosine
                a, b = a[near], b[near]
                found_a.append(a)
                found_b.append(b)
                for length in np.unique(lengths[a]):
                    of_length = lengths[a] == length
                    la, lb = a[of_length], b[of_length]
                    used = np.unique(np.concatenate([la, lb]))
                    blocks = unit_blocks(vectors[used, :length])
                    place = np.searchsorted(used, np.arange(len(key)))
                    here = counted_here(blocks, key[used], table[used], label[used], length, place[la], place[lb])
                    np.add.at(links, la[here], weight[lb[here]])
                    np.add.at(links, lb[here], weight[la[here]])
            root = common.smallest_labels(len(key), np.concatenate(found_a), np.concatenate(found_b))
            linked = np.flatnonzero((links > 0) | (root != np.arange(len(key))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[linked]), pa.array(group[root[linked]]), pa.array(links[linked])], ["a", "b", "links"])

    return work


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, reach: float = REACH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    if not 0 < reach < 0.44:
        raise ValueError("reach must be between 0 and 0.44, or cells further than two shells away would matter")
    usable = _usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", usable.alias("_usable"))
    group = F.when(F.col("_usable"), F.xxhash64("label", "embedding")).alias("group_id")  # equal vectors of one label
    named = common.keep(rows.select("vec_id", group))
    groups = common.keep(
        rows.filter("_usable").select(group, "vec_id", "label", "embedding")
        .groupBy("group_id").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"),
                                 F.first("label").alias("label"), F.first("embedding").alias("vec")))
    entries = common.map_batches(groups.select("label", "group_id", "vec"), _entries(cosine, reach), "_key long, _table int, group_id long")
    blocks = common.paired_blocks(entries, ("_key", "_table"), "group_id", block_rows)
    filled = blocks.join(groups.select("group_id", "label", "weight", "vec"), "group_id")
    found = common.keep(common.map_batches(
        common.grouped(filled, ("_key", "_table", "_i", "_j")), _verified(cosine, reach), "a long, b long, links long"))
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "group_id")
    roots = common.components(found.select("a", "b")).withColumnRenamed("v", "group_id")
    placed = groups.select("group_id", "weight", "first_id").join(linked, "group_id", "left").join(roots, "group_id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "group_id"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_group = placed.join(smallest, "root").select(
        "group_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return named.join(per_group, "group_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
