"""Level-wise gradient boosting on packed bins (M10): the trees that MLlib's ``GBTRegressor`` grows, from a few bytes a row.

MLlib holds a row as Java objects (104 bytes for its bins alone, by their layout), which no longer fit into memory for some 100 million
rows and are read at every level of every tree. Here a row of 12 features is 20 bytes: bins of a few features share one code,
and the residual stands beside them.
Splits are those of MLlib: candidates at equal counts of a sample of 10,000 rows, drawn with the same numbers, the first
of the best splits by variance, squared error with residuals doubled. A pass sums residuals and counts by (node, bundle, code) in the
tasks; only sums by (node, feature, bin) reach the driver, in an order that is always the same.

Each tree makes the next residuals as a table of its own; a lost part is made again from the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from tallycast.operators.models.forest import Forest, flat

BINS = 32
SAMPLE_ROWS = 10_000
CODES = 1024  # of one bundle
CHUNK_ROWS = 1 << 16
PART_ROWS = 1 << 22  # packed rows of one task
FEW_PARTS = 64  # whose sums are added up on the driver


def sampled(rows: DataFrame, names: Sequence[str], count: int, seed: int) -> tuple[np.ndarray, float]:
    """(values of the rows that splits are chosen from, their expected share): all rows, or those that MLlib draws."""
    rows, wanted = rows.select(*names), max(BINS * BINS, SAMPLE_ROWS)
    if wanted < count:
        spark = rows.sparkSession
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = rows._jdf.javaRDD().sample(False, wanted / count, draw)
        rows = type(rows)(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)
    return rows.toPandas().to_numpy(float).reshape(-1, len(names)), min(1.0, wanted / count)


def split_places(values: np.ndarray, expected: float, splits: int) -> np.ndarray:
    """Thresholds of one feature at about equal counts, each between two neighbouring values; zeros make up the expected number.

    A sample larger than expected gives a few more than ``splits``, in MLlib too.
    """
    found, counts = np.unique(values[values != 0], return_counts=True)
    counts = counts.astype(float)
    if not len(found):
        return np.zeros(0)
    missing = expected - counts.sum()
    if missing > np.finfo(float).eps * counts.sum() * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, missing)
    between = (found[:-1] + found[1:]) / 2
    if len(between) <= splits:
        return between
    stride = expected / (splits + 1)
    places, upto, target = [], np.cumsum(counts), stride
    for i, middle in enumerate(between):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            places.append(middle)
            target += stride
    return np.array(places)


@dataclass(frozen=True)
class Bundles:
    """Features share a code: ``bundle[f]`` holds feature f, its bin is ``code // stride[f] % size[f]``."""

    bundle: np.ndarray
    stride: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, sizes: Sequence[int]) -> Bundles:
        bundle, stride, room = np.zeros(len(sizes), int), np.ones(len(sizes), int), []
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            g = next((g for g, used in enumerate(room) if used * sizes[f] <= CODES), len(room))
            if g == len(room):
                room.append(1)
            bundle[f], stride[f] = g, room[g]
            room[g] *= sizes[f]
        return cls(bundle, stride, np.array(sizes))

    def bins(self, feature: int) -> np.ndarray:
        """The bin of the feature by code."""
        return np.arange(CODES) // self.stride[feature] % self.size[feature]


def packed(rows: DataFrame, names: Sequence[str], places: Sequence[np.ndarray], bundles: Bundles) -> DataFrame:
    """(codes, rest): chunks of rows, the codes of one bundle after the other and the labels, of which nothing is predicted yet."""
    count = bundles.bundle.max() + 1

    def chunk(tables: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(tables)
        if not np.isfinite(table[:, -1]).all() or np.isnan(table).any():
            raise ValueError("a training row has a missing feature or label")
        codes = np.zeros((count, len(table)), np.uint16)
        for f, ends in enumerate(places):
            codes[bundles.bundle[f]] += (np.searchsorted(ends, table[:, f]) * bundles.stride[f]).astype(np.uint16)
        return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([table[:, -1].tobytes()], pa.binary())], ["codes", "rest"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(np.column_stack([column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns]))
            held += batch.num_rows
            if held >= CHUNK_ROWS:
                yield chunk(waiting)
                waiting, held = [], 0
        if held:
            yield chunk(waiting)

    return rows.select(*names, "label").mapInArrow(work, "codes binary, rest binary")


@dataclass
class Tree:
    """Nodes in the order they were made; a split node has its feature, its cut and its low child, which the high one follows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    low: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: Sequence[float]) -> list[int]:
        self.feature[node], self.cut[node], self.low[node] = feature, cut, len(self.feature)
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.low.append(len(self.low))
            self.value.append(value)
        return [self.low[node], self.low[node] + 1]

    def nested(self, places: Sequence[np.ndarray], node: int = 0):
        if self.feature[node] < 0:
            return self.value[node]
        f, low = self.feature[node], self.low[node]
        return f, places[f][self.cut[node]], self.nested(places, low), self.nested(places, low + 1)


class Walk:
    """The node of every row of a chunk; one step leads all rows down a level."""

    def __init__(self, tree: Tree, bundles: Bundles, steps: int):
        self.low, self.steps = np.array(tree.low), steps
        self.bundle = np.array([0 if f < 0 else bundles.bundle[f] for f in tree.feature])
        self.high = np.zeros((len(tree.low), CODES), np.uint8)
        for node, f in enumerate(tree.feature):
            if f >= 0:
                self.high[node] = bundles.bins(f) > tree.cut[node]

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        node, row, flat_codes, high = np.zeros(n, np.int64), np.arange(n), codes.ravel(), self.high.ravel()
        for _ in range(self.steps):
            code = flat_codes.take(self.bundle.take(node) * n + row)
            node = self.low.take(node) + high.take(node * CODES + code)
        return node


def _arrays(codes: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    rest = np.frombuffer(rest)
    return np.frombuffer(codes, np.uint16).reshape(-1, len(rest)), rest


def measure(rows: RDD, tree: Tree, wanted: Sequence[int], bundles: Bundles, level: int) -> np.ndarray:
    """(2, wanted nodes, features, bins): sums and counts of the residuals."""
    walk, slots = Walk(tree, bundles, level), np.full(len(tree.low), len(wanted))
    slots[list(wanted)] = np.arange(len(wanted))
    count, width, bins = int(bundles.bundle.max()) + 1, len(bundles.size), int(bundles.size.max())

    def work(chunks) -> Iterator[np.ndarray]:
        found = np.zeros((2, count, len(wanted) + 1, CODES))
        for chunk in chunks:
            codes, rest = _arrays(*chunk)
            first = slots.take(walk.nodes(codes)) * CODES
            for g in range(count):
                cell = first + codes[g]
                found[0, g] += np.bincount(cell, rest, found[0, g].size).reshape(-1, CODES)
                found[1, g] += np.bincount(cell, minlength=found[1, g].size).reshape(-1, CODES)
        sums = np.zeros((2, len(wanted), width, bins))
        for f in range(width):
            sums[:, :, f] = found[:, bundles.bundle[f], :-1] @ (bundles.bins(f)[:, None] == np.arange(bins)).astype(float)
        yield sums

    parts = rows.mapPartitions(work)
    if parts.getNumPartitions() > FEW_PARTS:
        return parts.treeReduce(np.add)
    return sum(parts.collect())


def best_split(found: np.ndarray, splits: np.ndarray, least: int) -> tuple[float, int, int, list[float]]:
    """(gain, feature, cut, means of the children) of a node from its (2, features, bins) sums and counts; the first of equal ones."""
    low = found.cumsum(axis=2)
    high = low[:, :, -1:] - low
    (rest_low, n_low), (rest_high, n_high) = low, high
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = rest_low ** 2 / n_low + rest_high ** 2 / n_high - low[0, :, -1:] ** 2 / low[1, :, -1:]
    gain[(n_low < least) | (n_high < least) | (np.arange(found.shape[2]) >= splits[:, None])] = -np.inf
    feature, cut = divmod(int(np.argmax(gain)), found.shape[2])
    if not gain[feature, cut] > 0:
        return 0.0, 0, 0, []
    return float(gain[feature, cut]), feature, cut, [float(side[0, feature, cut] / side[1, feature, cut]) for side in (low, high)]


def grow(rows: RDD, bundles: Bundles, depth: int, least: int) -> Tree:
    tree, open_nodes, splits = Tree(), [0], bundles.size - 1
    for level in range(depth):
        found = measure(rows, tree, open_nodes, bundles, level)
        if not level:
            total, n = found[:, 0, 0].sum(axis=1)
            tree.value[0] = float(total / n)
        following = []
        for i, node in enumerate(open_nodes):
            gain, feature, cut, means = best_split(found[:, i], splits, least)
            if gain > 0:
                following += tree.split(node, feature, cut, means)
        open_nodes = following
        if not open_nodes:
            break
    return tree


def _scaled(tree: Tree, weight: float) -> Tree:
    return Tree(tree.feature, tree.cut, tree.low, [value * weight for value in tree.value])


def boost(training: DataFrame, names: Sequence[str], count: int, trees: int, seed: int, maxDepth: int, stepSize: float, minInstancesPerNode: int) -> Forest:
    """A forest over the features ``names`` of the ``count`` rows of ``training`` (with ``label``); parameters as in MLlib."""
    if not count:
        raise ValueError("no training rows")
    values, share = sampled(training, names, count, seed)
    places = [split_places(values[:, f], share * count, min(BINS, count) - 1) for f in range(len(names))]
    bundles = Bundles.of([len(ends) + 1 for ends in places])
    parts = min(max(training.sparkSession.sparkContext.defaultParallelism, -(-count // PART_ROWS)), -(-count // CHUNK_ROWS))
    chunks = packed(training.coalesce(parts), names, places, bundles)
    rows = chunks.rdd.map(lambda row: (bytes(row[0]), bytes(row[1]))).persist(StorageLevel.MEMORY_AND_DISK)
    grown, older = [], None
    for i in range(trees):
        tree = _scaled(grow(rows, bundles, maxDepth, minInstancesPerNode), 2 * stepSize if i else 1.0)
        grown.append(tree.nested(places))
        if i + 1 < trees:
            walk, value = Walk(tree, bundles, maxDepth), np.array(tree.value)

            def after(chunk, walk=walk, value=value):
                codes, rest = _arrays(*chunk)
                return chunk[0], (rest - value.take(walk.nodes(codes))).tobytes()

            if older:  # the table before this one was made with the tree
                older.unpersist()
            older, rows = rows, rows.map(after).persist(StorageLevel.MEMORY_AND_DISK)
    for table in (older, rows):
        if table:
            table.unpersist()
    return flat(grown)
