"""Leaf-wise gradient boosting on histograms that Spark adds up.

A tree grows best first: of all leaves the one whose split lowers the squared error most is split next, up to
``LEAVES`` leaves. Rows hold the bin of each feature. A pass sums residuals and counts by (leaf, feature, bin) in the
tasks and then over them; of two children only one is measured, the other is the parent less its sibling. All leaves
that may be split next are measured in one pass, so a tree takes about as many passes as it is deep, and splits
are still taken strictly in order of their gain. Only histograms, of a size that leaves, features and bins set, reach
the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.scale import kept
from tallycast.operators.models.forest import Forest, flat

LEAVES = 31
BINS = 64
RATE = 0.1
LEAST_ROWS = 20
REFRESH = 10  # trees after which the rows take up what has been predicted so far


def bin_edges(rows: DataFrame, names: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last, at about equal counts."""
    shares = [i / bins for i in range(1, bins)]
    return [np.unique(found) for found in rows.approxQuantile(list(names), shares, 0.1 / bins)]


def binned(rows: DataFrame, names: Sequence[str], edges: Sequence[np.ndarray]) -> DataFrame:
    """(bins, rest): a byte per feature, and the label, of which nothing is predicted yet."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.empty((batch.num_rows, len(names)), np.uint8)
            for i, ends in enumerate(edges):
                table[:, i] = np.searchsorted(ends, batch.column(i).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in table], pa.binary()), batch.column(len(names))], ["bins", "rest"])

    return rows.select(*names, F.col("label").cast("double")).mapInArrow(work, "bins binary, rest double")


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width), batch.column(1).to_numpy()


def after(rows: DataFrame, trees: Forest, width: int) -> DataFrame:
    """``rows`` with what ``trees`` (over bins) predict taken off their rest."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, rest = _unpacked(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest - trees.predict(bins))], ["bins", "rest"])

    return rows.mapInArrow(work, "bins binary, rest double")


@dataclass
class Growing:
    """A tree over bins: ``splits`` maps a node to (feature, bin, low child, high child); others are leaves."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    size: int = 1

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        low, high = self.size, self.size + 1
        self.splits[node] = (feature, cut, low, high)
        self.size += 2
        return low, high

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for at in sorted(self.splits):  # children are numbered after their parent
            feature, cut, low, high = self.splits[at]
            here = np.flatnonzero(node == at)
            node[here] = np.where(bins[here, feature] <= cut, low, high)
        return node


def histograms(rows: DataFrame, tree: Growing, wanted: Sequence[int], width: int, bins: int = BINS, recent: Forest | None = None) -> DataFrame:
    """(node, feature, bin, rest, n) of the wanted leaves: residual sums and counts, combined in the tasks first."""
    slots = np.full(tree.size, -1)
    slots[list(wanted)] = np.arange(len(wanted))
    cells = width * bins

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(len(wanted) * cells), np.zeros(len(wanted) * cells, np.int64)
        for batch in batches:
            table, rest = _unpacked(batch, width)
            slot = slots[tree.leaf_of(table)]
            table, rest, slot = table[slot >= 0], rest[slot >= 0], slot[slot >= 0]
            if recent is not None and len(rest):
                rest = rest - recent.predict(table)
            for i in range(width):
                cell = slot * cells + i * bins + table[:, i]
                sums += np.bincount(cell, rest, len(sums))
                counts += np.bincount(cell, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.array(wanted, np.int32)[used // cells]), pa.array((used % cells // bins).astype(np.int32)),
            pa.array((used % bins).astype(np.int32)), pa.array(sums[used]), pa.array(counts[used])], ["node", "feature", "bin", "rest", "n"])

    parts = rows.mapInArrow(work, "node int, feature int, bin int, rest double, n long")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("rest").alias("rest"), F.sum("n").alias("n"))


def best_split(found: np.ndarray, least: int = LEAST_ROWS) -> tuple[float, int, int]:
    """(gain, feature, bin) of a leaf from its (2, features, bins) sums and counts; the first of equal ones."""
    low = found.cumsum(axis=2)
    high = low[:, :, -1:] - low
    (rest_low, n_low), (rest_high, n_high) = low, high
    whole = low[0, 0, -1] ** 2 / max(low[1, 0, -1], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = rest_low ** 2 / n_low + rest_high ** 2 / n_high - whole
    gain[(n_low < least) | (n_high < least)] = -np.inf
    place = int(np.argmax(gain))
    return float(gain.flat[place]), *divmod(place, found.shape[2])


def grow(measure, leaves: int = LEAVES, least: int = LEAST_ROWS):
    """Nested tree over bins, best leaf first. ``measure(tree, nodes)`` gives the histograms of leaves."""
    tree = Growing()
    known = measure(tree, [0])
    best = {0: best_split(known[0], least)}
    waiting, taken = [(-best[0][0], 0)], set()
    while waiting and len(taken) < leaves - 1:
        gain, node = heapq.heappop(waiting)
        if gain >= -1e-12:
            break
        if node not in tree.splits:  # measure the children of all leaves that may come next
            ahead = sorted([(gain, node), *waiting])[:leaves - 1 - len(taken)]
            chosen = [n for g, n in ahead if g < -1e-12 and n not in tree.splits]
            pairs = {n: tree.split(n, *best[n][1:]) for n in chosen}
            measured = measure(tree, [low for low, _ in pairs.values()])
            for parent, (low, high) in pairs.items():
                known[low], known[high] = measured[low], known[parent] - measured[low]
                best |= {child: best_split(known[child], least) for child in (low, high)}
        taken.add(node)
        for child in tree.splits[node][2:]:
            heapq.heappush(waiting, (-best[child][0], child))

    def nested(node: int):
        if node in taken:
            feature, cut, low, high = tree.splits[node]
            return feature, cut, nested(low), nested(high)
        rest, n = known[node][:, 0].sum(axis=1)
        return RATE * rest / max(n, 1)

    return nested(0)


def _at_edges(tree, edges: Sequence[np.ndarray]):
    if not isinstance(tree, tuple):
        return tree
    feature, cut, low, high = tree
    return feature, edges[feature][cut], _at_edges(low, edges), _at_edges(high, edges)


def boost(training: DataFrame, names: Sequence[str], trees: int = 100, leaves: int = LEAVES, bins: int = BINS) -> Forest:
    """A forest over the features ``names`` of ``training`` (with ``label``); the first tree is the mean."""
    width, edges = len(names), bin_edges(training, names, bins)
    mean = training.agg(F.avg("label")).first()[0] or 0.0
    rows = kept(after(binned(training, names, edges), flat([mean]), width))
    grown, recent = [], []
    for _ in range(trees):
        so_far = flat(recent) if recent else None

        def measure(tree: Growing, nodes: list[int]) -> dict[int, np.ndarray]:
            found = {node: np.zeros((2, width, bins)) for node in nodes}
            for row in histograms(rows, tree, nodes, width, bins, so_far).collect():  # leaves x features x bins
                found[row["node"]][:, row["feature"], row["bin"]] = row["rest"], row["n"]
            return found

        recent.append(grow(measure, leaves))
        grown.append(recent[-1])
        if len(recent) == REFRESH:
            rows, recent = kept(after(rows, flat(recent), width)), []
    return flat([mean, *[_at_edges(tree, edges) for tree in grown]])
