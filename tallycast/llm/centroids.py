"""Centroid clustering of integer vectors: a vantage-point tree over the centroids, rebuilt and broadcast each round.

A vector's nearest centroid is found by best-first branch and bound: of the nodes reached so
far the one with the least bound is opened, its vantage point (or the centroids of its leaf) are
measured by exact integer distances, and the search ends when every bound left lies above the
best distance. Nodes whose bound equals it are still opened, as they may hold a smaller number at
the same distance; bounds are lowered by more than their rounding error, so no node is left out by
mistake. All vectors of an Arrow batch take their steps together, each along its own way.

Tasks hand on one row of sums per centroid; sums and counts are added up by Spark, and one row for
each centroid and component reaches the driver. Only the tree is broadcast, of a size that the
number of centroids sets. The vectors are read once and kept as integers.

Defined results: rows whose vector is null, has another length, or holds null or non-finite
components are left out; a component beyond +-2^27, whose squared distances might not fit into a
long, raises an error; repeated rows are vectors of their own, also as seeds, equal hashes being
ordered by components; rows with a null ``vec_id`` are assigned but are no seeds, and where no row
has an id there are no centroids and no rows; fewer vectors than seeds make fewer centroids; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm import common

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
LEAF = 4
LIMIT = 1 << 27
ROWS_AT_ONCE = 2048
SLACK = 1e-9  # of the lengths that a bound is made of; their rounding errors are below 1e-15


@dataclass(frozen=True)
class Node:
    """``points`` are numbers of centroids: the vantage point of an inner node, all centroids of a leaf.

    ``low`` and ``high`` hold, for each child, the least and greatest distance of its centroids from the vantage point.
    """

    points: tuple[int, ...]
    children: tuple[int, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()


class Tree:
    """Vantage-point tree over the rows of ``centroids`` (int64)."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids = centroids
        self.nodes: list[Node] = []
        self._grow(np.arange(len(centroids)), leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        place = len(self.nodes)
        if len(points) <= leaf:
            self.nodes.append(Node(tuple(points.tolist())))
            return place
        spread = [self.distances(self.centroids[points], point).astype(float).std() for point in points]
        vantage = points[int(np.argmax(spread))]
        rest = points[points != vantage]
        away = np.sqrt(self.distances(self.centroids[rest], vantage).astype(float))
        order = np.argsort(away, kind="stable")
        halves = [half for half in np.array_split(order, 2) if len(half)]
        self.nodes.append(Node((int(vantage),)))  # keeps the place of the root before its children
        children = tuple(self._grow(rest[half], leaf) for half in halves)
        self.nodes[place] = Node((int(vantage),), children, tuple(away[h].min() for h in halves), tuple(away[h].max() for h in halves))
        return place

    def distances(self, vectors: np.ndarray, point: int) -> np.ndarray:
        """Exact squared distances of the rows of ``vectors`` from one centroid."""
        apart = vectors - self.centroids[point]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row, the smaller number among equals, and how many distances that took."""
        count = len(vectors)
        number = np.zeros(count, np.int64)
        best = np.full(count, np.iinfo(np.int64).max)
        bound = np.full((count, len(self.nodes)), np.inf)  # of nodes reached and not opened yet
        bound[:, 0] = 0
        active, measured = np.arange(count), 0
        while len(active):
            chosen = bound[active].argmin(axis=1)
            least = bound[active, chosen]
            open_still = np.isfinite(least) & (least <= np.sqrt(best[active].astype(float)) * (1 + SLACK))
            active, chosen, least = active[open_still], chosen[open_still], least[open_still]
            for place in np.unique(chosen).tolist():
                rows, node = active[chosen == place], self.nodes[place]
                above = least[chosen == place]
                for point in node.points:
                    squared = self.distances(vectors[rows], point)
                    measured += len(rows)
                    better = (squared < best[rows]) | ((squared == best[rows]) & (point < number[rows]))
                    number[rows[better]] = point
                    best[rows[better]] = squared[better]
                if node.children:
                    length = np.sqrt(squared.astype(float))
                    for child, low, high in zip(node.children, node.low, node.high):
                        apart = np.maximum(low - length, length - high) - SLACK * (length + high)
                        bound[rows, child] = np.maximum(above, apart)
                bound[rows, place] = np.inf
        return number, best, measured


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions).astype(np.int64)


def _sums(tree: Broadcast, dimensions: int):
    """One row of sums per centroid and task."""
    def work(batches):
        centroids = tree.value.centroids
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                vectors = _matrix(common.columns(batch.slice(at, ROWS_AT_ONCE), "vec")[0], dimensions)
                number = tree.value.nearest(vectors)[0]
                np.add.at(sums, number, vectors)
                counts += np.bincount(number, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    return work


def _assigned(tree: Broadcast, dimensions: int):
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                ids, vectors = common.columns(batch.slice(at, ROWS_AT_ONCE), "vec_id", "vec")
                number, best, _ = tree.value.nearest(_matrix(vectors, dimensions))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])
    return work


def _usable(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the usable rows, components as floor(scale * x)."""
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("_steps", lambda x: F.abs(x) <= LIMIT)
    whole = F.when(fits, F.col("_steps").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is beyond the range of exact distances")))
    usable = vectors.filter(_usable(F.col("embedding"), dimensions))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), steps.alias("_steps")).select("vec_id", whole.alias("vec"))


def seeds(points: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids: a bounded number of rows for the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.filter("vec_id IS NOT NULL").select(name.alias("_hash"), "vec").orderBy("_hash", "vec").limit(count).collect()
    return np.array([row["vec"] for row in rows], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the mean of its vectors."""
    dimensions = centroids.shape[1]
    tree = points.sparkSession.sparkContext.broadcast(Tree(centroids))
    sums = common.map_batches(points.select("vec"), _sums(tree, dimensions), "cluster int, n long, sums array<long>")
    totals = (
        sums.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place").agg(F.sum("part").alias("total"), F.sum("n").alias("n")).collect()  # centroids x components
    )
    tree.destroy()
    following = centroids.copy()
    for row in totals:
        following[row["cluster"], row["place"]] = row["total"] // row["n"]
    return following


def cluster(
    vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) for every usable row, final centroids).

    The first table stays in the shared folder for as long as the caller needs it (``common.release``).
    """
    points = common.keep(integer_vectors(vectors, dimensions, scale))
    centroids = seeds(points, count, seed).reshape(-1, dimensions)
    if not len(centroids):
        return points.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)
    tree = points.sparkSession.sparkContext.broadcast(Tree(centroids))
    assigned = common.keep(common.map_batches(points, _assigned(tree, dimensions), "vec_id long, cluster int, distance long"))
    tree.destroy()
    common.release(points)
    return assigned, centroids


def digest(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``cluster`` with the inertia of their cluster and of all, and the hash of their centroid."""
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    inertia = {row["cluster"]: row["cluster_inertia"] for row in per_cluster}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(number, value, sum(inertia.values()), names[number]) for number, value in inertia.items()]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
