"""Leaf-wise trees against a plain search over all rows."""

import numpy as np
import pandas as pd
import pytest

from tallycast.operators.models import forest, leafwise


def plain_tree(bins, rest, leaves, least):
    """Best first: the split of the greatest gain over all leaves, each tried at every feature and bin."""
    nodes, splits = {0: np.arange(len(rest))}, {}
    while len(nodes) < leaves:
        options = []
        for node, rows in nodes.items():
            for f in range(bins.shape[1]):
                for cut in range(bins[rows, f].max()):
                    low = bins[rows, f] <= cut
                    if min(low.sum(), (~low).sum()) >= least:
                        a, b, whole = rest[rows[low]], rest[rows[~low]], rest[rows]
                        gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - whole.sum() ** 2 / len(whole)
                        options.append((-round(gain, 9), f, cut, node))
        if not options or min(options)[0] >= 0:
            break
        _, f, cut, node = min(options)
        rows = nodes.pop(node)
        low = bins[rows, f] <= cut
        size = 1 + 2 * len(splits)
        splits[node] = (f, cut, size, size + 1)
        nodes |= {size: rows[low], size + 1: rows[~low]}
    found = np.empty(len(rest))
    for rows in nodes.values():
        found[rows] = leafwise.RATE * rest[rows].mean()
    return found, len(nodes)


def test_a_tree_is_that_of_a_plain_search(spark):
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (900, 3)).astype(np.uint8)
    rest = np.where(bins[:, 0] > 3, bins[:, 1] * 0.7, -bins[:, 2] * 0.4) + rng.normal(0, 0.3, 900)
    rows = spark.createDataFrame([(row.tobytes(), float(y)) for row, y in zip(bins, rest)], "bins binary, rest double").repartition(5)
    passes = []

    def measure(tree, nodes):
        passes.append(len(nodes))
        found = {node: np.zeros((2, 3, 8)) for node in nodes}
        for row in leafwise.histograms(rows, tree, nodes, 3, 8).collect():
            found[row["node"]][:, row["feature"], row["bin"]] = row["rest"], row["n"]
        return found

    tree = forest.flat([leafwise.grow(measure, leaves=12, least=20)])
    expected, leaves = plain_tree(bins, rest, 12, 20)
    assert leaves == 12 and (tree.left == np.arange(len(tree.left))).sum() == 12
    assert tree.predict(bins) == pytest.approx(expected)
    assert len(passes) < 12


def test_boosting_lowers_the_error_and_uses_real_thresholds(spark):
    rng = np.random.default_rng(2)
    table = pd.DataFrame(rng.normal(size=(600, 2)), columns=["a", "b"])
    table["label"] = (table["a"] > 0.2) * 2.0 + np.where(table["b"] > -0.5, 1.0, 0.0)
    trees = leafwise.boost(spark.createDataFrame(table).repartition(3), ["a", "b"], trees=12, leaves=4, bins=16)
    x, y = table[["a", "b"]].to_numpy(), table["label"].to_numpy()
    assert len(trees.roots) == 13
    error = y - trees.predict(x)
    assert (error ** 2).mean() < 0.15 * y.var()  # 0.9 ** 24 of it, and the bins' grain
    assert leafwise.boost(spark.createDataFrame(table.assign(label=5.0)), ["a", "b"], trees=1).predict(x) == pytest.approx(np.full(600, 5.0))
