"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed where the texts are, in one pass over each text. The trees are
grown on the driver from the statistics of about ``learn_docs`` labelled documents at most, drawn
by a hash of the id, one row for each id: each statistic is cut into at most ``BINS`` bins once, and every level of a
tree is found from gradient histograms over (node, statistic, bin). Trees are complete and
flattened into arrays (statistic, cut, leaf value), which numpy walks level by level for all
documents of a batch together.

Defined results: null texts count as empty and get a score; labels are one per document, the
lower where they differ, null ones ignored; of texts that share an id the one with the smallest
hash is learned from; documents without id are not learned from; with no
label to learn from every score is 1, with labels of one kind the smoothed share of ones;
repeated rows are scored alike; an empty table gives no rows; other columns are passed through
by ``with_scores``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm import common

LEARN_DOCS = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.2
RIDGE = 1.0
LEAST_ROWS = 5.0  # in units of curvature a quarter each: a leaf stands for about so many documents
ACCEPT = 0.7

FEATURES = (
    "chars", "words", "lines", "word_length", "line_length", "longest_word", "upper", "digits", "blanks", "stops", "marks",
    "shouts", "bars", "symbols", "outside_ascii", "capital_words", "marked_words", "distinct_words", "top_word", "distinct_lines",
    "repeated_line_chars", "compressed", "words_per_stop", "shouted_words", "distinct_pairs",
)
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blanks": b" \t\r\n\x0b\x0c", "stops": b".?",
         "marks": b",;:'\"-()", "shouts": b"!", "bars": b"|", "symbols": b"#$%&*+/<=>@[\\]^_`{}~"}


def _kind_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for number, members in enumerate(KINDS.values(), 1):
        table[list(members)] = number
    table[128:] = len(KINDS) + 1
    return table


KIND_OF = _kind_table()


def statistics(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one UTF-8 text."""
    size = max(1, len(text))
    shares = np.bincount(KIND_OF[np.frombuffer(text, np.uint8)], minlength=len(KINDS) + 2)[1:] / size
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    counts, line_counts = Counter(words), Counter(lines)
    capital = sum(count for word, count in counts.items() if word[:1].isupper())
    shouted = sum(count for word, count in counts.items() if len(word) > 1 and word.isupper())
    marked = sum(count for word, count in counts.items() if not word[-1:].isalnum() and word[-1] < 128)
    repeated = sum(len(line) * (count - 1) for line, count in line_counts.items())
    stops = shares[3] * size
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n_words,
        np.log1p(len(text) / n_lines), float(max(map(len, counts), default=0)), *shares[:8], shares[8],
        capital / n_words, marked / n_words, len(counts) / n_words, max(counts.values(), default=0) / n_words,
        len(line_counts) / n_lines, repeated / size, len(zlib.compress(text, 1)) / size, n_words / (1 + stops),
        shouted / n_words, len(set(zip(words, words[1:]))) / n_words,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = [statistics(value) for value in common.texts(column)]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


# --- trees ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth; row t of the arrays is tree t, its nodes level by level."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosted trees for the logistic loss of labels ``y`` (0 or 1)."""
    nothing = np.zeros((0, 2 ** depth - 1), np.int64)
    if len(y) == 0:
        return Forest(np.inf, nothing, nothing.astype(float), np.zeros((0, 2 ** depth)))
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Forest(start, nothing, nothing.astype(float), np.zeros((0, 2 ** depth)))
    quantiles = [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T]
    binned = np.column_stack([np.searchsorted(cuts, column, side="left") for cuts, column in zip(quantiles, x.T)])
    width = binned.shape[1]
    cell = binned + bins * np.arange(width)  # place in a node's histogram
    margin = np.full(len(y), start)
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        feature, cut = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2 ** level - 1, 2 ** level
            place = ((node - first)[:, None] * (width * bins) + cell).ravel()
            shape = (nodes, width, bins)
            slopes = np.bincount(place, np.repeat(slope, width), nodes * width * bins).reshape(shape)
            curves = np.bincount(place, np.repeat(curve, width), nodes * width * bins).reshape(shape)
            left, left_curve = slopes.cumsum(2), curves.cumsum(2)
            whole, whole_curve = left[:, :1, -1:], left_curve[:, :1, -1:]
            right, right_curve = whole - left, whole_curve - left_curve
            gain = left ** 2 / (left_curve + RIDGE) + right ** 2 / (right_curve + RIDGE) - whole ** 2 / (whole_curve + RIDGE)
            gain[(left_curve < LEAST_ROWS / 4) | (right_curve < LEAST_ROWS / 4)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for i, spot in enumerate(best):
                f, b = divmod(int(spot), bins)
                if gain[i, f, b] > 1e-9 and b < len(quantiles[f]):
                    feature[first + i], cut[first + i] = f, quantiles[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        node -= 2 ** depth - 1
        leaf = rate * np.bincount(node, slope, 2 ** depth) / (np.bincount(node, curve, 2 ** depth) + RIDGE)
        margin += leaf[node]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(leaf)
    return Forest(start, np.array(all_features), np.array(all_cuts), np.array(all_leaves))


# --- on tables --------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows by a hash of ``doc_id``, all if there are no more."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(bound / total * (1 << 20)))


def learn(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS) -> Forest:
    """Trees from the labelled documents that are not held out."""
    rows = learned_rows(docs, labels, learn_docs).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return grow(x, rows["label"].to_numpy(np.float64))


def learned_rows(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS) -> DataFrame:
    """(doc_id, label, x) to learn from, one row for each id drawn; what shares an id is reduced in Spark, first in its task."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("_label"))
    sample = drawn(known, learn_docs)
    chosen = docs.select("doc_id", "text").withColumn("_order", F.xxhash64("text"))
    chosen = chosen.join(F.broadcast(sample), "doc_id")  # learn_docs rows of two numbers

    def work(batches):
        for batch in batches:
            ids, text, label, order = common.columns(batch, "doc_id", "text", "_label", "_order")
            values = pa.FixedSizeListArray.from_arrays(pa.array(_matrix(text).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), label, values, order], ["doc_id", "label", "x", "order"])

    rows = common.map_batches(chosen, work, "doc_id long, label double, x array<double>, order long")
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("x", "order").alias("x"))


def with_scores(docs: DataFrame, forest: Forest, column: str = "score") -> DataFrame:
    """``docs`` with the score of each row's ``text`` in ``column``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def work(batches):
        for batch in batches:
            scores = forest.scores(_matrix(*common.columns(batch, "text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, column])

    return common.map_batches(docs, work, schema)


def classify(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    scored = with_scores(docs, learn(docs, labels, learn_docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``accept``; same columns."""
    whole = F.struct(*[f"`{name}`" for name in docs.columns]).alias("_doc")
    scored = with_scores(docs.select(whole, "text"), learn(docs, labels, learn_docs), "_score")
    return scored.filter(F.col("_score") >= accept).select("_doc.*")
