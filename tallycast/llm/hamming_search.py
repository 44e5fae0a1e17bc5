"""Exact top-k by Hamming distance: incremental multi-index hashing of 64-bit codes.

A code is cut into m segments, and every row is listed under each of its segments; m is chosen
for the number of rows, by the lookups and comparisons that codes without structure would need. A row at distance d from a query agrees with it in some segment up to d / m bits,
so once all segment values within r bits of the query's have been looked up, every row with
distance below m * (r + 1) has been seen. The radius r grows by one per round, for the queries
only whose k-th best verified distance is not below that yet; each round looks up just the
values at exactly r bits.

Queries and rows meet in Spark by segment value. Lists and lookups of one value are cut by hash
into parts, so no task holds a whole list. Each task hands on the best k per query of all it
compared, and none beyond the k-th best of earlier rounds; pairs are not handed on. Of rows with equal codes the k + 1 smallest ids are enough.

Ties are broken by id, so the result is the same for any plan. Defined results: rows without a
code or id are neither found nor search; a query does not find rows with its own id; repeated
rows count once; a table of fewer than k others gives all of them; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm import common
from tallycast.llm.simhash import BITS_SET

K = 10
BITS = 64
LOOKUP_COST = 100  # a row through a shuffle, in comparisons of two codes
LIST_ROWS = 4096
PAIRS_AT_ONCE = 200_000
GROUP = ("_segment", "_value", "_i", "_j")


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 components: bit i is set if component i is above zero; null for null vectors.

    A longer vector is an error, as its code would leave components out.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    too_long = F.raise_error(F.lit(f"a code has {BITS} bits, a vector has more components")).cast("array<double>")
    checked = F.when(F.size(vector) > BITS, too_long).otherwise(vector.cast("array<double>"))
    terms = F.transform(checked, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    return F.aggregate(terms, none, lambda code, bit: code.bitwiseOR(bit))


def segments(rows: int, k: int = K) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment for a table of so many rows.

    The cost is estimated for random codes, where the k-th nearest row is at the distance below
    which lies a share k / rows of all codes. Any number of segments gives exact results.
    """
    within = np.cumsum([comb(BITS, d) / 2.0 ** BITS for d in range(BITS + 1)])
    kth = int(np.searchsorted(within, min(1.0, k / max(1, rows)))) + 1
    costs = {}
    for count in range(1, 17):
        bits = BITS / count
        lookups = count * sum(bits ** r / factorial(r) for r in range(kth // count + 1))
        costs[count] = lookups * (LOOKUP_COST + rows / 2.0 ** bits)
    count = min(costs, key=costs.get)
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _flips(first: int, bits: int, radius: int) -> Column:
    """Codes that differ from 0 in exactly ``radius`` bits of a segment, as an array of longs."""
    found = [sum(1 << first + i for i in places) for places in combinations(range(bits), radius)]
    listed = ",".join(map(str, np.array(found, np.uint64).astype(np.int64)))
    return F.split(F.lit(listed), ",").cast("array<bigint>") if found else F.array().cast("array<bigint>")


def _segment_masks(parts: list[tuple[int, int]]) -> Column:
    values = [int(np.uint64(((1 << bits) - 1) << first).astype(np.int64)) for first, bits in parts]
    return F.array(*[F.lit(v).cast("long") for v in values])


def _compared(k: int):
    """Best k rows per query, of all lists in a task."""
    def work(batches):
        best, kept = [], 0
        for rows, starts in common.whole_runs(batches, GROUP):
            asks, id_, code, bound = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "id", "code", "bound"))
            number = np.cumsum(np.bincount(starts, minlength=len(id_))) - 1
            listed = np.bincount(number, ~asks, len(starts)).astype(np.int64)  # rows come before queries
            query = np.flatnonzero(asks & (listed[number] > 0))
            count = listed[number[query]]
            upto = np.cumsum(count)
            at = 0
            while at < len(query):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
                q = np.repeat(query[at:end], count[at:end])
                row = starts[number[q]] + np.arange(len(q)) - np.repeat(upto[at:end] - count[at:end] - (upto[at - 1] if at else 0), count[at:end])
                distance = BITS_SET[(code[q] ^ code[row]).view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
                near = (id_[q] != id_[row]) & (distance <= bound[q])
                best.append(np.column_stack([id_[q], distance, id_[row]])[near])
                kept += len(best[-1])
                if kept > 4 * PAIRS_AT_ONCE:
                    best = [_top(np.concatenate(best), k)]
                    kept = len(best[0])
                    if kept > 2 * PAIRS_AT_ONCE:  # of so many queries that they are handed on
                        yield _found(best.pop())
                        kept = 0
                at = end
        if best:
            yield _found(_top(np.concatenate(best), k))

    return work


def _top(found: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each query, each row once."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]).any(axis=1)
    found = found[fresh]
    first = np.ones(len(found), bool)
    first[1:] = found[1:, 0] != found[:-1, 0]
    rank = np.arange(len(found)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return found[rank < k]


def _found(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["query_id", "distance", "id"])


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query over all tasks."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    distinct = parts.groupBy("query_id", "distance", "id").agg(F.lit(1).alias("_one")).drop("_one")
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _look_up(asked: DataFrame, listed: DataFrame, sizes: DataFrame, k: int, list_rows: int) -> DataFrame:
    """Compare the lookups ``asked`` with the rows ``listed`` under the same segment value."""
    value = ["_segment", "_value"]
    asked = asked.join(sizes, value)
    askers = asked.groupBy(*value).agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("_askers"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_queries = asked.join(askers, value).withColumn("_j", F.pmod(F.xxhash64("id"), F.col("_askers")).cast("int"))
    of_queries = of_queries.select(*value, every("_lists").alias("_i"), "_j", F.lit(True).alias("asks"), "id", "code", "bound")
    of_rows = listed.join(askers, value).select(
        *value, "_i", every("_askers").alias("_j"), F.lit(False).alias("asks"), "id", "code", F.lit(0).cast("long").alias("bound"))
    met = of_rows.unionByName(of_queries).repartition(*GROUP).sortWithinPartitions(*GROUP, "asks")
    return common.map_batches(met, _compared(k), "query_id long, distance long, id long")


def search(rows: DataFrame, queries: DataFrame, k: int = K, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of ``rows`` (id, code) to each of ``queries`` (id, code)."""
    known = common.keep(rows.filter("id is not null and code is not null").select("id", "code").distinct())
    waiting = common.keep(queries.filter("id is not null and code is not null").select("id", "code", F.lit(BITS).cast("long").alias("bound")).distinct())
    parts = segments(known.count(), k)
    by_code = Window.partitionBy("code").orderBy("id")
    enough = known.withColumn("_n", F.row_number().over(by_code)).filter(F.col("_n") <= k + 1)
    masks = _segment_masks(parts)
    listed = common.keep(enough.select("id", "code", F.posexplode(masks).alias("_segment", "_mask")).select(
        "_segment", F.col("code").bitwiseAND(F.col("_mask")).alias("_value"), "id", "code"))
    sizes = common.keep(listed.groupBy("_segment", "_value").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("_lists")))
    listed = listed.join(sizes, ["_segment", "_value"]).select(
        "_segment", "_value", F.pmod(F.xxhash64("id"), F.col("_lists")).cast("int").alias("_i"), "id", "code")

    best = None
    for radius in range(max(bits for _, bits in parts) + 1):
        flips = F.array(*[_flips(first, bits, radius) for first, bits in parts])
        asked = waiting.select("id", "code", "bound", F.posexplode(flips).alias("_segment", "_flips")).select(
            "_segment", "id", "code", "bound", F.explode("_flips").alias("_flip"))
        own = F.element_at(masks, F.col("_segment") + 1).bitwiseAND(F.col("code"))
        asked = asked.select("_segment", own.bitwiseXOR(F.col("_flip")).alias("_value"), "id", "code", "bound")
        found = _look_up(asked, listed, sizes, k, list_rows)
        merged = common.keep(_merged(found if best is None else found.unionByName(best.drop("rank")), k))
        if best is not None:
            common.release(best)
        best = merged
        last = best.groupBy("query_id").agg(F.max("distance").alias("_last"), F.count(F.lit(1)).alias("_n"))
        seen = len(parts) * (radius + 1)  # all rows nearer than this have been compared
        state = waiting.join(last.withColumnRenamed("query_id", "id"), "id", "left")
        full = F.coalesce(F.col("_n") >= k, F.lit(False))
        further = common.keep(state.filter(~(full & (F.col("_last") < seen))).select(
            "id", "code", F.when(full, F.col("_last")).otherwise(F.col("bound")).alias("bound")))  # no more than the k-th best so far
        common.release(waiting)
        waiting = further
        if waiting.isEmpty():
            break
    return best.select("query_id", "rank", "id", "distance")
