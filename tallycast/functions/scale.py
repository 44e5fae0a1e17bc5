"""Skew-safe building blocks: segments of long items, distributed ranks, exact quantiles.

A window partitioned by item puts a whole item into one task. Here rows are partitioned by
(item, segment): items above ``SkewConfig.hot_rows`` are cut into consecutive segments, all others
are one. Cuts come from a sample of the keys, drawn by hash, so one plan serves all items: the rows look up
their segment among the cuts, rows near a cut are copied to the neighbouring segment, and one
exchange and one sort follow. What a segment must know of the others comes from a summary of one row
per segment. Null items and null dates are kept and cut like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallycast.config import SKEW, SkewConfig

ORDER = ("date", "row_id")
SAMPLES = 256  # sampled rows from one cut to the next
FANOUT = 16  # entries of a node when the cuts of an item are searched
LEVELS = 4
ORDERED_ONE_OF = 4096  # at most one of so many rows of an item is ordered in one task


def kept(df: DataFrame) -> DataFrame:
    """Compute once a table of at most one row per item that a plan reads several times.

    Without this each use would scan the demand table again. Lost blocks are recomputed
    from the source; the caller may ``unpersist`` or clear the cache when done.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys, null equal to null. ``small`` marks a right side of bounded size."""
    others = [F.col(name) for name in right.columns if name not in keys]
    right = right.select(*[F.col(key).alias(f"_same_{key}") for key in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_same_{key}")) for key in keys])
    joined = left.join(F.broadcast(right) if small else right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_same_{key}" for key in keys])


def hot_items(df: DataFrame, key: str = "sku", skew: SkewConfig = SKEW) -> DataFrame:
    """Items with more than ``hot_rows`` rows: at most total rows / hot_rows of them."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > skew.hot_rows)
        .select(key)
    )


def both_ways(
    df: DataFrame, build: Callable[[DataFrame, bool], DataFrame], skew: SkewConfig = SKEW, split: bool | None = None, key: str = "sku"
) -> DataFrame:
    """``build(rows, False)`` for items of ordinary size and ``build(rows, True)`` for hot ones, in one plan.

    ``split`` forces one way for all items.
    """
    if split is not None:
        return build(df, split)
    hot = hot_items(df, key, skew)
    usual = build(join_same(df, hot, [key], "left_anti", small=True), False)
    return usual.unionByName(build(join_same(df, hot, [key], "left_semi", small=True), True))


@dataclass(frozen=True)
class Ordered:
    """Rows of each item in order, in segments when ``split`` is set.

    The split form carries ``_seg`` (segment number, 0 for items in one piece), ``_own`` (false for rows
    copied from a neighbour) and, where a summary was asked, ``_passed`` (null for items in one piece).
    """

    df: DataFrame
    key: str
    order: tuple[str, ...]
    split: bool

    @property
    def keys(self) -> list[str]:
        return [self.key, "_seg"] if self.split else [self.key]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def passed(self, name: str) -> Column:
        """What the other segments pass on; null for items in one piece."""
        return F.col("_passed")[name] if self.split else F.lit(None)

    def of_item(self, whole: Column, passed: Column) -> Column:
        """A statistic of the item: ``whole`` over its rows if they are in one piece, else ``passed``."""
        value = whole.over(Window.partitionBy(*self.keys))
        return F.when(F.col("_passed").isNotNull(), passed).otherwise(value) if self.split else value

    def row_index(self) -> Column:
        """Zero-based position of the row in its item; needs ``_ahead`` among what is passed."""
        if not self.split:
            return F.row_number().over(self.window()) - 1
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(F.col("_own").cast("int")).over(upto) - 1 + F.coalesce(self.passed("_ahead"), F.lit(0))

    def with_columns(self, made: dict[str, Column]) -> "Ordered":
        return Ordered(self.df.withColumns(made), self.key, self.order, self.split) if made else self

    def own_rows(self) -> DataFrame:
        return self.df.filter("_own").drop("_seg", "_own", "_passed") if self.split else self.df


def earlier(name: str, key: str = "sku") -> Column:
    """For a summary: the nearest known ``name`` of the segments before."""
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(name, ignorenulls=True).over(before)


def later(name: str, key: str = "sku") -> Column:
    """For a summary: the nearest known ``name`` of the segments after, by a frame that only grows."""
    after = Window.partitionBy(key).orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(name, ignorenulls=True).over(after)


def running(name: str, key: str = "sku") -> Column:
    """For a summary: the sum of ``name`` over the segments before."""
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(before), F.lit(0))


def altogether(agg: Column, key: str = "sku") -> Column:
    """For a summary: an aggregate over all segments of the item."""
    return agg.over(Window.partitionBy(key))


@dataclass(frozen=True)
class Cuts:
    """Where items above about ``hot_rows`` rows are cut: (key, n, at, from, until), kept as several joins read it.

    A hash draws one of ``hot_rows / SAMPLES`` rows, and every ``SAMPLES``-th row drawn from an item begins a
    segment, so segments hold ``hot_rows`` rows give or take a few percent. ``from`` and ``until`` bound the rows
    that are copied across a cut: as many drawn rows as the frames reach, so at least that many rows, and
    never more than one segment. There are at most rows / ``hot_rows`` cuts, from a share of ``SAMPLES / hot_rows``
    of the keys.
    """

    table: DataFrame
    key: str

    def items(self) -> DataFrame:
        return self.table.select(self.key).distinct()

    def with_segment(self, df: DataFrame, here: Column) -> DataFrame:
        """Add ``_seg``, the number of the item's cuts at or before ``here``.

        The cuts form a search tree of ``LEVELS`` levels that is joined level by level, so that
        no row carries more than a node of it.
        """
        df = df.withColumn("_seg", F.lit(0))
        for level in reversed(range(LEVELS)):
            step = FANOUT ** level
            entries = self.table.filter(F.col("n") % step == 0)
            if level < LEVELS - 1:
                node = F.floor(F.col("n") / (step * FANOUT)).cast("int")
                entries = entries.filter(F.col("n") % (step * FANOUT) != 0)
            else:
                node = F.lit(0)
            nodes = entries.groupBy(self.key, node.alias("_seg")).agg(F.collect_list("at").alias("_node"))  # FANOUT places
            passed = F.when(F.col("_node").isNotNull(), F.size(F.filter("_node", lambda at: at <= here))).otherwise(0)
            looked_up = join_same(df.withColumnRenamed("_seg", "_at"), nodes.withColumnRenamed("_seg", "_at"), [self.key, "_at"], "left", small=True)
            df = looked_up.withColumn("_seg", F.col("_at") * FANOUT + passed).drop("_at", "_node")
        return df

    def with_copies(self, df: DataFrame, here: Column, before: int, after: int) -> DataFrame:
        """Add ``_own``, and rows near a cut once more in the neighbouring segment."""
        if not (before or after):
            return df.withColumn("_own", F.lit(True))
        sides = F.array(
            F.struct(F.col("n").alias("_seg"), F.lit(None).alias("_next"), F.struct("until").alias("_this")),
            F.struct((F.col("n") - 1).alias("_seg"), F.struct("from").alias("_next"), F.lit(None).alias("_this")))
        edges = self.table.select(self.key, F.inline(sides)).groupBy(self.key, "_seg").agg(
            F.max("_next").alias("_next"), F.max("_this").alias("_this"))
        looked_up = join_same(df, edges, [self.key, "_seg"], "left", small=True)
        own = F.struct("_seg", F.lit(True).alias("_own"))
        copy = lambda test, step: F.when(test, F.struct((F.col("_seg") + step).alias("_seg"), F.lit(False).alias("_own")))
        near = [own]
        if before:
            near.append(copy(F.col("_next").isNotNull() & F.coalesce(here >= F.col("_next")["from"], F.lit(True)), 1))
        if after:
            near.append(copy(F.col("_this").isNotNull() & F.coalesce(here < F.col("_this")["until"], F.lit(True)), -1))
        return looked_up.select(*[c for c in df.columns if c != "_seg"], F.inline(F.array_compact(F.array(*near))))


def find_cuts(df: DataFrame, key: str, order: Sequence[str], before: int, after: int, skew: SkewConfig) -> Cuts:
    """Cuts at every so many drawn rows of an item.

    Where a large share of the rows is drawn (a small ``hot_rows``), these are ordered in coarse segments, cut
    by a thinner sample of their own, and numbered by a sum over the segments, so that no task orders an item.
    """
    one_of = max(1, skew.hot_rows // SAMPLES)
    between = max(-(-skew.hot_rows // one_of), before, after, 1)
    here = F.struct(*order)
    drawn = df.filter(F.pmod(F.xxhash64(key, *order), F.lit(one_of)) == 0).select(key, *order)
    if one_of < ORDERED_ONE_OF:
        coarse = find_cuts(drawn, key, order, 0, 0, SkewConfig(hot_rows=ORDERED_ONE_OF * SAMPLES))
        placed = coarse.with_segment(drawn, here).select(key, "_seg", here.alias("at"))
        sizes = placed.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_n"))
        ahead = sizes.select(key, "_seg", running("_n", key).alias("_ahead"))
        place = Window.partitionBy(key, "_seg").orderBy("at")
        numbered = join_same(placed.withColumn("n", F.row_number().over(place)), ahead, [key, "_seg"], small=True)
        numbered = numbered.withColumn("n", (F.col("n") + F.col("_ahead")).cast("int"))
    else:
        place = Window.partitionBy(key).orderBy("at")
        numbered = drawn.select(key, here.alias("at")).withColumn("n", F.row_number().over(place))
    # a cut is the drawn row of its number; copies reach as many drawn rows back and ahead as the frames
    marks = numbered.select(key, "at", F.inline(F.array(*[
        F.struct((F.col("n") + shift).alias("n"), F.lit(side).alias("_side")) for side, shift in (("at", 0), ("from", before), ("until", -after))
    ]))).filter((F.col("n") % between == 0) & (F.col("n") > 0))
    cuts = marks.groupBy(key, "n").agg(*[
        F.max(F.when(F.col("_side") == side, F.col("at"))).alias(side) for side in ("at", "from", "until")
    ]).filter(F.col("at").isNotNull())
    return Cuts(kept(cuts.withColumn("n", F.floor(F.col("n") / between).cast("int"))), key)


def ordered_rows(
    df: DataFrame,
    key: str = "sku",
    order: Sequence[str] = ORDER,
    before: int = 0,
    after: int = 0,
    skew: SkewConfig = SKEW,
    split: bool | None = None,
    parts: dict[str, Column] | None = None,
    passed: Sequence[dict[str, Column]] = (),
    numbered: bool = False,
    beside: DataFrame | None = None,
) -> Ordered:
    """Prepare ``df`` for row frames that reach ``before`` rows back and ``after`` ahead.

    ``order`` is (date, unique long id). ``parts`` are aggregates of a segment, from which ``passed`` makes what
    the others need to know (``earlier``, ``later``, ``running``, ``altogether``), step by step; with ``numbered``
    the aggregates may use ``_i``, the place of a row in its segment. Only rows of items that are cut are read for
    them. ``beside`` is a table of one row per item that is looked up before the rows are exchanged.
    ``split=False`` leaves every item in one piece.
    """
    order = tuple(order)
    if split is False:
        return Ordered(df if beside is None else df.join(beside, key, "left"), key, order, False)

    here = F.struct(*order)
    cuts = find_cuts(df, key, order, before, after, skew)
    placed = cuts.with_copies(cuts.with_segment(df, here), here, before, after)
    if parts:
        hot = cuts.with_segment(join_same(df, cuts.items(), [key], "left_semi", small=True), here)
        if numbered:
            in_segment = Window.partitionBy(key, "_seg").orderBy(*order)
            hot = hot.repartition(key, "_seg").withColumn("_i", F.row_number().over(in_segment) - 1)
        table = hot.groupBy(key, "_seg").agg(*[agg.alias(name) for name, agg in parts.items()])
        for step in passed:
            table = table.withColumns(step)
        names = [name for step in passed for name in step]
        placed = join_same(placed, table.select(key, "_seg", F.struct(*names).alias("_passed")), [key, "_seg"], "left", small=True)
    if beside is not None:
        placed = placed.join(beside, key, "left")
    return Ordered(placed.repartition(key, "_seg"), key, order, True)


def ranked(items: DataFrame, value: str, key: str = "sku", weight: str | None = None, buckets: int = 128, slots: int = 1024) -> DataFrame:
    """Add ``rank`` (1 = largest value) and ``running`` (sum of value up to the row).

    With ``weight`` a row stands for that many items and ``rank`` is its last item's.
    ``items`` is read more than once, so hand in a ``kept`` table.

    No task orders all items. Values are cut at approximate quantiles and each bucket between
    two cuts into equal slots; values equal to a cut have a bucket of their own, cut by
    md5(key), which is also the order among ties. Prefix sums over the cells add up. Exact
    whatever the cuts are. Null values come last.
    """
    one = F.col(weight) if weight else F.lit(1)
    steps = ", ".join(f"{i / buckets!r}D" for i in range(buckets + 1))
    cuts = items.agg(F.expr(f"array_distinct(percentile_approx({value}, array({steps}), 10000))").alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    on_cut = F.coalesce(F.array_contains("_cuts", F.col(value)), F.lit(False))
    low, high = F.get("_cuts", F.col("_below") - 1), F.get("_cuts", F.col("_below"))
    slot = F.floor(F.try_divide(high - F.col(value), high - low) * slots)
    by_hash = F.conv(F.substring("_tie", 1, 3), 16, 10).cast("long")
    placed = (
        items.crossJoin(F.broadcast(cuts))  # one row
        .withColumns({"_tie": F.md5(F.col(key).cast("binary")), "_below": below, "_on_cut": on_cut})
        .withColumn("_bucket", F.when(F.col(value).isNull(), -1).otherwise(2 * F.col("_below") + F.col("_on_cut").cast("int")))
        .withColumn("_part", F.when(F.col("_on_cut") | F.col(value).isNull(), by_hash).otherwise(F.coalesce(slot, F.lit(0))))
        .drop("_cuts", "_below", "_on_cut")
    )
    # at most 2 * buckets * max(slots, 4096) rows from here
    by_cell = Window.partitionBy(F.lit(0)).orderBy(F.desc("_bucket"), "_part")
    earlier = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        placed.groupBy("_bucket", "_part")
        .agg(F.sum(one).alias("_n"), F.sum(value).alias("_sum"))
        .select(
            "_bucket",
            "_part",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank_before"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum_before"),
        )
    )
    in_cell = Window.partitionBy("_bucket", "_part").orderBy(F.desc(value), "_tie", key)
    upto = in_cell.rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(cells, ["_bucket", "_part"])
        .withColumn("rank", F.sum(one).over(upto) + F.col("_rank_before"))
        .withColumn("running", F.coalesce(F.sum(value).over(upto), F.lit(0.0)) + F.col("_sum_before"))
        .drop("_bucket", "_part", "_tie", "_rank_before", "_sum_before")
    )


def _value_bucket(value: Column) -> Column:
    """Order-preserving bucket of about 2 % width."""
    size = F.floor(F.log2(F.abs(value)) * 32) + 40_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    split: bool | None = None,
    skew: SkewConfig = SKEW,
) -> DataFrame:
    """Linear-interpolation quantiles per group: columns keys, ``q`` (array), ``n``.

    Ordinary groups use the built-in exact percentile. Of hot groups, and of a whole table
    (no keys), only the values near each wanted rank reach one task: counts per bucket find the bucket holding the
    rank, a linear cut of that bucket narrows it again, and a window over the distinct
    values of the final slice picks the value.
    """
    keys = list(keys)
    if split is None and keys:
        return both_ways(df, lambda rows, way: exact_quantiles(rows, keys, value, probs, way), skew, key=keys[0])
    if split is not False:
        return _quantiles_by_rank(df, keys, value, probs)
    wanted = ", ".join(f"{p!r}D" for p in probs)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    return known.groupBy(*keys).agg(F.expr(f"percentile(_v, array({wanted}))").alias("q"), F.count(F.lit(1)).alias("n"))


def _quantiles_by_rank(df: DataFrame, keys: list[str], value: str, probs: Sequence[float]) -> DataFrame:
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counted = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _value_bucket(F.col("_v")))
    total = Window.partitionBy(*keys)
    in_order = total.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(in_order), F.lit(0)))
        .withColumn("n", F.sum("_n").over(total))
    )
    asks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                 (F.floor if side == 0 else F.ceil)(F.lit(float(p)) * (F.col("n") - 1)).alias("rank"))
        for i, p in enumerate(probs) for side in (0, 1)
    ])
    targets = (
        histogram.withColumn("_ask", F.explode(asks))
        .filter((F.col("_ask.rank") >= F.col("_start")) & (F.col("_ask.rank") < F.col("_start") + F.col("_n")))
        .select(*keys, "_b", "_lo", "_hi", "n", F.col("_start").alias("_from"),
                F.col("_ask.i").alias("_i"), F.col("_ask.side").alias("_side"), F.col("_ask.rank").alias("_rank"))
    )
    ask = [*keys, "n", "_i", "_side", "_rank"]
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * 4096)).otherwise(F.lit(0))
    near = join_same(counted, targets, [*keys, "_b"]).withColumn("_slot", slot.cast("long"))
    in_slots = Window.partitionBy(*ask).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        near.groupBy(*ask, "_from", "_slot")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_first", F.col("_from") + F.coalesce(F.sum("_m").over(in_slots), F.lit(0)))
        .filter((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_m")))
        .select(*ask, "_slot", "_first")
    )
    in_slot = Window.partitionBy(*ask, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        join_same(near, slots, [*ask, "_slot"])
        .withColumn("_end", F.col("_first") + F.sum("_n").over(in_slot))
        .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    )
    pairs = picked.groupBy(*keys, "n", "_i").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_low"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_high"),
    )
    share = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1) * (F.col("n") - 1)
    share = share - F.floor(share)
    value_at = F.col("_low") + (F.col("_high") - F.col("_low")) * share
    return pairs.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", value_at.alias("q")))), lambda s: s["q"]).alias("q"),
        F.max("n").alias("n"),
    )
