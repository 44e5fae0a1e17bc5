"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: the sources in code point order (null last) take ``weights`` in turn and share
``share`` times all words; a source stops at ``most`` times its own size, and what it leaves
is shared among the others by weight until none is above.

Rates: the entropy-balancing problem keeps the document rates r as close as possible to one,
in relative entropy, under one token constraint per source, sum(r * size) = target, and
0 <= r <= most. Its convex dual has one multiplier per source and gives exponentially tilted
rates r = min(most, exp(l * z)), z the document's size in units of its source's mean. Newton
steps solve it, kept inside a bracket so that the kink at ``most`` cannot throw them off. Each
iteration is one aggregate over the documents, combined before its shuffle by (source, size),
which is why it costs no more for more documents of the same sizes.

Copies: r is rounded to whole copies by a fixed hash per document, floor(r + u), and the
threshold of each source is then moved, found from two histograms of u, until its copies hold
as many words as its target, to within about one document.

The multipliers stay in a table of one row per source; nothing is collected.

Defined results: null text has size 0; null sources are one source, the last; a document of
size 0 takes 0 words; a source of size 0 has target 0; null ids and repeated rows each get a
row, rows equal in id and text are rounded alike; an empty table gives no rows; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import keep, release

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
STEPS = 40
CLOSE = 1e-9
BINS = 1024


def with_sizes(docs: DataFrame) -> DataFrame:
    """Add ``_key`` (the source, null told apart), ``size`` in words and ``_u``, a fixed number in [0, 1)."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(1 << 53)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.withColumns({"_key": key, "size": words, "_u": unit})


def targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to (_key, source_size), a table of one row per source.

    With w the weight and S the size, the final target is min(most * S, w * level) at the one
    level where all add up to the total. A source is full at levels from most * S / w on, so
    the sources are put in that order and the level follows from running sums.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("_key") == "", "_key")  # UTF-8 order is code point order
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    fuller = everything.orderBy("full_at", "_key")
    full_before = F.sum(most * F.col("source_size")).over(fuller.rowsBetween(Window.unboundedPreceding, -1))
    weight_left = F.sum("weight").over(fuller.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total") - F.coalesce(full_before, F.lit(0.0))) / weight_left
    placed = (
        per_source.withColumn("weight", weight)
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("full_at", most * F.col("source_size") / F.col("weight"))
        .withColumn("level", level)  # right at the first source that is not full; it only falls after that
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    )
    cap = (most * F.col("source_size")).cast("double")
    return placed.select("_key", "source_size", "n", F.least(cap, F.coalesce(F.col("weight") * F.col("level"), cap)).alias("target"))


def _rate(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("l") * F.col("z"))))


def _scaled() -> Column:
    """The size in units of the mean size of the source."""
    return F.when(F.col("source_size") > 0, F.col("size") * F.col("n") / F.col("source_size")).otherwise(F.lit(0.0)).alias("z")


def multipliers(cells: DataFrame, sources: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """Add the dual solution ``l`` to ``sources`` (_key, target, source_size); ``cells`` has (_key, z, words).

    A full source (target = most * size) needs an infinite multiplier and a target of zero a
    negative infinite one; both start solved, at the ends of the bracket.
    """
    low, high = -1e9, 1e9
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    none = F.col("target") <= 0
    state = keep(sources.withColumns({
        "low": F.lit(low), "high": F.lit(high), "solved": full | none,
        "l": F.when(none, F.lit(low)).when(full, F.lit(high)).otherwise(F.lit(0.0)),
    }))
    for _ in range(steps):
        waiting = state.filter(~F.col("solved"))
        if waiting.isEmpty():
            break
        rate = _rate(most)
        sums = cells.join(waiting.select("_key", "l"), "_key").groupBy("_key").agg(
            F.sum(F.col("words") * rate).alias("got"),
            F.sum(F.when(rate < most, F.col("words") * F.col("z") * rate).otherwise(F.lit(0.0))).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        newton = F.when(F.col("slope") > 0, F.col("l") - gap / F.col("slope"))
        wider = F.when(gap < 0, F.greatest(F.lit(1.0), F.col("l") * 2)).otherwise(F.least(F.lit(-1.0), F.col("l") * 2))
        bounded = (F.col("low") > low) & (F.col("high") < high)
        middle = F.when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(F.col("wider"))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        stepped = (
            state.join(sums, "_key", "left")
            .withColumns({
                "low": F.when(gap < 0, F.col("l")).otherwise(F.col("low")),
                "high": F.when(gap > 0, F.col("l")).otherwise(F.col("high")),
                "solved": F.col("solved") | (F.abs(gap) <= CLOSE * F.col("target")),
                "newton": newton,
                "wider": wider,
            })
            .withColumn("l", F.when(F.col("solved"), F.col("l")).when(inside, F.col("newton")).otherwise(middle))
            .select(*state.columns)
        )
        following = keep(stepped)
        release(state)
        state = following
    return state.select(*sources.columns, "l")


def _steps(most: int) -> Column:
    """The places, in 2^20 per unit, at which a rising threshold gives the document its next copy."""
    places = [F.floor((k - F.col("rate") - F.col("_u") + most) * (BINS * BINS)).cast("long") for k in range(1, most + 1)]
    return F.array(*places)


def _cut(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """(_key, goal, under, under_words, over, over_words): the places just under and over each goal.

    All ``steps`` (_key, place, size) below ``under`` hold ``under_words`` <= goal words, one
    place more holds ``over_words`` > goal. Two histograms per source, the second inside the
    one bin that the goal falls into. A source whose steps do not reach its goal is left out.
    """
    steps = steps.withColumn("coarse", F.floor(F.col("place") / BINS))
    rising = Window.partitionBy("_key").orderBy("coarse")
    coarse = (
        steps.groupBy("_key", "coarse").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(rising))
        .join(goals, "_key").filter("upto > goal")
        .groupBy("_key", "goal").agg(F.min(F.struct("coarse", (F.col("upto") - F.col("words")).alias("before"))).alias("hit"))
        .select("_key", "goal", "hit.coarse", "hit.before")
    )
    rising = Window.partitionBy("_key").orderBy("place")
    return (
        steps.join(coarse, ["_key", "coarse"])
        .groupBy("_key", "goal", "before", "place").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.col("before") + F.sum("words").over(rising))
        .filter("upto > goal")
        .groupBy("_key", "goal").agg(F.min(F.struct("place", (F.col("upto") - F.col("words")).alias("below"), "upto")).alias("hit"))
        .select("_key", "goal", F.col("hit.place").alias("under"), F.col("hit.below").alias("under_words"),
                (F.col("hit.place") + 1).alias("over"), F.col("hit.upto").alias("over_words"))
    )


def thresholds(rows: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``threshold``, ``small`` and ``threshold_small``.

    The steps below ``threshold`` make up the target but for part of one document. What is
    missing is filled with the next steps of documents of at most ``small`` words, below
    ``threshold_small``, unless letting in that one document comes nearer.
    """
    steps = rows.filter("size > 0").join(solved.select("_key", "source_size", "n", "l"), "_key").select("_key", "size", "_u", "l", _scaled())
    steps = steps.withColumn("rate", _rate(most)).select("_key", "size", F.explode(_steps(most)).alias("place"))
    first = keep(_cut(steps, solved.select("_key", F.col("target").alias("goal"))))
    gaps = first.select(
        "_key", F.col("under").alias("from"), (F.col("goal") - F.col("under_words")).alias("goal"),
        F.floor((F.col("goal") - F.col("under_words")) / 2).alias("small"))
    fillers = steps.join(gaps.select("_key", "from", "small"), "_key").filter("place >= from and size <= small").select("_key", "place", "size")
    second = _cut(fillers, gaps.select("_key", "goal")).select(
        "_key",
        F.when(F.col("over_words") - F.col("goal") < F.col("goal") - F.col("under_words"), F.col("over")).otherwise(F.col("under")).alias("threshold_small"),
        F.least(F.col("over_words") - F.col("goal"), F.col("goal") - F.col("under_words")).alias("off"))
    both = first.join(gaps.select("_key", "small"), "_key").join(second, "_key", "left")
    nearer = F.col("over_words") - F.col("goal") < F.coalesce("off", F.col("goal") - F.col("under_words"))
    chosen = both.select(
        "_key", F.when(nearer, F.col("over")).otherwise(F.col("under")).alias("threshold"), "small",
        F.when(nearer, F.lit(None)).otherwise(F.col("threshold_small")).alias("threshold_small"))
    return solved.join(chosen, "_key", "left")


def _with_copies(rows: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """A source without a threshold holds no more than its target with all steps: all are taken."""
    joined = rows.join(solved, "_key", "left").withColumn("z", _scaled()).withColumn("rate", _rate(most))
    limit = F.when(F.col("size") <= F.col("small"), F.greatest("threshold", "threshold_small")).otherwise(F.col("threshold"))
    taken = F.size(F.filter(_steps(most), lambda place: place < F.col("_limit")))
    copies = F.when(F.col("threshold").isNull(), F.lit(most)).otherwise(taken)
    return joined.withColumn("_limit", limit).withColumn("copies", copies.cast("int"))


def solve(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_key, source_size, n, target, l, threshold) from rows with ``_key``, ``size`` and ``_u``."""
    per_source = rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = keep(targets(per_source, weights, share, most))
    cells = rows.groupBy("_key", "size").agg(F.count(F.lit(1)).alias("docs")).join(sources, "_key")
    cells = keep(cells.select("_key", _scaled(), (F.col("docs") * F.col("size")).alias("words")))
    solved = multipliers(cells, sources, most)
    return keep(thresholds(rows, solved, most))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row."""
    rows = keep(with_sizes(docs).select("doc_id", "source", "_key", "size", "_u"))
    mixed = _with_copies(rows, solve(rows, weights, share, most), most)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", taken)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as its copies; same columns."""
    names = [f"`{name}`" for name in docs.columns]
    rows = keep(with_sizes(docs.select("doc_id", "source", "text")).select("_key", "size", "_u"))
    solved = solve(rows, weights, share, most)
    inner = with_sizes(docs.select(F.struct(*names).alias("_doc"), "doc_id", "source", "text")).select("_doc", "_key", "size", "_u")
    mixed = _with_copies(inner, solved, most).filter("copies > 0")
    return mixed.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
