"""CSV files whose quoted values hold line breaks, read by many tasks.

Whether a line starts inside a quoted value depends on all lines before it. Each line is a function of that one bit:
it keeps it, turns it, or sets it. A task runs through its part of a file for both
values of the bit and hands on one row; a prefix scan over these rows tells how each part starts. Lines that
are whole records are parsed where they are, and only the others are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycast.functions.scale import kept

PART_BITS = 33  # of a row id: records of one part of a file
START, WITHIN, QUOTED, MAYBE_CLOSED = range(4)  # of a field, what follows a quote in a quoted value is still open


def _ends_quoted(line: Column, inside: int) -> Column:
    """1 if a line that starts outside (0) or inside (1) a quoted value ends inside one.

    A quote opens a value only where a field starts; doubled ones stay inside.
    """
    def step(state: Column, piece: Column) -> Column:
        # ``piece`` stands before the next quote
        after_text = F.when(F.endswith(piece, F.lit(",")), QUOTED).otherwise(WITHIN)
        opened = F.when(piece == "", F.when(state == WITHIN, WITHIN).otherwise(QUOTED)).otherwise(after_text)
        return F.when(state == QUOTED, MAYBE_CLOSED).otherwise(opened)

    pieces = F.split(line, '"')
    before_quotes = F.slice(pieces, 1, F.size(pieces) - 1)
    last = F.aggregate(before_quotes, F.lit(QUOTED if inside else START), step)
    return F.when(F.contains(line, F.lit('"')), (last == QUOTED).cast("byte")).otherwise(F.lit(inside).cast("byte"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # lines end with \n only, so that every other character of a value is kept
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        _ends_quoted(F.col("value"), 0).alias("from_out"), _ends_quoted(F.col("value"), 1).alias("from_in"),
        F.col("value").isin("", "\r").alias("blank"),
    )


def _through(from_out: np.ndarray, from_in: np.ndarray, start: int) -> np.ndarray:
    """The bit before every line and after the last one."""
    sets = from_out == from_in
    turns = np.cumsum(from_out > from_in)
    last_set = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    known = last_set >= 0
    base = np.where(known, from_out[last_set], start)
    since = turns - np.where(known, turns[last_set], 0)
    return np.concatenate([[start], base ^ (since & 1)])


class _Walk:
    """The bit and the number of records begun, for both starts, through the lines of one part."""

    def __init__(self, file: str, block: int):
        self.file, self.block = file, block
        self.bits, self.begun, self.lines = [0, 1], [0, 0], 0
        self.crosses = self.bare = False
        self.valid = True

    def run(self, from_out: np.ndarray, from_in: np.ndarray, blank: np.ndarray) -> list[np.ndarray]:
        """Bit before each line and number of its record (from outside, from inside), and its place."""
        before, numbers = [], []
        for way in (0, 1):
            bits = _through(from_out, from_in, self.bits[way])
            numbers.append(self.begun[way] + np.cumsum((bits[:-1] == 0) & ~blank))
            before.append(bits[:-1])
            self.bits[way], self.begun[way] = int(bits[-1]), int(numbers[way][-1])
            self.crosses |= way == 0 and bool(bits[1:].any())
        places = self.lines + np.arange(len(blank))
        self.lines += len(blank)
        return [*before, *numbers, places]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Walk, slice]]:
    """Consecutive lines of one part within a batch, with the walk through that part."""
    walk = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        cuts = (np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(block)]):
            if walk is None or (walk.file, walk.block) != (file[low], int(block[low])):
                walk = _Walk(file[low], int(block[low]))
            yield batch, walk, slice(low, high)


def _bits(batch: pa.RecordBatch, lines: slice) -> list[np.ndarray]:
    whole = [batch.column(name).to_numpy()[lines].astype(int) for name in ("from_out", "from_in")]
    return [*whole, batch.column("blank").to_numpy(zero_copy_only=False)[lines].astype(bool)]


ENDS = ("file string, block long, end_out long, end_in long, count_out long, count_in long, crosses boolean, valid boolean, "
        "bare boolean")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part: the bit after it and the number of its records, for both starts."""
    names = [field.split()[0] for field in ENDS.split(", ")]

    def row(w: _Walk) -> pa.RecordBatch:
        values = [w.file, w.block, *w.bits, *w.begun, w.crosses, w.valid, w.bare]
        return pa.RecordBatch.from_pydict({name: [value] for name, value in zip(names, values)})

    last = None
    for batch, walk, lines in _pieces(batches):
        if last is not None and walk is not last:
            yield row(last)
        last = walk
        walk.run(*_bits(batch, lines))
        walk.valid &= bool(batch.column("valid").to_numpy(zero_copy_only=False)[lines].all())
        walk.bare |= bool(batch.column("bare").to_numpy(zero_copy_only=False)[lines].any())
    if last is not None:
        yield row(last)


PLACED = ("file string, block long, value string, from_out byte, from_in byte, bit_out long, bit_in long, number_out long, "
          "number_in long, place long")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with the bit before it and the number of its record, for both starts."""
    names = [field.split()[0] for field in PLACED.split(", ")]
    for batch, walk, lines in _pieces(batches):
        part = batch.slice(lines.start, lines.stop - lines.start)
        found = [pa.array(values.astype("int64")) for values in walk.run(*_bits(batch, lines))]
        yield pa.RecordBatch.from_arrays([part.column(name) for name in names[:5]] + found, names=names)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per part of a file, at most one for every ``spark.sql.files.maxPartitionBytes``: how it starts.

    ``start`` is 1 if its first line lies inside a quoted value; ``part`` numbers the parts in
    order of files and places; ``open_part`` and ``open_number`` name the last record begun before it.
    """
    lines = _lines(spark, path).withColumns({"valid": F.is_valid_utf8("value"), "bare": F.rlike("value", F.lit(r"\r(?!\z)"))})
    ends = lines.drop("value").mapInArrow(_ends, ENDS)
    in_order = Window.partitionBy("file").orderBy("block")
    so_far, before = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    turned = ends.withColumn("_turns", F.sum((F.col("end_out") > F.col("end_in")).cast("long")).over(so_far))
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct("end_out", "_turns"))
    based = turned.withColumn("_set", F.last(fixed, ignorenulls=True).over(so_far))
    since = F.col("_turns") - F.coalesce("_set._turns", F.lit(0))
    end = (F.coalesce("_set.end_out", F.lit(0)) + since) % 2
    started = based.withColumn("end", end).withColumn("start", F.lag("end", 1, 0).over(in_order))
    counted = started.withColumn("records", F.when(F.col("start") == 0, F.col("count_out")).otherwise(F.col("count_in")))
    numbered = counted.withColumn("part", F.row_number().over(Window.orderBy("file", "block")).cast("long"))
    begun = F.when(F.col("records") > 0, F.struct("part", F.col("records").alias("number")))
    return numbered.select(
        "file", "block", "part", "start", "valid", "bare", (F.col("crosses") | (F.col("start") == 1)).alias("crosses"),
        (F.min("part").over(Window.partitionBy("file")) == F.col("part")).alias("first"),
        F.last(begun, ignorenulls=True).over(before).alias("opened"),
    ).select("*", F.col("opened.part").alias("open_part"), F.col("opened.number").alias("open_number")).drop("opened")


def read_records(spark: SparkSession, path: str, known: DataFrame, schema, options: dict, encoding: str, row_id: str) -> DataFrame:
    """The records of all files under ``path``, parsed, with their order as the long ``row_id``.

    ``known`` is what ``parts`` gives for the same path. A record is named by the part it begins in and its number
    there. The first record of a file is its header; blank lines between records are left out.
    """
    placed = _lines(spark, path).mapInArrow(_places, PLACED)
    joined = placed.join(known.drop("crosses", "valid", "bare"), ["file", "block"], "left")
    out = F.when(F.col("start").isNull(), F.raise_error(F.lit("the parts of the file changed while it was read")).cast("boolean")).otherwise(
        F.col("start") == 0)
    side = joined.withColumn("_out", out).withColumns({
        "_bit": F.when(F.col("_out"), F.col("bit_out")).otherwise(F.col("bit_in")),
        "_number": F.when(F.col("_out"), F.col("number_out")).otherwise(F.col("number_in")),
    })
    whole = (F.col("_bit") == 0) & (F.col("from_out") == 0)
    own = F.col("_number") > 0
    owner, number = F.when(own, F.col("part")).otherwise(F.col("open_part")), F.when(own, F.col("_number")).otherwise(F.col("open_number"))
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = side.select(
        "part", "place", text.alias("value"), whole.alias("whole"), "first",
        (F.shiftleft(owner, PART_BITS) + number).alias(row_id), number.alias("_number"), own.alias("_own"),
    )
    header = F.col("first") & (F.col("_number") == 1) & F.col("_own")
    single = lines.filter("whole AND value NOT IN ('', '\\r')").filter(~header).select(row_id, "value")
    opened = lines.filter("NOT whole").groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("part", "place", "value"))).alias("_lines"), F.bool_or(header).alias("_header"))
    joined_up = opened.filter("NOT _header").select(
        row_id, F.array_join(F.transform("_lines", lambda line: line["value"]), "\n").alias("value"))
    records = single.unionByName(joined_up).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    ddl = ", ".join(f"`{field.name.replace('`', '``')}` STRING" for field in schema.fields)
    parsed = records.select(F.from_csv("value", ddl, {k: str(v) for k, v in options.items()}).alias("_r"), row_id)
    return parsed.select("_r.*", row_id)
