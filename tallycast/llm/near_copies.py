"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash bands: a text has ``BANDS`` keys, each of the least values of
``BAND_ROWS`` hash orders of its shingles, and two texts of similarity s share a key with chance
1 - (1 - s^BAND_ROWS)^BANDS (0.9998 at 0.8, and more above). A fingerprint that compares bits can't
do that at this price: at 0.8 two SimHash fingerprints differ in about 15 % of their bits, so that
chance would take some 64 segments of 16 bits.

Only texts that share a key are compared, in the blocks of that key (``common.paired_blocks``), each pair in
the first band it shares. A pair goes on if the sizes of its sets allow the similarity and a byte of each hash
order's least value agrees in ``SKETCH_LEAST`` of the orders (below 0.8 only by a chance of about one in a
million). A text's shingles are sent only to keys under which it has such a partner, where sets are intersected
exactly; a block hands on links that connect what is similar, not its pairs. So pages of one template that
are not similar cost a comparison of short sketches where they share a key, and no shingles.

Beside the bands, the texts of a class of near fingerprints (``simhash.near_duplicates``, the method of op4) are compared in the
same way, all with all and whatever bands they share, under the class as one more key; a text is in the classes of all its rows.
Those whose sets are similar are linked; a class of short texts need not be similar.

Texts with the same set of shingles are one entry.

Defined results: words are split and lowered as by ``simhash.fingerprint``; texts of one to four
words have one shingle, of all of them; null and empty texts, and texts of blanks only, have none
and are copies of each other; an empty table gives no rows. Shingles are compared by 64-bit hashes. Other columns may
have any names; ``first_of_groups`` returns them as they came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from tallycast.llm import common, simhash

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # as a fraction, so that the comparison is exact
BANDS = 28
BAND_ROWS = 6
CLASS = BANDS  # the number, after those of the bands, under which a class of near fingerprints is a key
SEED = 42
SKETCH_LEAST = 108  # of BANDS * BAND_ROWS = 168; at similarity 0.8 the mean is 135 and the deviation 5.2
BLOCK_ROWS = 512
AT_ONCE = 256
TEXTS_AT_ONCE = 512


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, count, np.uint64) | np.uint64(1)


FLIPS, FACTORS, MIX = _odd(BANDS * BAND_ROWS, 1), _odd(BANDS * BAND_ROWS, 2), _odd(BANDS * BAND_ROWS, 3).reshape(BANDS, BAND_ROWS)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the different shingles of a UTF-8 text, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(one key for each band, as signed longs; a byte of each least value)."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(least, ((hashes[at:at + AT_ONCE, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    mixed = least ^ (least >> np.uint64(32))
    keys = (mixed.reshape(BANDS, BAND_ROWS) * MIX).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64), (mixed >> np.uint64(8)).astype(np.uint8).tobytes()


def _keyed(batches):
    for batch in batches:
        rows, text = common.columns(batch, "_row", "text")
        digests, sizes, sketches, keys = [], [], [], np.zeros((batch.num_rows, BANDS), np.int64)
        for i, value in enumerate(common.texts(text)):
            hashes = shingles(value)
            digests.append(xxh3_128_digest(hashes.tobytes()))
            sizes.append(len(hashes))
            keys[i], sketch = band_keys(hashes)
            sketches.append(sketch)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [rows, pa.array(digests, pa.binary()), lists, pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())],
            ["_row", "_set", "_keys", "_sketch", "_size"])


def _shingled(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            v, text = common.columns(batch.slice(at, TEXTS_AT_ONCE), "v", "text")
            sets = [shingles(value).tobytes() for value in common.texts(text)]
            yield pa.RecordBatch.from_arrays([v, pa.array(sets, pa.binary())], ["v", "_shingles"])


def possible_pairs(keys: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, band: int, blocks: np.ndarray):
    """(a, those after a that it may be similar to) for the members of one block group, in the first band a pair shares, and in its class.

    ``blocks`` holds each member's own block and the two blocks of the group, as columns.
    """
    own, within = blocks[:, 0], blocks[0, 1] == blocks[0, 2]
    over, under = SIMILARITY
    for a in range(len(sizes) - 1):
        others = np.arange(a + 1, len(sizes))
        if not within:
            others = others[own[others] != own[a]]
        low, high = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        others = others[low * under >= high * over]
        if 0 < band < CLASS:
            others = others[~(keys[others, :band] == keys[a, :band]).any(axis=1)]
        others = others[(sketches[others] == sketches[a]).sum(axis=1) >= SKETCH_LEAST]
        if len(others):
            yield a, others


def _block_groups(batches):
    """(rows, band, keys, sketches, sizes, blocks) of every block group."""
    for rows, starts in common.whole_runs(batches, ("_band", "_key", "_i", "_j")):
        rows = rows.combine_chunks()
        band = rows.column("_band").to_numpy()
        keys = rows.column("_keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sketches = np.frombuffer(b"".join(rows.column("_sketch").to_pylist()), np.uint8).reshape(len(keys), -1)
        sizes = rows.column("_size").to_numpy()
        blocks = np.column_stack([rows.column(c).to_numpy() for c in ("_b", "_i", "_j")])
        for start, end in zip(starts.tolist(), np.append(starts[1:], len(band)).tolist()):
            here = slice(start, end)
            yield rows.slice(start, end - start), int(band[start]), keys[here], sketches[here], sizes[here], blocks[here]


def _with_partner(batches):
    """(_band, _key, v) of the texts that have a possible partner under a key."""
    for rows, band, *rest in _block_groups(batches):
        chosen = np.zeros(rows.num_rows, bool)
        for a, others in possible_pairs(rest[0], rest[1], rest[2], band, rest[3]):
            chosen[a] = True
            chosen[others] = True
        if chosen.any():
            yield rows.select(["_band", "_key", "v"]).filter(pa.array(chosen)).combine_chunks().to_batches()[0]


def _active(batches):
    """The texts that have a possible partner in a band."""
    return _with_partner(batches)


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets of hashes reach ``SIMILARITY``."""
    shared = len(np.intersect1d(one, two, assume_unique=True))
    over, under = SIMILARITY
    return shared * under >= (len(one) + len(two) - shared) * over


def _linked(batches):
    for rows, band, keys, sketches, sizes, blocks in _block_groups(batches):
        sets = [np.frombuffer(value, np.uint64) for value in rows.column("_shingles").to_pylist()]
        v, group = rows.column("v").to_numpy(), np.arange(rows.num_rows)
        found_a, found_b = [], []
        for a, others in possible_pairs(keys, sketches, sizes, band, blocks):
            for b in others.tolist():
                if group[a] != group[b] and similar(sets[a], sets[b]):
                    group[group == group[b]] = group[a]
                    found_a.append(v[a])
                    found_b.append(v[b])
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])


def class_members(rows: DataFrame, keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(v, _band, _key): each text under every class of near fingerprints that one of its rows is in."""
    classes = simhash.near_duplicates(rows.withColumnRenamed("_row", "doc_id")).select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_key"))
    placed = common.joined(keyed.select("_row", "_set"), classes, "_row").select("_set", "_key").distinct()
    own = sets.filter("_size > 0").select("_set", "v")
    return common.joined(own, placed, "_set").select("v", F.lit(CLASS).alias("_band"), "_key")


def groups(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_row, group) for every row of ``rows`` (_row, text; ``_row`` a long that no other row has)."""
    rows, by_key = rows.select("_row", "text"), ("_band", "_key")
    keyed = common.keep(common.map_batches(rows, _keyed, "_row long, _set binary, _keys array<long>, _sketch binary, _size long"))
    sets = common.keep(keyed.groupBy("_set").agg(
        F.min("_row").alias("v"), *[F.first(name).alias(name) for name in ("_keys", "_sketch", "_size")]))
    about = sets.select("v", "_keys", "_sketch", "_size")

    def in_blocks(members: DataFrame, *tables: DataFrame) -> DataFrame:
        blocks = common.paired_blocks(members, by_key, "v", block_rows)
        for table in tables:
            blocks = common.joined(blocks, table, "v")
        return common.grouped(blocks, (*by_key, "_i", "_j"))

    members = sets.filter("_size > 0").select("v", F.posexplode("_keys").alias("_band", "_key"))
    members = members.repartition("_band", "_key")
    partners = "_band int, _key long, v long"
    by_band = common.map_batches(in_blocks(members, about), _active, partners)
    classes = common.keep(class_members(rows, keyed, sets))
    by_class = common.map_batches(in_blocks(classes, about), _with_partner, partners)
    active = common.keep(by_band.unionByName(by_class).distinct())
    texts = rows.withColumnRenamed("_row", "v").join(active.select("v").distinct(), "v")
    shingled = common.keep(common.map_batches(texts, _shingled, "v long, _shingles binary"))
    roots = common.components(common.map_batches(in_blocks(active, about, shingled), _linked, "a long, b long"))
    placed = sets.select("_set", "v").join(roots, "v", "left").select("_set", F.coalesce("root", "v").alias("group"))
    found = common.keep(keyed.select("_row", "_set").join(placed, "_set").select("_row", "group"))
    for table in (keyed, sets, classes, active, shingled):
        common.release(table)
    return found


def first_of_groups(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """Of each group of near copies the row of the smallest ``name``, then of the first row number; same columns.

    Rows are grouped by their texts alone, so rows that share a name, or have none, are told apart; a
    row without a name stays if no other of its group has one. Row numbers are given once, in a table.
    """
    whole = F.struct(*[f"`{column}`" for column in docs.columns]).alias("_doc")
    rows = common.keep(docs.select(F.monotonically_increasing_id().alias("_row"), whole))
    number = rows.select("_row", F.col("_doc")[name].alias("_name"))
    order = F.struct(F.col("_name").isNull().alias("nameless"), "_name", "_row")
    grouped = number.join(groups(rows.select("_row", F.col("_doc")["text"].alias("text"))), "_row")
    first = grouped.groupBy("group").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").select("_doc.*")
