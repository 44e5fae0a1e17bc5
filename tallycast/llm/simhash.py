"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits has eight positional bytes. Two fingerprints that differ in at most
``max_bits`` bits share at least ``8 - max_bits`` of them (four for four bits), because a
differing bit spoils one byte only. A posting list of single bytes would hold 1/256 of the
corpus, so the index lists the combinations of that guaranteed minimum: a list is the
intersection of ``8 - max_bits`` byte lists. Fingerprints that share a list have the shared
bytes of each pair tallied, pairs below the minimum are dropped, the rest verified bit by bit.

Equal fingerprints are one entry. Lists of any length are compared block by block
(``common.paired_blocks``); a block hands on one link per member, not its pairs.

Defined results: null and empty texts, and texts of blanks only, have fingerprint zero and
link like any other; a null ``doc_id`` gets a row and takes no part in the smallest id; rows
that repeat a ``doc_id`` each get a row; an empty table gives no rows; other columns are
not looked at. Texts of any length are hashed whole, in pieces.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallycast.llm import common

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BLOCK_ROWS = 2048
AT_ONCE = 1 << 16
BITS_SET = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # on bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    width = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:at + AT_ONCE], ends[at:at + AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        ids, text = common.columns(batch, "doc_id", "text")
        values = np.fromiter((fingerprint(value) for value in common.texts(text)), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    return common.map_batches(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


def posting_masks(max_bits: int = MAX_BITS) -> list[int]:
    """One mask for each combination of the guaranteed number of positional bytes, as signed longs."""
    spots = combinations(range(8), 8 - max_bits)
    return [int(np.uint64(sum(0xFF << 8 * i for i in chosen)).astype(np.int64)) for chosen in spots]


def _linked(max_bits: int):
    def work(batches):
        for rows, starts in common.whole_runs(batches, ("_combo", "_bytes", "_i", "_j")):
            fp, own, first, second = (rows.column(c).to_numpy() for c in ("fp", "_b", "_i", "_j"))
            found_a, found_b = [], []
            for a, b in common.pairs_within(starts, len(fp), (own, first, second)):
                differ = (fp[a] ^ fp[b]).view(np.uint8).reshape(-1, 8)
                tally = (differ == 0).sum(axis=1)  # positional bytes the pair shares
                enough = tally >= 8 - max_bits
                a, b, differ = a[enough], b[enough], differ[enough]
                near = BITS_SET[differ].sum(axis=1) <= max_bits
                found_a.append(a[near])
                found_b.append(b[near])
            label = common.smallest_labels(len(fp), np.concatenate(found_a), np.concatenate(found_b))
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])
    return work


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (``fp``) to connect all that are near."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: beyond that no positional byte is guaranteed to match")
    masks = F.array(*[F.lit(mask).cast("long") for mask in posting_masks(max_bits)])
    members = distinct.select("fp", F.posexplode(masks).alias("_combo", "_mask")).select(
        "fp", "_combo", F.col("fp").bitwiseAND(F.col("_mask")).alias("_bytes"))
    blocks = common.paired_blocks(members, ("_combo", "_bytes"), "fp", block_rows)
    runs = common.grouped(blocks, ("_combo", "_bytes", "_i", "_j"))
    return common.map_batches(runs, _linked(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = common.keep(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = common.components(links(distinct.select("fp"), max_bits, block_rows)).withColumnRenamed("v", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(smallest, "root").select("fp", "component_id")
    name = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(by_print, "fp").select("doc_id", name, "component_id")
