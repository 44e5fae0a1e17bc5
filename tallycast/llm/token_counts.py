"""Tokens per document from flat token files that have no index.

A flat file is nothing but token ids, each document closed by the end-of-document id. It is
kept as numbered blocks of a fixed number of ids (``tokens``: file, block, ids as little-endian
16- or 32-bit numbers), which any number of tasks can read at any place. A block knows nothing
about the documents around it.

Each block is searched for the end id with one vector comparison. It hands on the lengths of
the documents that lie wholly inside it, its head (ids up to the first end) and its tail (ids
after the last). A prefix scan over the ends of the blocks numbers the documents of a file, and
heads and tails with the same number are stitched together, over any number of blocks. The
scan has two levels, runs of ``RUN`` blocks and then the runs, so that no task passes over all
blocks of one file; stitching adds up before it shuffles.

Defined results: ids after the last end of a file form a document with ``closed`` false; two
ends in a row are a document of no ids besides the end; an empty block or file gives nothing.
Counts include the end id. The writer gives null and empty texts the end id only, keeps
repeated rows and rows without id, and an empty table gives no blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm import common
from tallycast.llm.tokens import encoder

END_ID = 49407  # the end-of-text id of the tokenizer, which no text can hold
BLOCK_TOKENS = 1 << 18
RUN = 1024
CACHED = 300_000  # chunks an encoder remembers, beside the blocks being written
ROW_GROUP_BYTES = 16 << 20


def write_flat(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, ids, doc_ids): the ids of all texts as one flat file per task, in blocks.

    ``width`` is the bytes per id. Rows with ``block`` null carry ``doc_ids``, the documents of
    the file in order, with ``first`` the number of the first: who they are, not where. Control
    strings in a text are encoded as ordinary text, so ``end_id`` stands at ends only.
    """
    def work(batches):
        code, file = encoder(tokenizer_path, True, CACHED), TaskContext.get().partitionId()
        waiting, size, block, first = [], 0, 0, 0
        for batch in batches:
            doc_ids, text = common.columns(batch, "doc_id", "text")
            for ids in code.encode(value.as_py() or "" for value in text):
                waiting += [ids, np.array([end_id], np.uint32)]
                size += len(ids) + 1
                while size >= block_tokens:
                    flat = np.concatenate(waiting)
                    yield _block(file, block, flat[:block_tokens], width)
                    waiting, size, block = [flat[block_tokens:]], size - block_tokens, block + 1
            if len(doc_ids):
                yield _rows(file, None, None, first, doc_ids.to_pylist())
                first += len(doc_ids)
        if size:
            yield _block(file, block, np.concatenate(waiting), width)

    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work,
                              "file long, block long, ids binary, first long, doc_ids array<long>")


def _block(file: int, block: int, ids: np.ndarray, width: int) -> pa.RecordBatch:
    if width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids above 65,535 need a width of four bytes")
    return _rows(file, block, ids.astype(f"<u{width}").tobytes(), None, None)


def _rows(file, block, ids, first, doc_ids) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
    names = ["file", "block", "ids", "first", "doc_ids"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((file, block, ids, first, doc_ids), kinds)], names)


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, block, ends, head, inner, tail) of each block; ``inner`` are the lengths of documents wholly inside it."""
    def work(batches):
        for batch in batches:
            file, block, ids = common.columns(batch, "file", "block", "ids")
            ends, head, inner, tail = [], [], [], []
            for value in ids:
                flat = np.frombuffer(value.as_py() or b"", f"<u{width}")
                at = np.flatnonzero(flat == end_id)
                ends.append(len(at))
                head.append(int(at[0]) + 1 if len(at) else 0)
                inner.append(np.diff(at))
                tail.append(len(flat) - int(at[-1]) - 1 if len(at) else len(flat))
            yield pa.RecordBatch.from_arrays(
                [file, block, pa.array(ends, pa.int64()), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64())],
                ["file", "block", "ends", "head", "inner", "tail"])

    return common.map_batches(blocks.select("file", "block", "ids"), work,
                              "file long, block long, ends long, head long, inner array<long>, tail long")


def count_tokens(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, number, tokens, closed): one row per document, numbered from 0 in its file."""
    found = common.keep(scan_blocks(blocks, end_id, width).withColumn("run", F.floor(F.col("block") / RUN)))
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.groupBy("file", "run").agg(F.sum("ends").alias("all")).select(
        "file", "run", F.coalesce(F.sum("all").over(over_runs), F.lit(0)).alias("earlier"))
    placed = found.withColumn("in_run", F.coalesce(F.sum("ends").over(in_run), F.lit(0))).join(runs, ["file", "run"])
    placed = placed.withColumn("number", F.col("earlier") + F.col("in_run"))

    edges = F.array(
        F.struct("number", F.col("head").alias("tokens"), F.lit(True).alias("closed")),
        F.struct((F.col("number") + F.col("ends")).alias("number"), F.col("tail").alias("tokens"), F.lit(False).alias("closed")),
    )
    stitched = (
        placed.select("file", F.inline(edges)).filter("tokens > 0")
        .groupBy("file", "number").agg(F.sum("tokens").alias("tokens"), F.max("closed").alias("closed"))
    )
    inner = placed.select("file", "number", F.posexplode("inner").alias("pos", "tokens")).select(
        "file", (F.col("number") + 1 + F.col("pos")).alias("number"), "tokens", F.lit(True).alias("closed"))
    return stitched.unionByName(inner)


def document_counts(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, tokens) of every row: written as flat files, then counted from these alone."""
    flat = common.keep(write_flat(docs, tokenizer_path, end_id), {"parquet.block.size": ROW_GROUP_BYTES})
    counts = count_tokens(flat.filter("block is not null"), end_id)
    named = flat.filter("block is null").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id"))
    named = named.select("file", (F.col("first") + F.col("pos")).alias("number"), "doc_id")
    return named.join(counts, ["file", "number"]).select("doc_id", "tokens")
