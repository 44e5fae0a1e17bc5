"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded.

A document of n tokens, its closing id included, is cut into full pieces of ``longest`` tokens
and one piece for each binary digit of the rest, longest first. Every piece is a sequence of
its own; sequences of the same length form a bucket (``bucket`` is the binary logarithm), from
which a trainer draws batches of equal lengths. Packing is a map over the documents: no
shuffle, no group, and a sequence is as large as ``longest`` at most.

Defined results: null and empty texts consist of the closing id only; repeated rows and rows
without an id are packed like any other; texts of any length are tokenized whole, piece by
piece; an empty table gives no rows; other columns are not looked at. ``sequence_id`` is
unique in one result and depends on how the table is split into files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import common
from tallycast.llm.tokens import encoder

LONGEST = 4096
END_ID = 2
ROWS_AT_ONCE = 4096


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of so many tokens, in the order of the text."""
    rest = tokens % longest
    digits = [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]
    return [longest] * (tokens // longest) + digits


def _pieces(path: str, longest: int, end_id: int, with_ids: bool):
    def rows(doc_ids, ids):
        for doc, tokens in zip(doc_ids, ids):
            tokens = np.append(tokens, end_id).astype("<u4")
            begin = 0
            for length in piece_lengths(len(tokens), longest):
                part = tokens[begin:begin + length]
                yield doc, begin, length, part, len(tokens)
                begin += length

    def work(batches):
        code = encoder(path)
        for batch in batches:
            doc_ids, text = common.columns(batch, "doc_id", "text")
            texts = (value.as_py() or "" for value in text)
            found: list[tuple] = []
            for row in rows(doc_ids.to_pylist(), code.encode(texts)):
                found.append(row if with_ids else (*row[:3], zlib.crc32(row[3]), row[4]))
                if len(found) >= ROWS_AT_ONCE:
                    yield _batch(found, with_ids)
                    found = []
            if found:
                yield _batch(found, with_ids)

    return work


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, start, length, content, tokens = zip(*rows)
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        column = pa.ListArray.from_arrays(ends, np.concatenate(content).astype(np.int32))
    else:
        column = pa.array(content, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), column, pa.array(tokens, pa.int64())],
        ["doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens"])


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per sequence: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    Without ``with_ids`` the ids give way to ``ids_crc32``, their checksum as little-endian
    32-bit numbers.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    kind = "ids array<int>" if with_ids else "ids_crc32 long"
    pieces = common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _pieces(tokenizer_path, longest, end_id, with_ids),
        f"doc_id long, start long, length long, {kind}, doc_tokens long")
    return pieces.withColumns({
        "bucket": F.log2("length").cast("int"),
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
    })
