"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A sequence of three letters, word edges
included, is bound into one vector by multiplying the first letter's vector, permuted twice,
the second's, permuted once, and the third's. A document is the bundle (sum) of the vectors of
its sequences, a language the bundle of its documents, each of length one. A document gets the
language with the largest cosine, the first in order if there are several.

The prototypes are learned from all documents that are not held out, so no language is missed;
their vectors are summed per task and then by Spark, so only one vector of 4 kB per language
reaches the driver, and tasks; more than ``MOST_LANGUAGES`` are an error. Scoring is a map over
the documents. Tables of counts are built in blocks of texts, characters and sequences.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text when there is no language to learn; null languages and null ids are not learned from;
negative cosines score 0; repeated rows are scored alike; an empty table gives no rows; other
columns are not looked at. Texts are read whole, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import common
from tallycast.llm.quality_trees import held_out

WIDTH = 1024
SYMBOLS = 64  # word edge, a to z, and the other letters by hash
SEED = 7
CHARS_AT_ONCE = 1 << 20
DOCS_AT_ONCE = 512
SEQUENCES_AT_ONCE = 8192  # columns of a table of counts
MOST_LANGUAGES = 1 << 15  # prototypes reach the driver and every task: 4 kB each
UNKNOWN = "und"


@cache
def symbol_of() -> np.ndarray:
    """The symbol of every code point; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            lower = ord(letter.lower()[0])
            table[code] = lower - 96 if 97 <= lower <= 122 else 27 + (lower * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


@cache
def letters() -> np.ndarray:
    signs = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (SYMBOLS, WIDTH))
    return (2 * signs - 1).astype(np.float32)


def bound(sequences: np.ndarray) -> np.ndarray:
    """Vectors of three-letter sequences, coded as numbers to the base ``SYMBOLS``."""
    first, second, third = sequences // SYMBOLS ** 2, sequences // SYMBOLS % SYMBOLS, sequences % SYMBOLS
    table = letters()
    return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]


def bundles(texts: list[str]) -> np.ndarray:
    """One vector per text, zero for texts without letters."""
    joined = " ".join(["", *texts, ""])
    symbols = symbol_of()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(-1, len(texts), dtype=np.int32), [1, *(len(text) + 1 for text in texts)])
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0  # one edge between words
    kept[0] = True
    symbols, owner = symbols[kept], owner[kept]
    found = np.zeros((len(texts), WIDTH), np.float32)
    for start in range(0, len(symbols) - 2, CHARS_AT_ONCE):
        part = symbols[start:start + CHARS_AT_ONCE + 2].astype(np.int64)
        middle = part[1:-1] != 0
        code = ((part[:-2] * SYMBOLS + part[1:-1]) * SYMBOLS + part[2:])[middle]
        own = owner[start + 1:start + len(part) - 1][middle].astype(np.int64)
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(SYMBOLS ** 3, np.int64)
        place[seen] = np.arange(len(seen))
        spot = place[code]
        for low in range(0, len(seen), SEQUENCES_AT_ONCE):
            some = seen[low:low + SEQUENCES_AT_ONCE]
            there, whose = spot - low, own
            if len(some) < len(seen):
                here = np.flatnonzero((there >= 0) & (there < len(some)))
                there, whose = there[here], own[here]
            counts = np.bincount(whose * len(some) + there, minlength=len(texts) * len(some))
            found += counts.reshape(len(texts), len(some)).astype(np.float32) @ bound(some)
    return found


def _of_length_one(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1)


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with bounded numbers of texts and of characters, but for single long texts."""
    first, group, size = 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        if group and (len(group) == DOCS_AT_ONCE or size + len(text) > CHARS_AT_ONCE):
            yield first, group
            first, group, size = row, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a vector of length one for each."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    known = known.filter("text is not null").select("lang", "text")

    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, text = common.columns(batch, "lang", "text")
            lang = np.array(lang.to_pylist(), object)
            for first, group in _groups(text):
                vectors = _of_length_one(bundles(group))
                own = lang[first:first + len(group)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + vectors[own == name].sum(axis=0, dtype=np.float64)
        if sums:
            values = [pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(values, ["lang", "v"])

    parts = common.map_batches(known, work, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].cast("array<float>").alias("v"))
    rows = whole.limit(MOST_LANGUAGES + 1).toPandas().sort_values("lang")  # one short row a language
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of lang")
    names = rows["lang"].tolist()
    found = np.array(rows["v"].tolist(), np.float64).reshape(len(names), WIDTH)
    return names, _of_length_one(found)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang)."""
    names, known = prototypes(docs)
    known = known.astype(np.float32)

    def work(batches):
        for batch in batches:
            ids, text = common.columns(batch, "doc_id", "text")
            found, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for first, group in _groups(text):
                vectors = bundles(group)
                rows = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
                if len(rows) and names:
                    cosine = _of_length_one(vectors[rows]) @ known.T
                    best = cosine.argmax(axis=1)
                    found[first + rows] = np.array(names, object)[best]
                    scores[first + rows] = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(found.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    scored = common.map_batches(docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
