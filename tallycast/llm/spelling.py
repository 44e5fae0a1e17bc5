"""Spelling variants: words one edit apart, found by composing vocabulary acceptors with a one-edit transducer.

Acceptor o transducer o acceptor is a machine over triples (state of the first word, edits made, state of
the second). Before its edit such a path keeps both words in one state, so the pairs are enumerated by
the state that a shared beginning leads to: two words that differ by one code point share their first
m // 2 code points or their last m - m // 2, m being the shorter length. Each word is entered under its
beginnings and, reversed, under its endings of these lengths, and a partition builds the minimal acceptor
of what follows and walks the composed machine. Acceptors number their words, so paths yield word
numbers. Partitions of any size are cut into blocks that meet in pairs (``common.paired_blocks``).

A word's form is its most frequent near word, if at least twice as frequent; counts double along
forms, so that they end after at most 63 steps, followed by joins that double the distance.

Defined results: null and empty texts have no words; a null ``doc_id`` counts as empty text in the
hash; rows that repeat an id are texts of their own and their runs add up; words of any length are
handled whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO_EVERY = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
BLOCK_WORDS = 8192
COUNTED_AT_ONCE = 400_000
SALTS = 16


# --- vocabulary -------------------------------------------------------------------------------


def spelled(prefix: bytes, run: str) -> str:
    """The run, or for one in ``TYPO_EVERY`` of the hashes the run without one of its code points."""
    h = crc32(prefix + run.encode())
    if h % TYPO_EVERY:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1:]


def _counted(batches):
    def handed_on(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    found: Counter[str] = Counter()
    for batch in batches:
        ids, text = common.columns(batch, "doc_id", "text")
        for name, value in zip(ids.to_pylist(), common.texts(text)):
            prefix = f"{'' if name is None else name}:".encode()
            for run, n in Counter(RUN.findall(value.lower().decode())).items():
                if len(run) >= LEAST_LETTERS:
                    word = spelled(prefix, run)
                    if len(word) >= LEAST_LETTERS:
                        found[word] += n
            if len(found) > COUNTED_AT_ONCE:
                yield handed_on(found)
                found.clear()
    yield handed_on(found)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``LEAST_LETTERS`` code points with ``LEAST_COUNT`` occurrences or more."""
    counted = common.map_batches(docs.select("doc_id", "text"), _counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- acceptors --------------------------------------------------------------------------------


class Acceptor:
    """Minimal acceptor of ``words`` (sorted, different), which it numbers in their order.

    ``edges[state]`` maps a code point to (next state, words passed over); ``final[state]`` says whether a word ends.
    """

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words_of: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, list[tuple[str, int]]]] = []  # open states below the start, each with its arcs so far
        arcs, ends, previous = [], [False], ""
        for word in words:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            self._close(path, arcs, ends, shared, known)
            for letter in word[shared:]:
                path.append((letter, []))
                ends.append(False)
            ends[-1] = True
            previous = word
        self._close(path, arcs, ends, 0, known)
        self.start = self._state(arcs, ends[0], known)

    def _close(self, path, arcs, ends, depth, known) -> None:
        while len(path) > depth:
            letter, own = path.pop()
            state = self._state(own, ends.pop(), known)
            (path[-1][1] if path else arcs).append((letter, state))

    def _state(self, arcs, final, known) -> int:
        key = (final, *arcs)
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.edges)
            passed, edges = int(final), {}
            for letter, following in arcs:
                edges[letter] = (following, passed)
                passed += self.words_of[following]
            self.edges.append(edges)
            self.final.append(final)
            self.words_of.append(passed)
        return state


def one_edit_pairs(machine: Acceptor) -> Iterator[tuple[int, int]]:
    """Numbers of words one edit apart, each pair once: the machine composed with one edit and itself.

    A replacement takes its two code points in order; of a run of equal code points only the first is deleted.
    """
    edges, final = machine.edges, machine.final
    same = [(machine.start, 0, "")]  # no edit yet: state, number, code point before
    while same:
        state, number, before = same.pop()
        arcs = list(edges[state].items())
        edited = []
        for i, (letter, (following, passed)) in enumerate(arcs):
            same.append((following, number + passed, letter))
            if letter != before:
                edited.append((following, number + passed, state, number))
            for _, (other, over) in arcs[i + 1:]:
                edited.append((following, number + passed, other, number + over))
        while edited:
            left, i, right, j = edited.pop()
            if final[left] and final[right]:
                yield i, j
            few, many = edges[left], edges[right]
            for letter in few if len(few) <= len(many) else many:
                if letter in few and letter in many:
                    (a, over_a), (b, over_b) = few[letter], many[letter]
                    edited.append((a, i + over_a, b, j + over_b))


# --- partitions -------------------------------------------------------------------------------


def _entries(batches):
    for batch in batches:
        words, counts = (column.to_pylist() for column in common.columns(batch, "word", "n"))
        rows = []
        for word, n in zip(words, counts):
            long = len(word)
            for size in {long // 2, (long - 1) // 2}:  # as the shorter of two words, as the longer
                rows.append((False, word[:size], word[size:], word, n))
            turned = word[::-1]
            for size in {long - long // 2, long - 1 - (long - 1) // 2}:
                rows.append((True, turned[:size], turned[size:], word, n))
        turned, start, rest, whole, n = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(turned, pa.bool_()), pa.array(start, pa.string()), pa.array(rest, pa.string()), pa.array(whole, pa.string()),
             pa.array(n, pa.int64())], ["turned", "start", "rest", "word", "n"])


def _shared_start(a: str, b: str) -> int:
    size = 0
    for x, y in zip(a, b):
        if x != y:
            break
        size += 1
    return size


def _linked(batches):
    names = ("turned", "start", "_i", "_j")
    for rows, starts in common.whole_runs(batches, names):
        turned, start, rest, word, n, own, first, second = (
            rows.column(name).to_pylist() for name in ("turned", "start", "rest", "word", "n", "_b", "_i", "_j"))
        found: list[tuple[str, int, str, int]] = []
        for at, end in zip(starts.tolist(), np.append(starts[1:], rows.num_rows).tolist()):
            order = sorted(range(at, end), key=rest.__getitem__)
            size, within = len(start[at]), first[at] == second[at]
            for a, b in one_edit_pairs(Acceptor([rest[row] for row in order])):
                a, b = order[a], order[b]
                if not within and own[a] == own[b]:
                    continue
                short = min(len(word[a]), len(word[b]))
                if turned[at]:  # where both ways meet a pair, the forward one hands it on
                    if size != short - short // 2 or _shared_start(word[a], word[b]) >= short // 2:
                        continue
                elif size != short // 2:
                    continue
                found += [(word[a], n[a], word[b], n[b]), (word[b], n[b], word[a], n[a])]
        columns = zip(*found) if found else ((),) * 4
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of ``words`` (word, n), in both directions."""
    schema = "turned boolean, start string, rest string, word string, n long"
    entries = common.map_batches(words.select("word", "n"), _entries, schema)
    keys = ("turned", "start")
    blocks = common.paired_blocks(entries, keys, "word", block_words)
    return common.map_batches(common.grouped(blocks, (*keys, "_i", "_j")), _linked, "word string, n long, near string, near_n long")


# --- forms ------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last.

    Distances double, so six rounds of joins reach the end of any chain. Forms that many words
    share are salted, which repeats the looked-up side ``SALTS`` times.
    """
    at = common.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"), salts.alias("_salt"))
        salted = at.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        joined = salted.join(onward, ["root", "_salt"], "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        following = common.keep(joined)
        common.release(at)
        at = following
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text)."""
    words = common.keep(vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, block_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    chosen = common.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    common.release(words)
    ends = roots(chosen.filter("form IS NOT NULL"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
