"""Secrets found by one combined automaton: all rules in one pass over the bytes.

The rules are compiled together (``automaton``). A batch of texts is cut into short lanes,
at text starts and at bytes that lead every state back to the start, so no match crosses a
cut; the lanes are then advanced in step, one array operation per byte position. A text
without such bytes is cut at any byte, and the beginning of a lane is repaired from the state
in which the lane before it ends. That pass gives the places where matches end. Their starts come from the automata of the reversed
rules, run backwards from the first accepting byte of each match.

Per kind the matches are leftmost and do not overlap; of those, the ones too short for their
rule are dropped. Every rule ends in a repeated class or a fixed byte, so a run of accepting
bytes is one match. Offsets are code points, ends exclusive.

Defined results: null text is empty and has no spans; repeated rows and null ids each get
their own row; texts of any length are scanned whole; an empty table gives no rows; other
columns are passed through by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm import common
from tallycast.llm.automaton import byte_kinds, compile_rules

LANE_BYTES = 384
LANES = 8192
LONG_LANES = 4  # a text that can't be cut at certain places for longer than this many lanes is cut at any byte


@dataclass(frozen=True)
class Rule:
    """``least`` bytes of the whole match, ``least_end`` of its closing repeated class."""

    kind: str
    pattern: str
    least: int = 0
    least_end: int = 0


# The three base kinds, in the order in which they are listed. Six repeats keep the hex
# rule quiet inside ordinary words; counting to its least length in the automaton would multiply the states.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", least_end=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{6,}", least=32),
)
# Kinds that this operator adds: token prefixes and key headers of well-known form.
ADDED = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        patterns = [rule.pattern for rule in rules]
        kinds = byte_kinds(patterns)
        self.rules = rules
        self.forward = compile_rules(patterns, kinds, search=True)
        self.backward = [compile_rules([pattern], kinds, search=False, reverse=True) for pattern in patterns]
        self.exact = [re.compile(pattern.encode("latin-1")) for pattern in patterns]

    def lanes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lane starts, which of them lie where the state is not known to be the start)."""
        size = len(data)
        cuts = np.flatnonzero(self.forward.resets[data]) + 1
        grid = np.searchsorted(cuts, np.arange(LANE_BYTES, size, LANE_BYTES))
        sure = np.unique(np.concatenate([offsets[:-1], cuts[grid[grid < len(cuts)]]]))
        sure = sure[sure < size]
        lengths = np.diff(np.append(sure, size))
        more = np.where(lengths > LONG_LANES * LANE_BYTES, (lengths - 1) // LANE_BYTES, 0)
        number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        starts = np.concatenate([sure, np.repeat(sure, more) + number * LANE_BYTES])
        order = np.argsort(starts, kind="stable")
        return starts[order], order >= len(sure)

    def bits(self, state: np.ndarray) -> np.ndarray:
        return self.forward.tags[state // self.forward.width]

    def run(self, kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every lane from the start state: its end state, and (place, rule bits) at its first byte and where bits change."""
        machine = self.forward
        ends = np.full(len(starts), machine.start, np.int32)
        order = np.argsort(-lengths, kind="stable")
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(order), LANES):
            lanes = order[at:at + LANES]
            begin, length = starts[lanes], lengths[lanes]
            state = np.full(len(lanes), machine.start, np.int32)
            before = np.ones(len(lanes), bool)
            active = len(lanes)
            left = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
            for step in range(int(length[0])):
                if left[step] < active:
                    ends[lanes[left[step]:active]] = state[left[step]:active]
                    active = int(left[step])
                    begin, state, before = begin[:active], state[:active], before[:active]
                last, state = state, machine.table[state + kinds[begin + step]]
                now = state >= machine.first_accepting
                either = now | before
                before = now
                if either.any():
                    spots = np.flatnonzero(either)
                    bits = self.bits(state[spots])
                    changed = (bits != self.bits(last[spots])) | (step == 0)
                    places.append(begin[spots[changed]] + step)
                    found.append(bits[changed])
            ends[lanes[:active]] = state
        return ends, np.concatenate(places), np.concatenate(found)

    def rerun(self, kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: np.ndarray):
        """Lanes run from ``entries`` and from the start state side by side, until both agree.

        Gives for each lane its end state (-1 if both agreed) and the bytes up to agreement, and
        (lane, place, rule bits) at its first byte, where bits change and where both agree.
        """
        machine = self.forward
        state, plain = entries.astype(np.int32), np.full(len(starts), machine.start, np.int32)
        stretch, agreed = lengths.copy(), np.zeros(len(starts), bool)
        owners, places, found = ([np.zeros(0, np.int64)] for _ in range(3))
        alive, step = np.arange(len(starts)), 0
        while len(alive):
            symbols, last = kinds[starts[alive] + step], state[alive]
            now, other = machine.table[last + symbols], machine.table[plain[alive] + symbols]
            state[alive], plain[alive] = now, other
            same, bits = now == other, self.bits(now)
            noted = same | (bits != self.bits(last)) | (step == 0)
            owners.append(alive[noted])
            places.append(starts[alive[noted]] + step)
            found.append(bits[noted])
            step += 1
            stretch[alive[same]], agreed[alive[same]] = step, True
            alive = alive[~same & (lengths[alive] > step)]
        return np.where(agreed, -1, state), stretch, np.concatenate(owners), np.concatenate(places), np.concatenate(found)

    def accepting(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte position, rule bits that hold from there to the next position), in order, at each text start as well.

        Lanes cut at any byte are first run from the start state, then repaired from the state in which the lane
        before them ends. A lane whose state outlives it hands it to the next one: the rest of the text is then run
        from that state at once, and from what its lanes hand on, so a long match costs two more passes and not one
        step after another.
        """
        machine, size = self.forward, len(data)
        kinds = machine.kind_of[data]
        starts, loose = self.lanes(data, offsets)
        lengths = np.diff(np.append(starts, size))
        plain, place, bits = self.run(kinds, starts, lengths)
        ends = plain.copy()
        stretch = np.zeros(len(starts), np.int64)  # bytes of a lane that its repair replaces
        parts = [(place, bits)]
        known: dict[tuple[int, int], tuple[int, int]] = {}  # (lane, entry): (try, number in it)
        tries: list[tuple] = []
        chosen: dict[int, tuple[int, int]] = {}

        def attempt(lanes: np.ndarray, entries: np.ndarray) -> None:
            known.update(zip(zip(lanes.tolist(), entries.tolist()), ((len(tries), i) for i in range(len(lanes)))))
            end, reach, *notes = self.rerun(kinds, starts[lanes], lengths[lanes], entries)
            tries.append((np.where(end < 0, plain[lanes], end), reach, *notes))

        last_of = np.append(np.flatnonzero(~loose), len(starts))  # where each chain of loose lanes ends
        guess = np.flatnonzero(loose & (np.append(machine.start, plain[:-1]) != machine.start))
        if len(guess):
            attempt(guess, plain[guess - 1])
        waiting = np.flatnonzero(loose & ~np.append(False, loose[:-1])).tolist()
        while waiting:
            missed = []
            for lane in waiting:
                while lane < len(starts) and loose[lane]:
                    entry = int(ends[lane - 1])
                    if entry != machine.start:
                        where = known.get((lane, entry))
                        if where is None:
                            missed.append(lane)
                            break
                        chosen[lane] = where
                        ends[lane] = tries[where[0]][0][where[1]]
                    lane += 1
            if missed:
                rest = [np.arange(lane, last_of[np.searchsorted(last_of, lane)]) for lane in missed]
                follows = np.concatenate([np.arange(len(r)) > 0 for r in rest])
                lanes = np.concatenate(rest)
                attempt(lanes, np.concatenate([np.full(len(r), ends[lane - 1]) for r, lane in zip(rest, missed)]))
                following = np.flatnonzero(follows)  # from the states that lanes run so hand on
                if len(following):
                    attempt(lanes[following], tries[-1][0][following - 1])
            waiting = missed
        if chosen:
            lanes = np.array(list(chosen))
            which, number = np.array(list(chosen.values())).T
            for i, (_, reach, owner, at, found) in enumerate(tries):
                used = np.zeros(len(reach), bool)
                used[number[which == i]] = True
                stretch[lanes[which == i]] = reach[number[which == i]]
                parts.append((at[used[owner]], found[used[owner]]))
            lane = np.searchsorted(starts, place, side="right") - 1
            stays = place >= starts[lane] + stretch[lane]
            parts[0] = place[stays], bits[stays]
        place, bits = (np.concatenate(part) for part in zip(*parts))
        order = np.argsort(place)
        return place[order], bits[order]

    def leftmost(self, rule: int, data: np.ndarray, ends: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """The leftmost start, not before ``floors``, of a match whose last byte is at ``ends``."""
        machine = self.backward[rule]
        best, at = ends.copy(), ends.copy()
        lanes = np.arange(len(ends))
        state = np.full(len(ends), machine.start, np.int32)
        while len(lanes):
            state = machine.table[state + machine.kind_of[data[at[lanes]]]]
            accepted = lanes[state >= machine.first_accepting]
            best[accepted] = at[accepted]
            alive = (state != machine.dead) & (at[lanes] > floors[lanes])
            lanes, state = lanes[alive], state[alive]
            at[lanes] -= 1
        return best

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, start, end, rule) in bytes, ordered by document, start, rule."""
        place, bits = self.accepting(data, offsets)
        docs = np.searchsorted(offsets, place, side="right") - 1
        new_doc = np.append(True, docs[1:] != docs[:-1])[:len(docs)]
        after = np.append(place, len(data))
        raw = None
        found = []
        for number, rule in enumerate(self.rules):
            on = bits >> number & 1 == 1
            fresh = np.flatnonzero(on & (new_doc | ~np.append(False, on[:-1])[:len(on)]))
            if not len(fresh):
                continue
            breaks = np.append(np.flatnonzero(~on | new_doc), len(place))
            first, doc = place[fresh], docs[fresh]
            end = after[breaks[np.searchsorted(breaks, fresh, side="right")]]
            start = self.leftmost(number, data, first, offsets[doc])
            free = (-1, 0)  # document and byte from which a match may start
            for d, s, f, e in zip(doc.tolist(), start.tolist(), first.tolist(), end.tolist()):
                if free[0] == d and s < free[1]:  # overlaps the match before it: the next start, if any
                    raw = data.tobytes() if raw is None else raw
                    again = self.exact[number].search(raw, free[1], e)
                    if not again:
                        continue
                    s = again.start()
                    f = next(p for p in range(s, e) if self.exact[number].fullmatch(raw, s, p + 1))
                free = (d, e)
                if e - s >= rule.least and e - f >= rule.least_end:
                    found.append((d, s, e, number))
        return sorted(found, key=lambda item: (item[0], item[1], item[3]))


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once, on the driver; under a megabyte, it travels with the tasks."""
    return Scanner(rules)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each); null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _by_document(column: pa.Array, machine: Scanner) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, [(start, end, rule)]) in code points, for rows with a match."""
    if not len(column):
        return
    data, offsets = _buffers(column)
    current, item = -1, []
    for doc, start, end, number in machine.spans(data, offsets):
        if doc != current:
            if item:
                yield current, item
            current, item = doc, []
            begins = np.cumsum((data[offsets[doc]:offsets[doc + 1]] & 0xC0) != 0x80)
        before = [int(begins[at - offsets[doc] - 1]) if at > offsets[doc] else 0 for at in (start, end)]
        item.append((before[0], before[1], number))
    if item:
        yield current, item


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): for every row the spans (kind, start, end) by start, then kind as listed."""
    machine = scanner(rules)

    def work(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            ids, text = common.columns(batch, "doc_id", "text")
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, spans in _by_document(text, machine):
                found[row] = [{"kind": rules[n].kind, "start": a, "end": b} for a, b, n in spans]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return common.map_batches(docs.select("doc_id", "text"), work, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span in ``text`` replaced by its kind in brackets; overlapping spans as one."""
    machine, names = scanner(rules), docs.columns

    def work(batches):
        for batch in batches:
            doc, column = common.columns(batch, "_doc", "text")
            values = column.to_pylist()
            for row, spans in _by_document(column, machine):
                text, parts, done = values[row], [], 0
                for start, end, number in spans:
                    if start >= done:
                        parts += [text[done:start], f"[{rules[number].kind}]"]
                    done = max(done, end)
                values[row] = "".join([*parts, text[done:]])
            yield pa.RecordBatch.from_arrays([doc, pa.array(values, column.type)], ["_doc", "text"])

    packed = docs.select(F.struct(*[f"`{name}`" for name in names]).alias("_doc"), "text")
    cleaned = common.map_batches(packed, work, packed.schema)
    return cleaned.select(*[F.col("text") if name == "text" else F.col("_doc")[name].alias(name) for name in names])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, from ``scan``."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin([rule.kind for rule in BASE]))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )
