"""Licence statements found by ordered signature rules (``license_rules``), gated by keywords.

A text is reduced to its words, joined by single blanks. A rule is tried only on texts that hold all
words any of its matches contains. Detections are resolved by priority: one that lies within a
kept detection of the same or a higher rank is suppressed; at equal places the rule written first
stays. Ranks are settled one after the other against running maxima of ends, so texts with many detections
take no pairwise comparison. The base phrases are rules that nothing suppresses.

The score is the strength of the highest rank that is kept, zero without any detection.

Defined results: null and empty texts have no words, null places, empty labels and score zero; repeated
rows and rows without an id get rows of their own; texts of any length are read whole; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tallycast.llm import common
from tallycast.llm.license_rules import SIGNATURES

# The base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
STRENGTHS = {0: 0.75, 1: 1.0, 2: 0.95, 3: 0.9, 4: 0.75, 5: 0.5, 6: 0.25}
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "detections string")


@dataclass(frozen=True)
class Rule:
    """Priority 0 is that of a base phrase, which is always kept."""

    label: str
    priority: int
    keywords: frozenset[bytes]
    pattern: re.Pattern[bytes]


@dataclass(frozen=True)
class Detection:
    """Words from ``start`` to before ``end``."""

    start: int
    end: int
    rule: Rule


def _rule(label: str, priority: int, keywords: list[str], regex: str) -> Rule:
    return Rule(label, priority, frozenset(word.encode() for word in keywords), re.compile(f"(?<= )(?:{regex})(?= )".encode()))


@cache
def rules() -> tuple[Rule, ...]:
    """The base phrases, then the signatures in the order in which they are written."""
    found = [_rule(label, 0, phrase.split(), phrase) for label, phrase in BASE]
    label = ""
    for line in SIGNATURES.strip().splitlines():
        if not line.startswith(" "):
            label = line
            continue
        priority, keywords, regex = line.split(None, 2)
        found.append(_rule(label, int(priority), keywords.split("+"), regex))
    return tuple(found)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(LETTERS).split()


def matches(words: list[bytes], chosen: list[Rule]) -> list[Detection]:
    """All matches of the chosen rules, places counted in words; those of a rule do not overlap."""
    joined = b" " + b" ".join(words) + b" "
    raw = sorted(((m.start(), m.end(), number) for number, rule in enumerate(chosen) for m in rule.pattern.finditer(joined)))
    found, at, blanks = [], 0, 0
    for start, end, number in raw:
        blanks += joined.count(b" ", at, start)
        at = start
        found.append(Detection(blanks - 1, blanks + joined.count(b" ", start, end), chosen[number]))
    return found


def resolve(found: list[Detection], order: dict[Rule, int]) -> list[Detection]:
    """Kept detections by place. ``order`` ranks rules of one priority at equal places."""
    kept = [d for d in found if d.rule.priority == 0]
    settled: list[Detection] = []
    for priority in sorted({d.rule.priority for d in found} - {0}):
        settled.sort(key=lambda d: d.start)
        starts = [d.start for d in settled]
        reach = list(accumulate((d.end for d in settled), max))
        own_reach, added = -1, []
        for d in sorted((d for d in found if d.rule.priority == priority), key=lambda d: (d.start, -d.end, order[d.rule])):
            above = bisect_right(starts, d.start)
            if d.end > own_reach and not (above and reach[above - 1] >= d.end):
                own_reach = d.end
                added.append(d)
        settled += added
    return sorted(kept + settled, key=lambda d: (d.start, d.end, order[d.rule]))


class Scanner:
    def __init__(self, chosen: tuple[Rule, ...]) -> None:
        self.order = {rule: number for number, rule in enumerate(chosen)}
        self.gates: dict[bytes, list[Rule]] = {}
        for rule in chosen:  # found by one of its words, the rest is looked up then
            self.gates.setdefault(min(rule.keywords), []).append(rule)
        self.keywords = frozenset(word for rule in chosen for word in rule.keywords)

    def scan(self, text: bytes) -> tuple[int, list[Detection]]:
        """(number of words, kept detections)."""
        words = words_of(text)
        present = self.keywords.intersection(words)
        chosen = [rule for word in present for rule in self.gates.get(word, ()) if rule.keywords <= present]
        return len(words), resolve(matches(words, chosen), self.order) if chosen else []


@cache
def scanner() -> Scanner:
    return Scanner(rules())


def _row(text: bytes) -> tuple:
    size, found = scanner().scan(text)
    base = [d for d in found if d.rule.priority == 0]
    labels, base_labels = ({d.rule.label for d in part} for part in (found, base))
    return (
        size, len(base), base[0].start if base else None, base[-1].start if base else None,
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), max((STRENGTHS[d.rule.priority] for d in found), default=0.0),
        ",".join(f"{d.rule.label}:{d.start}:{d.end}" for d in found),
    )


def _scanned(batches):
    types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), pa.string())
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    for batch in batches:
        ids, text = common.columns(batch, "doc_id", "text")
        rows = [_row(value) for value in common.texts(text)]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], names)


def scan(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): its words, base phrases, labels, score and kept detections."""
    return common.map_batches(docs.select("doc_id", "text"), _scanned, SCHEMA)
