"""Rule regexes compiled into one deterministic automaton over bytes, as transition arrays.

Patterns may use literals, ``[classes]`` with ranges and ``^``, escapes (``\\xHH`` too),
``(groups)``, ``(?i:groups)`` whose letters match in either case, ``|``, ``?``, ``*``,
``+``, ``{m}``, ``{m,}`` and ``{m,n}``. They are turned into one nondeterministic automaton,
made deterministic by subset construction and minimised by partition refinement.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1


def _bit(byte: int) -> int:
    return 1 << byte


class _Parser:
    """Recursive descent; a node is ('set', mask), ('seq', nodes), ('alt', nodes) or ('rep', node, low, high)."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at, self.either_case = pattern.encode("latin-1"), 0, False

    def peek(self) -> bytes:
        return self.pattern[self.at:self.at + 1]

    def take(self) -> int:
        self.at += 1
        return self.pattern[self.at - 1]

    def whole(self):
        node = self.alternatives()
        if self.at != len(self.pattern):
            raise ValueError(f"unexpected {self.peek()!r} in {self.pattern!r}")
        return node

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == b"|":
            self.at += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in (b"", b"|", b")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while self.peek() in (b"?", b"*", b"+", b"{") and self.peek():
            sign = self.take()
            if sign == ord("{"):
                end = self.pattern.index(b"}", self.at)
                low, _, high = self.pattern[self.at:end].partition(b",")
                bounded = b"," not in self.pattern[self.at:end] or high
                self.at = end + 1
                node = ("rep", node, int(low), int(high or low) if bounded else None)
            else:
                node = ("rep", node, int(sign == ord("+")), 1 if sign == ord("?") else None)
        return node

    def atom(self):
        byte = self.take()
        if byte == ord("("):
            outer = self.either_case
            if self.pattern.startswith(b"?i:", self.at):
                self.at += 3
                self.either_case = True
            node = self.alternatives()
            self.either_case = outer
            self.at += 1  # the closing bracket
            return node
        if byte == ord("["):
            return ("set", self.cased(self.members()))
        if byte == ord("."):
            return ("set", ALL & ~_bit(10))
        return ("set", self.cased(_bit(self.escaped() if byte == ord("\\") else byte)))

    def escaped(self) -> int:
        byte = self.take()
        if byte == ord("x"):
            self.at += 2
            return int(self.pattern[self.at - 2:self.at], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(byte, byte)

    def members(self) -> int:
        inverse = self.peek() == b"^"
        self.at += inverse
        mask = 0
        while self.peek() != b"]":
            low = self.take()
            low = self.escaped() if low == ord("\\") else low
            high = low
            if self.peek() == b"-" and self.pattern[self.at + 1:self.at + 2] != b"]":
                self.at += 1
                high = self.take()
                high = self.escaped() if high == ord("\\") else high
            for byte in range(low, high + 1):
                mask |= _bit(byte)
        self.at += 1
        return ALL & ~mask if inverse else mask

    def cased(self, mask: int) -> int:
        if self.either_case:
            for upper in range(65, 91):
                if mask & (_bit(upper) | _bit(upper + 32)):
                    mask |= _bit(upper) | _bit(upper + 32)
        return mask


class _Graph:
    """Nondeterministic automaton: edges by byte mask, and empty steps."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[int, int]]] = []
        self.steps: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.steps.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """Lay ``tree`` after ``start`` and return where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.edges[start].append((tree[1], end))
            return end
        if kind == "seq":
            for part in reversed(tree[1]) if reverse else tree[1]:
                start = self.add(part, start, reverse)
            return start
        if kind == "alt":
            end = self.node()
            for option in tree[1]:
                self.steps[self.add(option, start, reverse)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start, reverse)
        if high is None:
            loop = self.node()
            self.steps[start].append(loop)
            self.steps[self.add(part, loop, reverse)].append(loop)
            end = self.node()
            self.steps[loop].append(end)
            return end
        end = self.node()
        self.steps[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start, reverse)
            self.steps[start].append(end)
        return end

    def closure(self, nodes) -> frozenset[int]:
        found, waiting = set(nodes), list(nodes)
        while waiting:
            for following in self.steps[waiting.pop()]:
                if following not in found:
                    found.add(following)
                    waiting.append(following)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[state + kind_of[byte]]`` is the next state; states are multiples of the number of byte kinds.

    States from ``first_accepting`` up accept; ``tags[state // width]`` has a bit for each
    rule that matches there. ``resets`` marks the bytes that lead every state to the start.
    """

    kind_of: np.ndarray
    table: np.ndarray
    width: int
    start: int
    dead: int
    first_accepting: int
    tags: np.ndarray
    resets: np.ndarray


def byte_kinds(patterns: list[str]) -> tuple[np.ndarray, int]:
    """Bytes that no pattern tells apart share a kind."""
    masks: set[int] = set()

    def walk(tree) -> None:
        if tree[0] == "set":
            masks.add(tree[1])
        for part in (tree[1] if tree[0] in ("seq", "alt") else [tree[1]] if tree[0] == "rep" else []):
            walk(part)

    for pattern in patterns:
        walk(_Parser(pattern).whole())
    ordered = sorted(masks)
    signatures: dict[tuple, int] = {}
    kinds = [signatures.setdefault(tuple(m >> b & 1 for m in ordered), len(signatures)) for b in range(256)]
    return np.array(kinds, np.uint8), len(signatures)


def compile_rules(patterns: list[str], kinds: tuple[np.ndarray, int], search: bool, reverse: bool = False) -> Automaton:
    """One automaton for all ``patterns``; with ``search`` a match may start at any byte."""
    kind_of, width = kinds
    graph = _Graph()
    starts, ends = [], {}
    for number, pattern in enumerate(patterns):
        start = graph.node()
        starts.append(start)
        ends[graph.add(_Parser(pattern).whole(), start, reverse)] = number
    member = [int(np.flatnonzero(kind_of == kind)[0]) for kind in range(width)]

    first = graph.closure(starts)
    numbers, sets, rows = {first: 0}, [first], []
    for current in sets:  # grows while it is read
        row = []
        for byte in member:
            reached = {end for node in current for mask, end in graph.edges[node] if mask >> byte & 1}
            following = graph.closure(reached) | first if search else graph.closure(reached)
            if following not in numbers:
                numbers[following] = len(sets)
                sets.append(following)
            row.append(numbers[following])
        rows.append(row)
    table = np.array(rows, np.int64)
    tags = np.array([sum(1 << ends[node] for node in nodes if node in ends) for nodes in sets], np.int64)
    empty = np.array([not nodes for nodes in sets])

    block = np.unique(tags, return_inverse=True)[1].reshape(-1)  # Moore's refinement
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    one_of = np.unique(block, return_index=True)[1]
    order = np.lexsort((one_of, tags[one_of] != 0))  # accepting states last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    chosen = one_of[order]
    small = place[block[table[chosen]]]
    start = int(place[block[0]])
    dead = int(place[block[np.flatnonzero(empty)[0]]]) if empty.any() else -1
    first_accepting = int((tags[chosen] == 0).sum())
    resets = (small == start).all(axis=0)[kind_of]
    return Automaton(kind_of, (small * width).astype(np.int32).reshape(-1), width, start * width, dead * width,
                     first_accepting * width, tags[chosen], resets)
