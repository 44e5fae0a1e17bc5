"""Token ids of whole texts, with repeated chunks encoded once.

The tokenizer drops white space before it looks for words, so a text may be cut at blanks and
line ends without changing its ids. Each chunk is encoded the first time a worker meets it and
looked up after that; memory is bounded by ``CACHED`` chunks.

In texts of plain Latin letters, digits and punctuation (without the signs that have rules of
their own) the words are runs of letters, single digits and runs of signs, and normalising
changes nothing but case; these words go straight to the tokenizer's own merge model. Other
texts are cut at blanks, and the chunks go through the whole tokenizer.

All this holds for tokenizers with the rules below, which are looked for in the file. With any other file
each whole text goes through its tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

CACHED = 800_000
TEXT_AT_ONCE = 1 << 20
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"""!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"""  # without ' (splits off endings) and < (opens control strings)
PLAIN = re.compile(f"[{LETTERS}{SIGNS}0-9 \n]*")
WORDS = re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+")

# The rules, as tokenizer files write them, for which texts may be cut into words and chunks.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
     "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def words_are_separate(rules: dict) -> bool:
    """Whether the ids of a text are those of its words, so that it may be cut at blanks.

    Its control strings must start with < and hold no white space, as the cuts look out for that sign only.
    """
    controls = [token["content"] for token in rules.get("added_tokens") or []]
    return (
        rules.get("normalizer") == NORMALIZER
        and rules.get("pre_tokenizer") == PRE_TOKENIZER
        and rules["model"].get("dropout") is None
        and all(text.startswith("<") and not re.search(r"\s", text) for text in controls)
    )


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level models put for the UTF-8 bytes of U+0080 to U+00FF."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {cp: "".join(shown[b] for b in chr(cp).encode()) for cp in range(128, 256)}


class Encoder:
    """Encodes texts with a tokenizer whose file is at ``path``.

    With ``ordinary`` the strings of control tokens inside a text are text like any other.
    """

    def __init__(self, path: str, ordinary: bool = False, cached: int = CACHED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.cuts = words_are_separate(json.loads(self.tokenizer.to_str()))
        self.cached = cached
        self.model = self.tokenizer.model
        self.shown = _byte_characters()
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)  # one more than there are chunks

    def _learn(self, chunks: Sequence[str], plain: bool) -> None:
        fresh = [chunk for chunk in dict.fromkeys(chunks) if chunk not in self.place]
        if plain:
            coded = [[token.id for token in self.model.tokenize(chunk.translate(self.shown))] for chunk in fresh]
        else:
            coded = [self.tokenizer.encode(chunk[1:], add_special_tokens=False).ids for chunk in fresh]
        first, begin = len(self.place), self.starts[len(self.place)]
        ends = begin + np.cumsum([len(ids) for ids in coded])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(fresh) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[begin:ends[-1]] = list(chain.from_iterable(coded))
        self.starts[first + 1:first + 1 + len(fresh)] = ends
        self.place.update(zip(fresh, range(first, first + len(fresh))))

    def _ids(self, chunks: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many of each)."""
        if len(self.place) > self.cached:
            self.reset()
        get = self.place.__getitem__
        try:
            found = list(map(get, chunks))
        except KeyError:
            self._learn(chunks, plain)
            found = list(map(get, chunks))
        found = np.array(found, np.int64)
        begin, count = self.starts[found], self.starts[found + 1] - self.starts[found]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(begin - upto + count, count) + np.arange(total)
        return self.flat[at], count

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; about ``TEXT_AT_ONCE`` characters are worked on at a time."""
        if not self.cuts:
            for text in texts:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            return
        waiting: list[list[str]] = []
        size, kind = 0, True
        for text in texts:
            plain = PLAIN.fullmatch(text) is not None
            if waiting and (size > TEXT_AT_ONCE or plain != kind):
                yield from self._several(waiting, kind)
                waiting, size = [], 0
            kind = plain
            if len(text) > TEXT_AT_ONCE:
                yield from self._several(waiting, kind)
                waiting, size = [], 0
                yield np.concatenate([self._ids(_chunks(piece, kind), kind)[0] for piece in _pieces(text)])
            else:
                waiting.append(_chunks(text, kind))
                size += len(text)
        yield from self._several(waiting, kind)

    def _several(self, texts: list[list[str]], plain: bool) -> Iterator[np.ndarray]:
        if texts:
            ids, count = self._ids([chunk for chunks in texts for chunk in chunks], plain)
            ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(chunks) for chunks in texts])]
            yield from np.split(ids, ends[:-1])


def _chunks(text: str, plain: bool) -> list[str]:
    """Words of a plain text; else what stands between blanks, marked as such by a blank before it."""
    if plain:
        return WORDS.findall(text.lower())
    return [" " + chunk for chunk in text.replace("\n", " ").split(" ") if chunk]


def _pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that end at a blank or line end, if it has any."""
    at = 0
    while len(text) - at > TEXT_AT_ONCE:
        cut = max(text.rfind(" ", at, at + TEXT_AT_ONCE), text.rfind("\n", at, at + TEXT_AT_ONCE))
        if cut < at:
            found = re.compile("[ \n]").search(text, at)
            if not found:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str, ordinary: bool = False, cached: int = CACHED) -> Encoder:
    """One per worker process and tokenizer file."""
    return Encoder(path, ordinary, cached)
