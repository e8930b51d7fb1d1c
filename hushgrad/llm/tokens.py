"""Token ids and token counts of whole texts through caches of their parts.

Both vocabularies cut a text into parts before they merge anything, and no part crosses certain white space. So a
text's ids are its parts' ids in order, and a part seen before needs no second encoding. Each Python worker keeps
one bounded cache for as long as it lives.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread

#: Parts that one worker remembers, and the longest part it remembers.
CACHE_PARTS, CACHE_CHARS = 600_000, 48
#: Runs of white space or of other characters from this length on are left to the library itself: the faster one needs
#: a deep stack for the former and the square of their length for the latter.
LONG_RUN = 256
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
#: Stands between words that are encoded together. In the word vocabulary it is one token, a part of its own.
MARK = "\x01"
#: The split pattern of the byte-level vocabulary (a fixed value of that format).
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that follows white space and precedes white space or the end: there the text may not be cut.
_UNCUT = re.compile(r"\s (?:\s|\Z)")
#: White space other than ASCII's six characters, and separators that Python alone takes for white space.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteIds:
    """Ids of a byte-level vocabulary file as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        # The same vocabulary and merge order in the library that encodes short parts fastest; ids are equal.
        self._parts = tiktoken.Encoding("parts", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(path)
        self._cache = _Spaced(self._encode)

    def _encode(self, part: str) -> bytes:
        if len(part) >= LONG_RUN and _LONG_RUN.search(part):
            return self._by_library(part)
        return array("I", self._parts.encode_ordinary(part)).tobytes()

    def _by_library(self, text: str) -> bytes:
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._by_library(text)
        if _UNCUT.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self._cache.__getitem__, rest))


class _Spaced(dict):
    """Part without its leading space -> what encode() gives with it. Emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        out = self.encode(" " + part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = out
        return out


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


class WordCounts(dict):
    """Tokens of a word that white space bounds, for a vocabulary that drops white space: the worker's own tier."""

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        (self.mark,) = self.whole.encode(MARK, add_special_tokens=False).ids

    def whole_words(self) -> list[str]:
        """The words that the vocabulary itself holds whole, as text."""
        letters, end = _byte_letters(), "</w>"
        raw = (bytes(letters[c] for c in w[: -len(end)]) for w in self.whole.get_vocab(with_added_tokens=False) if w.endswith(end))
        words = (b.decode("utf-8", "ignore") for b in raw)
        return sorted({w for w in words if w and not w.isspace() and MARK not in w and words_of(w) == [w]})

    def __missing__(self, word: str) -> int:
        n = len(self.whole.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[word] = n
        return n

    def learn(self, words: set[str]) -> None:
        """Encodes words not yet known in one call: joined by marks, whose places in the ids tell the words apart."""
        new = [w for w in words if len(w) <= CACHE_CHARS and MARK not in w]
        if len(self) + len(new) > CACHE_PARTS:
            self.clear()
        if new:
            (e,) = self.whole.encode_batch_fast([f" {MARK} ".join(new)], add_special_tokens=False)
            ids = np.array(e.ids)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            self.update(zip(new, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))


def words_of(text: str) -> list[str]:
    """Words between ASCII white space; any other white space stays inside a word, where the library handles it."""
    return text.split() if _RARE_SPACE.search(text) is None else [w for w in _ASCII_SPACE.split(text) if w]


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)
