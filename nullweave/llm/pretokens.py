"""Blocks of documents as distinct pre-tokens plus index arrays.

The three token operators (BPE, token ids, token counts) split texts by the
same public pattern.  A block of documents becomes the list of pre-tokens that
are new to the task and, for each document, positions into the task's list.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import numpy as np
import regex

# Texts of Latin-1 characters go through the stdlib engine with plain classes (fixed values: the pattern's letters,
# numbers and spaces below U+0100); those with the numbers that class \\p{N} adds to the digits, or other separators, don't.
_LETTER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "\\t-\\r \x85\xa0"
_FAST = re.compile(f" ?[{_LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_LETTER}{_SPACE}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NOT_FAST = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])


class Splitter:
    """findall of the public pattern; plain Latin and Cyrillic texts go through the faster stdlib engine."""

    def __init__(self, pattern: str):
        import public_tokenizers

        self.slow = regex.compile(pattern)
        self.same = pattern == public_tokenizers.PATTERN

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.same:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                return self.slow.findall(text)
            if len(raw.translate(None, _NOT_FAST)) == len(raw):
                return _FAST.findall(text)
        return self.slow.findall(text)


class Indexer:
    """Numbers pre-tokens in order of first sight; `reset` starts over when too many are held."""

    def __init__(self, split, limit: int = 600_000):
        self.split, self.limit = split, limit
        self._restart()

    def _restart(self):
        self.ids, self.reset = defaultdict(itertools.count().__next__), True

    def block(self, texts):
        """(reset, new pre-tokens, int32 indices of all texts, lengths by text)"""
        if len(self.ids) > self.limit:
            self._restart()
        reset, self.reset = self.reset, False
        known = len(self.ids)
        parts = list(map(self.split, texts))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(map(self.ids.__getitem__, itertools.chain.from_iterable(parts)), np.int32, int(lengths.sum()))
        return reset, list(itertools.islice(self.ids, known, None)), flat, lengths
