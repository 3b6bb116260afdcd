"""Cutting texts into pieces that a byte-level BPE encodes independently, with bounded caches.

A pre-tokenizer match holds a space only as its first character, or in a run of white space. A text may
therefore be cut before every single space that stands between two other characters, and the parts may be
encoded one by one: the ids are those of the whole text. Words repeat, so most parts come from the cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

_CUT = re.compile(r"(?<=\S)(?= \S)")
_PUNCTUATION = frozenset(".,;:!?")


class Irregular(Exception):
    """A part is empty or ends with white space, so it depends on its neighbour."""


class Bounded(dict):
    """A cache that computes what it lacks. When full it keeps what it has, and starts anew after many misses."""

    def __init__(self, compute: Callable, limit: int, longest: int):
        super().__init__()
        self.compute, self.limit, self.longest, self.missed = compute, limit, longest, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) < self.limit:
            self[key] = value
            return
        self.missed += 1
        if self.missed >= 16 * self.limit:
            self.clear()
            self.missed = 0


class PieceCoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``encode_piece`` maps one match of ``pattern`` to such bytes. Caches hold at most ``limit`` entries each,
    of at most ``longest`` characters.
    """

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], limit: int = 450_000, longest: int = 32):
        self.findall = regex.compile(pattern).findall
        self.encode_piece = encode_piece
        self.pieces = Bounded(encode_piece, limit, longest)
        self.parts = Bounded(self._spaced, limit, longest)  # by what follows the space; words are kept here alone

    def _match(self, part: str) -> bytes:
        if part[:1] == " " and not part[-1].isspace():
            return self.parts[part[1:]]
        pieces = self.pieces
        if part.isalpha():
            return pieces[part]
        if part and part[-1] in _PUNCTUATION and part[:-1].isalpha():
            return pieces[part[:-1]] + pieces[part[-1]]
        return b"".join([pieces[x] for x in self.findall(part)])

    def _spaced(self, part: str) -> bytes:
        if part.isalpha():
            return self.encode_piece(" " + part)
        if not part or part[-1].isspace():
            raise Irregular
        if part[-1] in _PUNCTUATION and part[:-1].isalpha():
            return self.parts[part[:-1]] + self.pieces[part[-1]]
        found = self.findall(" " + part)
        return b"".join([self.parts[x[1:]] if x[0] == " " and x[1:].isalpha() else self.pieces[x] for x in found])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Irregular
            return self._match(first) + b"".join(map(self.parts.__getitem__, rest))
        except Irregular:
            return b"".join([self._match(part) for part in _CUT.split(text)])
