"""Byte-level BPE by prefix dynamic programming, exact under appending and editing.

A sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of their
own bytes. So every prefix of a piece has one valid last token: the suffix token that follows validly on the
last token of the prefix before it. The last tokens of all prefixes give the encoding by walking back, an
append continues the table, and an edit keeps the table up to its first byte. New pieces begin like known
ones, so last tokens are kept by prefix and only the new bytes are worked out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import frame, texts
from lumenlog.llm.pieces import Bounded, PieceCoder

#: Prefixes and token pairs that are kept, each at most.
KEPT = 400_000


class Ranks:
    """Tokens with their ranks, and which tokens may follow which."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        # by the last one, two or three bytes, the lengths that tokens ending so have, longest first
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            for tail in {token[-1:], token[-2:], token[-3:]}:
                ends.setdefault(tail, set()).add(len(token))
        for tail, found in ends.items():  # tokens shorter than the bytes looked at
            found.update(n for n in range(1, len(tail)) if tail[-n:] in self.ids)
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in ends.items()}
        self.pairs = Bounded(None, KEPT, 0)
        self.last = Bounded(None, KEPT, 0)
        self.lens = [len(t) for t in self.tokens]
        sizes = np.array(self.lens, np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a short byte string by its definition: the lowest-ranked pair is merged, leftmost first."""
        get, none = self.ids.get, len(self.tokens)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return [self.ids[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` are the encoding of their own bytes; a left of -1 is the start."""
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            data = (self.tokens[left] if left >= 0 else b"") + self.tokens[right]
            known = self.merged(data) == ([left, right] if left >= 0 else [right])
            self.pairs.keep(key, known)
        return known

    def lengths_at(self, data: bytes, end: int) -> list[int]:
        """The lengths that a last token of ``data[:end]`` may have, longest first, by its last three bytes."""
        for n in (3, 2, 1):
            found = self.lengths.get(data[max(end - n, 0) : end])
            if found is not None:
                return found
        return []

    def last_token(self, data: bytes, end: int, before: list[int]) -> int:
        """The last token of ``data[:end]``, given those of all shorter prefixes."""
        for length in self.lengths_at(data, end):
            if length <= end:
                token = self.ids.get(data[end - length : end])
                if token is not None and self.follows(before[end - length], token):
                    return token
        raise ValueError("no token for a byte")

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last``, the last tokens of the prefixes of ``data`` so far, continued to all of it."""
        for end in range(len(last), len(data) + 1):
            last.append(self.last_token(data, end, last))
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def asked(self, data: bytes, end: int, last: list[int | None]) -> int:
        """The last token of ``data[:end]``; of shorter prefixes, only those it rests on are worked out into ``last``."""
        prefix = data[:end]
        found = self.last.get(prefix)
        if found is None:
            ids, pairs = self.ids, self.pairs
            for length in self.lengths_at(data, end):
                if length > end:
                    continue
                start = end - length
                token = ids.get(data[start:end])
                if token is None:
                    continue
                left = last[start]
                if left is None:
                    left = self.asked(data, start, last)
                fits = pairs.get((left + 1) << 32 | token)
                if self.follows(left, token) if fits is None else fits:
                    found = token
                    break
            else:
                raise ValueError("no token for a byte")
            self.last.keep(prefix, found)
        last[end] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """The encoding of one piece; prefixes seen before are not worked out again, and those nothing rests on never."""
        if len(data) > 64:  # a long piece has its own table
            return self.walk(self.extend(data, [-1]))
        out, at = [], len(data)
        last: list[int | None] = [-1, *[None] * at]
        sizes = self.lens
        while at:
            token = last[at]
            if token is None:
                token = self.asked(data, at, last)
            out.append(token)
            at -= sizes[token]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: each output byte is looked up in the joined tokens."""
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.bytes[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()


class Piece:
    """An encoded piece that can be appended to and edited without encoding all of it again."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.ranks.extend(self.data, self.last)

    def edit(self, start: int, stop: int, data: bytes) -> None:
        """Replace bytes ``start`` to ``stop``: last tokens up to the edit stay, those after are worked out anew."""
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start + 1 :]
        self.ranks.extend(self.data, self.last)

    def ids(self) -> list[int]:
        return self.ranks.walk(self.last)


@functools.cache
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@functools.cache
def coder(path: str, pattern: str) -> PieceCoder:
    """The cached coder of a rank file; one for each Python worker."""
    ranks = ranks_of(path)

    def piece(text: str) -> bytes:
        ids = ranks.encode_piece(text.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    return PieceCoder(pattern, piece)


def _each(docs: DataFrame, path: str, pattern: str, make: Callable[[Ranks, bytes], tuple], schema: str) -> DataFrame:
    """(doc_id, what ``make`` gives for the ids of the whole text) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ranks = coder(path, pattern), ranks_of(path)
        for batch in batches:
            yield frame([(key, *make(ranks, own.encode(text))) for key, text in texts(batch)], columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the whole text's ids, little-endian unsigned 32-bit.

    Null texts count as empty and have no ids; a null id stays null; repeated rows give equal rows; no rows give
    no rows. Texts and pieces may be of any length. Other columns are ignored.
    """
    return _each(docs, path, pattern, lambda ranks, ids: (ids,), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, data) of (doc_id, ids): the bytes that the ids stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = ranks_of(path)
        for batch in batches:
            yield batch.assign(data=[ranks.decode(np.frombuffer(ids, "<u4")) for ids in batch["ids"]])

    return encoded.mapInPandas(run, "doc_id long, ids binary, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of ``encode``, and of what they decode to.

    ``ids_sha256`` is of the decimal ids joined by commas. Ids and bytes stay in the task that makes them.
    """

    def digest(ranks: Ranks, ids: bytes) -> tuple:
        values = np.frombuffer(ids, "<u4")
        decimal = ",".join(map(str, values.tolist())).encode()
        return len(values), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(ranks.decode(values)).hexdigest()

    return _each(docs, path, pattern, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
