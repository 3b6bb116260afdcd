"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: a segment holds the words of some million words of documents, one row a term
with its positions, so building it moves nothing. Documents stand one after another on a segment's line of
positions, with a free position between them, so a phrase never runs over a document's end. Positions are
differences in variable-length bytes.

A benchmark window is looked up in each segment from its rarest term: its positions, less the term's offset,
are candidates, and each further term, the next rarest first, keeps those at whose offset it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import frame, stored, texts
from lumenlog.llm.varints import pack, unpack

#: Words of a segment, about: a segment ends with the document that reaches this number.
SEGMENT = 4_000_000
#: Benchmark words that are looked up at once; a larger benchmark is looked up in blocks of items.
BLOCK_WORDS = 1_000_000
WINDOW = 10
INDEX = "segment long, term binary, n long, postings binary, doc_ids array<long>, starts binary, keys array<binary>"
FOUND = "segment long, place long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, n_near long, key binary"

#: Upper-case letters become lower-case ones; other ASCII characters that aren't letters or digits become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def build_index(docs: DataFrame, segment_words: int = SEGMENT, name: str = "positions", key: Column | None = None) -> DataFrame:
    """The stored index of every row of ``docs`` (doc_id, text).

    A term's row has ``term``, its number of positions ``n`` and ``postings``. Each segment has one row without
    a term: its documents in order, and their starts on the line, 64-bit, one more than there are documents,
    and the binary ``key`` of each row, null without one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = TaskContext.get().partitionId() << 24
        codes: dict[bytes, int] = {}
        keys: list[int | None] = []
        marks: list[bytes | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            lengths = np.array([len(p) for p in parts], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + 1)))
            yield frame([(segment, None, -1, None, keys, starts.astype("<i8").tobytes(), marks)], columns, ())
            if not codes:
                return
            stream = np.concatenate(parts)
            line = np.arange(len(stream)) + np.repeat(np.arange(len(parts)), lengths)
            line = line[np.argsort(stream, kind="stable")]
            counts = np.bincount(stream, minlength=len(codes))
            heads = np.cumsum(counts) - counts
            steps = np.diff(line, prepend=0)
            steps[heads] = line[heads]
            data, sizes = pack(steps)
            stops = np.cumsum(np.add.reduceat(sizes, heads)).tolist()
            blob = data.tobytes()
            terms, counts = list(codes), counts.tolist()
            for top in range(0, len(terms), 50_000):
                cut = range(top, min(top + 50_000, len(terms)))
                rows = [(segment, terms[i], counts[i], blob[stops[i - 1] if i else 0 : stops[i]], None, None, None) for i in cut]
                yield frame(rows, columns, ())

        for batch in batches:
            for (doc_id, text), mark in zip(texts(batch), batch["key"]):
                found = words(text)
                parts.append(np.array([codes.setdefault(w, len(codes)) for w in found], np.int32))
                keys.append(doc_id)
                marks.append(mark)
                size += len(found) + 1
                if size >= segment_words:
                    yield from flush()
                    segment, size = segment + 1, 0
                    codes, keys, marks, parts = {}, [], [], []
        if keys:
            yield from flush()

    columns = [c.split()[0] for c in INDEX.split(", ")]
    mark = (F.lit(None) if key is None else key).cast("binary").alias("key")
    return stored(docs.select(F.col("doc_id").cast("long"), "text", mark).mapInPandas(run, INDEX), name)


class Windows:
    """The distinct windows of benchmark items and the items they belong to."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.items: dict[tuple[bytes, ...], list[str]] = {}
        for key, text in items:
            found = words(text)
            for k in range(max(len(found) - size, 0) + 1 if found else 0):
                owners = self.items.setdefault(tuple(found[k : k + size]), [])
                if key not in owners:
                    owners.append(key)
        self.terms = sorted({w for window in self.items for w in window})


class Segment:
    """The postings of the test terms in one segment, unpacked when needed."""

    def __init__(self, postings: dict[bytes, tuple[int, bytes]], starts: np.ndarray):
        self.postings, self.starts, self.open = postings, starts, {}

    def positions(self, term: bytes) -> np.ndarray:
        if term not in self.open:
            self.open[term] = np.cumsum(unpack(self.postings[term][1]))
        return self.open[term]

    def phrase(self, order: list[tuple[int, bytes]], found: np.ndarray) -> np.ndarray:
        """Those of the candidates ``found`` that have each term of ``order`` at its offset."""
        for offset, term in order:
            if not len(found):
                break
            there = self.positions(term)
            at = np.searchsorted(there, found + offset)
            found = found[there[np.minimum(at, len(there) - 1)] == found + offset]
        return found

    def near(self, order: list[tuple[int, bytes]], found: np.ndarray, slop: int) -> np.ndarray:
        """Those of ``found`` that have each term of ``order`` within ``slop`` words of its offset in the same document."""
        for offset, term in order:
            if not len(found):
                break
            there = self.positions(term)
            doc = np.searchsorted(self.starts, found, "right")
            low = np.maximum(found + offset - slop, self.starts[np.maximum(doc - 1, 0)])
            high = np.minimum(found + offset + slop, self.starts[np.minimum(doc, len(self.starts) - 1)] - 1)
            found = found[np.searchsorted(there, low) < np.searchsorted(there, high, "right")]
        return found


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    order = np.lexsort((stops, starts))
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    first = np.concatenate(([True], starts[1:] > stops[:-1]))
    return starts[first], stops[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(stops) - 1]))]


def search(segment: Segment, windows: Windows, slop: int, rare: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]], np.ndarray]:
    """Starts and stops of all exact occurrences, the (document, item) pairs they make, and near places."""
    starts, stops, near = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    pairs: dict[str, list[np.ndarray]] = {}
    have = segment.postings
    for window, owners in windows.items.items():
        if any(w not in have for w in window):
            continue
        order = sorted(enumerate(window), key=lambda x: (have[x[1]][0], x[0]))
        found = segment.positions(order[0][1]) - order[0][0]
        exact = segment.phrase(order[1:], found)
        if len(order) >= rare:  # the rarest terms alone, close to their places
            near.append(np.setdiff1d(segment.near(order[1:rare], found + order[0][0], slop) if rare > 1 else found, exact + order[0][0]))
        if len(exact):
            starts.append(exact)
            stops.append(exact + len(window))
            docs = np.unique(np.searchsorted(segment.starts, exact, "right") - 1)
            for owner in owners:
                pairs.setdefault(owner, []).append(docs)
    both = [(int(d), owner) for owner, lists in pairs.items() for d in np.unique(np.concatenate(lists))]
    return np.concatenate(starts), np.concatenate(stops), both, np.concatenate(near)


def find(index: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW, slop: int = 5, rare: int = 3) -> DataFrame:
    """For every indexed document its hit spans, the items with occurring windows, and near places.

    ``items`` is one block of the benchmark, of BLOCK_WORDS words or one item; it is sent to all executors.
    """
    spark = index.sparkSession
    windows = Windows(items, window)
    shared = spark.sparkContext.broadcast(windows)
    terms = spark.createDataFrame(pd.DataFrame({"term": windows.terms, "wanted": True}), "term binary, wanted boolean") if windows.terms else spark.createDataFrame([], "term binary, wanted boolean")
    rows = index.join(F.broadcast(terms), "term", "left").where("wanted or n < 0")  # BLOCK_WORDS terms at most

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["n"] < 0
        directory = rows[own].iloc[0]
        line = np.frombuffer(directory["starts"], "<i8")
        found = rows[~own]
        segment = Segment({t: (n, p) for t, n, p in zip(found["term"], found["n"], found["postings"])}, line)
        starts, stops, pairs, near = search(segment, shared.value, slop, rare)
        items: dict[int, list[str]] = {}
        for place, owner in pairs:
            items.setdefault(place, []).append(owner)
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(starts):
            begin, end = _spans(starts, stops)
            places = np.searchsorted(line, begin, "right") - 1
            for place, a, b in zip(places.tolist(), (begin - line[places]).tolist(), (end - line[places]).tolist()):
                spans.setdefault(place, []).append((a, b))
        close = np.bincount(np.searchsorted(line, near, "right") - 1, minlength=len(line) - 1) if len(near) else np.zeros(len(line), int)
        lengths = np.diff(line) - 1
        keys = [None if k is None or k != k else int(k) for k in directory["doc_ids"]]
        out = [
            (key[0], i, k, int(lengths[i]), [{"start": a, "stop": b} for a, b in spans.get(i, [])], items.get(i, []), int(close[i]), mark)
            for i, (k, mark) in enumerate(zip(keys, directory["keys"]))
        ]
        return frame(out, ["segment", "place", "doc_id", "n_words", "spans", "items", "n_near", "key"])

    return rows.groupBy("segment").applyInPandas(run, FOUND)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of ``block_words`` words, or of one longer item."""
    block: list[tuple[str, str | None]] = []
    size = 0
    for key, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        block.append((key, text))
        size += len(words(text))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, key: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, n_near, contaminated) of every row of ``docs`` (doc_id, text).

    ``items`` are the sorted ids of the items of ``benchmark`` (item_id, text) with a window of ``window`` words
    in the document; shorter items are one window, items without words none. ``n_hit`` counts document words
    inside occurrences. ``n_near`` counts places where the three rarest words of a window stand within five
    words of their places without the exact phrase.
    Null texts have no words; null ids come out null; repeated rows come out one by one; a null item id is
    empty text; equal ids are one item. Without items nothing is hit. Other columns are ignored.
    A binary ``key`` of the row comes out as a last column.
    """
    index = build_index(docs, key=key)
    found = None
    for block in _blocks(benchmark, block_words):
        part = find(index, block, window)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("key").alias("key"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"),
    )
    # words of sorted spans that lie behind all stops before them
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["stop"], x["start"]))).alias("n"),
            F.greatest(acc["stop"], x["stop"]).alias("stop"),
        ),
        lambda acc: acc["n"],
    )
    return merged.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "n_near",
        (hit > 0).alias("contaminated"), *([] if key is None else ["key"]),
    )
