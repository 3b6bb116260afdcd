"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of n-gram maximum-likelihood estimates and a uniform share. The weights
depend on how often the context was seen: contexts whose counts lie between the same powers of two share
weights, learned by expectation-maximisation on counts of texts that were held out of the estimates.

Texts are cut into segments of some million tokens. A segment stands as its distinct words and the place of each
token's word. Its distinct n-grams are asked for with their counts; the counts of equal n-grams are added up over
all segments, by hash range, and each segment gets back the totals in the order it asked. So the corpus is read
once, n-grams travel once for each segment, and no table of all n-grams is held anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import frame, stored, texts
from lumenlog.llm.varints import pack, unpack

#: Tokens of a segment, about: a segment ends with the document that reaches this number.
SEGMENT = 2_000_000
#: Texts with this remainder of crc32(doc_id as text) are only scored; those with the next are held out of the
#: estimates that mixture weights are learned with, and count with the rest afterwards.
FOLDS, TEST, HELD = 7, 2, 3
#: Contexts seen 0, 1, 2-3, 4-7, ... times share mixture weights.
BUCKETS = 48
#: Kinds of segments.
FIT, LATER, SCORED = 0, 1, 2
STREAMS = "segment long, kind int, doc_ids array<long>, lengths array<long>, words binary, tokens binary"
ASKED = "range int, kind int, segment long, hashes binary, counts binary"
#: Bytes of questions that a task hands on at once, about.
PORTION = 8 << 20
ANSWERED = "segment long, range int, fit binary, later binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = -1


def tokens_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased; the end token is added by the caller."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def streams(docs: DataFrame, segment_tokens: int = SEGMENT, name: str = "lm-streams") -> DataFrame:
    """The stored segments of every row of ``docs`` (doc_id, text).

    ``words`` are the 64-bit hashes of the distinct words, most frequent first, after the start (0) and the end (1);
    ``tokens`` are places among them, 32-bit, the end after each document. A segment's documents are all of
    one kind: estimates are made of FIT, weights learned on LATER, SCORED is only scored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = TaskContext.get().partitionId() << 24
        waiting = {kind: ([], [], []) for kind in (FIT, LATER, SCORED)}
        codes: dict[int, dict[bytes, int]] = {kind: {} for kind in waiting}
        sizes = dict.fromkeys(waiting, 0)

        def flush(kind: int) -> pd.DataFrame:
            nonlocal segment
            keys, lengths, parts = waiting[kind]
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(w) for w in codes[kind]], np.uint64)
            hashes = np.where(hashes < 2, hashes + np.uint64(2), hashes)
            stream = np.concatenate(parts)
            order = np.argsort(-np.bincount(stream[stream != _END], minlength=len(hashes)), kind="stable")
            places = np.ones(len(hashes) + 1, np.int64)  # the last is that of the end
            places[order] = np.arange(len(order)) + 2
            words, found = np.concatenate((np.array([0, 1], np.uint64), hashes[order])), places[stream]
            row = (segment, kind, keys, lengths, words.astype("<u8").tobytes(), found.astype("<u4").tobytes())
            segment += 1
            waiting[kind], codes[kind], sizes[kind] = ([], [], []), {}, 0
            return frame([row], columns, ())

        for batch in batches:
            for key, text in texts(batch):
                fold = zlib.crc32(str(key).encode() if key is not None else b"") % FOLDS
                kind = SCORED if fold == TEST else LATER if fold == HELD else FIT
                known = codes[kind]
                part = [known.setdefault(w, len(known)) for w in tokens_of(text)]
                part.append(_END)
                keys, lengths, parts = waiting[kind]
                keys.append(key)
                lengths.append(len(part))
                parts.append(np.array(part, np.int64))
                sizes[kind] += len(part)
                if sizes[kind] >= segment_tokens:
                    yield flush(kind)
        for kind in waiting:
            if waiting[kind][0]:
                yield flush(kind)

    columns = [c.split()[0] for c in STREAMS.split(", ")]
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, STREAMS), name)


@dataclass
class Grams:
    """The tokens of a segment."""

    words: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray

    def hashes(self) -> np.ndarray:
        """The hashes of all tokens, then of all pairs of a token and the one before; the start is before a text's first."""
        own = self.words[self.tokens]
        before = np.zeros(len(own), np.uint64)
        before[1:] = own[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = 0
        pairs = (own ^ (before * _MIX + np.uint64(5))) * _MIX
        return np.concatenate((own, pairs ^ (pairs >> np.uint64(29))))


def _grams(row: object) -> Grams:
    return Grams(np.frombuffer(row.words, "<u8"), np.frombuffer(row.tokens, "<u4"), np.array(row.lengths, np.int64))


def _asked(grams: Grams) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct hashes of words and pairs, the place of each token's two there, and how often each occurs."""
    distinct, places, counts = np.unique(grams.hashes(), return_inverse=True, return_counts=True)
    return distinct, np.split(places, 2), counts


def _pack(values: np.ndarray) -> bytes:
    """Counts as a stream of one byte each; those from 255 up follow in eight bytes."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[small == 255].astype("<u8").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def asked(segments: DataFrame, ranges: int) -> DataFrame:
    """(range, kind, segment, hashes, counts): the distinct n-grams of each segment by hash range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                distinct, _, counts = _asked(_grams(row))
                cuts = _cuts(distinct, ranges)
                rows: list[tuple] = []
                size = 0
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    rows.append((k, row.kind, row.segment, _steps(distinct[part]), _pack(counts[part])))
                    size += 8 * (cuts[k + 1] - cuts[k])
                    if size >= PORTION:
                        yield frame(rows, columns, ())
                        rows, size = [], 0
                yield frame(rows, columns, ())

    columns = [c.split()[0] for c in ASKED.split(", ")]
    return segments.select("segment", "kind", "lengths", "words", "tokens").mapInPandas(run, ASKED)


def _steps(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as variable-length differences."""
    return pack(np.diff(sorted_hashes, prepend=np.uint64(0)))[0].tobytes()


def _hashes(steps: bytes) -> np.ndarray:
    return np.cumsum(unpack(steps).view(np.uint64))


def _cuts(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of hashes begins among sorted hashes, and the end."""
    limits = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(distinct, limits), [len(distinct)]))


def answered(questions: DataFrame) -> DataFrame:
    """(segment, range, fit, later): the counts over all FIT and LATER segments of what each segment asked for."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [_hashes(h) for h in rows["hashes"]]
        distinct = np.unique(np.concatenate(hashes))
        totals = np.zeros((2, len(distinct)), np.int64)
        places = [np.searchsorted(distinct, h) for h in hashes]
        for kind, place, counts in zip(rows["kind"], places, rows["counts"]):
            if kind != SCORED:
                totals[kind][place] += _unpack(counts, len(place))  # distinct within a segment
        out = [(s, key[0], _pack(totals[FIT][p]), _pack(totals[LATER][p])) for s, p in zip(rows["segment"], places)]
        return frame(out, ["segment", "range", "fit", "later"], ())

    return questions.groupBy("range").applyInPandas(run, ANSWERED)


@dataclass
class Totals:
    """Tokens and distinct tokens of the FIT and of all training texts."""

    fit_tokens: int
    tokens: int
    distinct: int


def _estimates(grams: Grams, places: list[np.ndarray], totals: np.ndarray, fit: int, uniform: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each token the uniform, unigram and bigram estimate, and the count of its context."""
    ends = np.cumsum(grams.lengths)
    single, pair = totals[places[0]], totals[places[1]]
    context = np.empty(len(single), np.int64)
    context[1:] = single[:-1]
    # the start precedes each text's first token as often as there are texts, that is end tokens
    context[ends - grams.lengths] = single[ends - 1]
    bigram = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return [np.full(len(single), uniform), single / max(fit, 1), bigram], context


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0).clip(max=BUCKETS - 1)


#: Steps of the logarithms of estimate ratios that held-out tokens are counted by, a power of two.
STEP, CELLS = 8, 512


def _cells(estimates: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    """Held-out tokens by bucket and by the ratios of their estimates, which is all that the weights depend on."""
    base = estimates[0]
    ratio = lambda e: np.where(e > 0, np.clip(np.round(np.log2(np.maximum(e, 1e-300) / base) * STEP) + CELLS // 4, 1, CELLS - 1), 0).astype(np.int64)
    return (_bucket(context) * CELLS + ratio(estimates[1])) * CELLS + ratio(estimates[2])


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Mixture weights (bucket, order) by expectation-maximisation; a bucket without tokens takes the one below."""
    ratios = lambda c: np.where(c > 0, 2.0 ** ((c - CELLS // 4) / STEP), 0.0)
    bucket = cells // CELLS // CELLS
    values = np.stack([np.ones(len(cells)), ratios(cells // CELLS % CELLS), ratios(cells % CELLS)], 1)
    # a small count of each order, so that none is ever impossible
    weights = np.tile([0.1, 0.6, 0.3], (BUCKETS, 1))
    for _ in range(rounds):
        parts = values * weights[bucket]
        parts *= (counts / parts.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, parts[:, k], BUCKETS) for k in range(3)], 1) + np.array([0.01, 0.01, 0.01])
        new = sums / sums.sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-6
        weights = new
        if done:
            break
    seen = np.bincount(bucket, counts, BUCKETS)
    for b in range(BUCKETS):
        if seen[b] == 0:
            weights[b] = weights[b - 1] if b else [0.4, 0.6, 0.0]
        if b == 0:  # a context that was not seen has no bigram estimate
            weights[0] = [weights[0][0] / max(weights[0][:2].sum(), 1e-12), weights[0][1] / max(weights[0][:2].sum(), 1e-12), 0.0]
    return weights


class Model:
    """What the segments need: totals over the corpus, and mixture weights."""

    def __init__(self, totals: Totals, weights: np.ndarray):
        self.totals, self.weights = totals, weights


def _joined(rows: pd.DataFrame, answers: pd.DataFrame, ranges: int) -> tuple[Grams, list[np.ndarray], np.ndarray, np.ndarray, object]:
    """A segment with the counts it asked for, FIT and LATER."""
    row = next(rows.itertuples(index=False))
    grams = _grams(row)
    distinct, places, _ = _asked(grams)
    answers = answers.sort_values("range")
    sizes = np.diff(_cuts(distinct, ranges))[answers["range"]]
    fit = np.concatenate([_unpack(d, n) for d, n in zip(answers["fit"], sizes)])
    later = np.concatenate([_unpack(d, n) for d, n in zip(answers["later"], sizes)])
    return grams, places, fit, later, row


def score(docs: DataFrame, segment_tokens: int = SEGMENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Tokens are the words and one end. ``base_score`` is the add-one unigram log10 probability, ``score`` the
    interpolated bigram model's. Null texts count as empty (one token); null ids are in the fold of the empty
    text; repeated rows each count and come out. Without training texts all tokens are unknown and the score is
    the uniform one. Other columns are ignored.
    """
    spark = docs.sparkSession
    segments = streams(docs, segment_tokens)
    # one range for each segment, so that a range holds about as much as a segment
    ranges = max(1, segments.count())
    answers = stored(answered(asked(segments, ranges)), "lm-answers")
    totals = _totals(segments, answers, ranges)

    def cells(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"cell": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        grams, places, fit, _, _ = _joined(rows, found, ranges)
        estimates, context = _estimates(grams, places, fit, totals.fit_tokens, 1 / (totals.distinct + 1))
        cell, n = np.unique(_cells(estimates, context), return_counts=True)
        return pd.DataFrame({"cell": cell, "n": n})

    later = segments.where(f"kind = {LATER}").select("segment", "kind", "doc_ids", "lengths", "words", "tokens")
    own = answers.join(later.select("segment"), "segment", "left_semi")
    counted = later.groupBy("segment").cogroup(own.groupBy("segment")).applyInPandas(cells, "cell long, n long")
    # at most BUCKETS * CELLS * CELLS cells, of which a few thousand occur
    table = counted.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    model = Model(totals, learn_weights(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64)))

    def rate(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(rows):
            return frame([], columns)
        grams, places, fit, later, row = _joined(rows, found, ranges)
        counts = fit + later
        own = model.totals
        estimates, context = _estimates(grams, places, counts, own.tokens, 1 / (own.distinct + 1))
        weights = model.weights[_bucket(context)]
        mixed = np.log10(sum(weights[:, k] * estimates[k] for k in range(3)))
        single = counts[places[0]]
        base = np.log10((single + 1) / (own.tokens + (own.distinct + 1)))
        first = np.cumsum(grams.lengths) - grams.lengths
        sums = lambda x: np.add.reduceat(x, first)
        out = pd.DataFrame({
            "doc_id": pd.array([None if k is None or k != k else int(k) for k in row.doc_ids], "Int64"), "held_out": row.kind == SCORED,
            "n_tokens": grams.lengths, "n_known": sums((single > 0).astype(np.int64)), "train_tokens": own.tokens,
            "base_score": sums(base), "score": sums(mixed),
        })
        return out[columns]

    return segments.groupBy("segment").cogroup(answers.groupBy("segment")).applyInPandas(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _totals(segments: DataFrame, answers: DataFrame, ranges: int) -> Totals:
    """Tokens of the FIT and of all training texts, and the distinct tokens of the latter."""
    n = segments.select("kind", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    sums = {int(r["kind"]): int(r["n"]) for r in n.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # three rows

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = np.sort(np.frombuffer(row.words, "<u8")[1:])  # without the start
                cuts = _cuts(found, ranges)
                yield pd.DataFrame({"range": range(ranges), "words": [found[cuts[k] : cuts[k + 1]].tobytes() for k in range(ranges)]})

    def distinct(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(np.unique(np.concatenate([np.frombuffer(w, "<u8") for w in rows["words"]])))]})

    trained = segments.where(f"kind <> {SCORED}").select("words").mapInPandas(words, "range int, words binary")
    kinds = trained.groupBy("range").applyInPandas(distinct, "n long").agg(F.sum("n")).first()[0]
    return Totals(sums.get(FIT, 0), sums.get(FIT, 0) + sums.get(LATER, 0), int(kinds or 0))
