"""Quality classifier: naive Bayes support vectors over hashed byte n-grams.

Features are indicators of the byte n-grams of a text, scaled by the class log-count ratio of each n-gram and
to unit length. A linear hinge-loss model over them is fitted by dual coordinate descent, and its margin is
turned into a probability by a logistic curve fitted on rows the model has not seen.

The model is fitted on a bounded sample of the labelled rows (``PER_CLASS`` of each class); every row is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import id_fold, texts

#: Labelled rows of each class the model is fitted on, at most: those with the smallest hash of their id.
PER_CLASS = 3000
#: Rows whose id has remainder 0 in this many folds are never learned from.
FOLDS = 5
ORDERS = (2, 3, 4)
BITS = 18
SIZE = 1 << BITS


class Grams:
    """The distinct hashed byte n-grams of a text, by a reused table of flags."""

    def __init__(self) -> None:
        self.flags = np.zeros(SIZE, bool)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
        for n in ORDERS:
            if len(data) >= n:
                mixed = np.full(len(data) - n + 1, n, np.uint32)
                for k in range(n):
                    mixed *= np.uint32(0x01000193)
                    mixed ^= data[k : len(data) - n + 1 + k]
                mixed *= np.uint32(0x9E3779B1)
                self.flags[mixed >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found.astype(np.int32)


@dataclass
class Model:
    """Margin weights and length weights of each n-gram, and the logistic curve from margin to score."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        length = float(self.squares[grams].sum()) ** 0.5
        return self.bias + (float(self.weights[grams].sum()) / length if length > 0 else 0.0)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def constant(score: float) -> Model:
    """The model of a sample that lacks a class."""
    zeros = np.zeros(SIZE, np.float32)
    return Model(zeros, zeros, 0.0, 0.0, float(np.log(score / (1 - score))))


def in_one(lengths: list[int], kind: type) -> list[np.ndarray]:
    """Unset arrays of those lengths in one piece of memory, which goes back to the system when they are dropped;
    thousands of small ones would leave it with the driver."""
    ends = np.cumsum([0, *lengths]).tolist()
    whole = np.empty(ends[-1], kind)
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def _coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, cost: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of a linear hinge-loss model on unit rows of ``ratios``, by dual coordinate descent."""
    weights, bias = np.zeros(SIZE), 0.0
    alphas = np.zeros(len(rows))
    values = in_one([len(grams) for grams in rows], np.float64)
    for grams, out in zip(rows, values):
        value = ratios[grams].astype(np.float64)
        np.divide(value, max(np.sqrt(value @ value), 1e-9), out=out)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            grams, value, y = rows[i], values[i], labels[i]
            gradient = y * (weights[grams] @ value + bias) - 1
            new = min(max(alphas[i] - gradient / 2, 0.0), cost[i])  # the row and its constant have length 2
            step = (new - alphas[i]) * y
            if step:
                weights[grams] += step * value
                bias += step
                most = max(most, abs(step))
                alphas[i] = new
        if most < 1e-3:
            break
    return weights, bias


def _logistic(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits smoothed labels best, by Newton steps."""
    ones, zeros = positive.sum(), (~positive).sum()
    target = np.where(positive, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, keys: np.ndarray, rounds: int = 20) -> Model:
    """The model of rows of n-grams with labels 0 and 1; a fifth of the rows, by key, only fits the curve."""
    ones = int(labels.sum())
    if ones == 0 or ones == len(labels):
        return constant((ones + 1) / (len(labels) + 2) if len(labels) else 0.5)
    curve = np.array([zlib.crc32(b"curve%d" % k) % 5 == 0 for k in keys])
    if any(len(set(labels[part])) < 2 for part in (curve, ~curve)):
        curve[:] = False
    counts = np.ones((2, SIZE))
    for grams, label, later in zip(rows, labels, curve):
        if not later:
            counts[label][grams] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratios = np.log(shares[1] / shares[0])
    fitted = [i for i in range(len(rows)) if not curve[i]]
    y = labels[fitted]
    # the rarer class weighs as much as the other
    cost = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    weights, bias = _coordinate_descent([rows[i] for i in fitted], ratios, 2.0 * y - 1, cost, rounds)
    model = Model((weights * ratios).astype(np.float32), np.square(ratios).astype(np.float32), bias, 1.0, 0.0)
    use = np.flatnonzero(curve) if curve.any() else np.arange(len(rows))
    margins = np.array([model.margin(rows[i]) for i in use])
    model.slope, model.shift = _logistic(margins, labels[use] == 1)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model learned from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text) outside fold 0.

    Of rows labelled twice the smaller label counts; rows without label or without text row are left out.
    """
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(id_fold(F.col("doc_id"), FOLDS) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    )
    hashed = known.withColumn("place", F.xxhash64("doc_id"))
    sample = hashed.where("quality = 0").orderBy("place", "doc_id").limit(per_class)
    sample = sample.union(hashed.where("quality = 1").orderBy("place", "doc_id").limit(per_class))
    rows = {int(k): int(q) for k, q in sample.select("doc_id", "quality").collect()}  # 2 * per_class rows at most
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(list(rows)) if len(rows) <= 2 * per_class else F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            found = [(key, grams(text).tobytes()) for key, text in texts(batch)]
            yield pd.DataFrame(found, columns=["doc_id", "grams"])

    held, places = bytearray(), {}  # in one piece, as in ``in_one``
    for key, grams in chosen.mapInPandas(run, "doc_id long, grams binary").toLocalIterator():
        if key in places and bytes(grams) <= held[slice(*places[key])]:
            continue  # rows of one id: any one, always the same
        places[key] = len(held), len(held) + len(grams)
        held += grams
    keys, flat = sorted(places), np.frombuffer(held, np.int32)
    found = [flat[places[k][0] // 4 : places[k][1] // 4] for k in keys]
    return fit_rows(found, np.array([rows[k] for k in keys], int), np.array(keys, np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the score (0 to 1, higher: better) of each whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of SIZE floats

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, own = Grams(), shared.value
        for part in parts:
            yield pd.Series([own.score(own.margin(grams(x if isinstance(x, str) else ""))) for x in part], dtype="float64")

    return docs.withColumn(name, rate(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Null and empty texts are scored as empty; null ids are held out (their text form is empty); repeated rows
    get equal scores. Without labels of both classes all scores are one constant. Other columns are ignored.
    """
    model = fit(docs, labels)
    rated = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rated.select(
        "doc_id", (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
