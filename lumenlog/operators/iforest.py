"""Isolation forest over (count, hour, service) points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenlog.session import checkpointed

TREES = 200
SAMPLE = 256
SEED = 42
COLUMNS = ["x0", "x1", "x2"]


def _average_depth(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    out = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, out))


def with_inputs(points: DataFrame) -> DataFrame:
    """Numeric inputs: count, hour of day and the service's place in the alphabet."""
    services = points.select("service").distinct().withColumn("_one", F.lit(0))
    place = services.withColumn(
        "x2", (F.row_number().over(Window.partitionBy("_one").orderBy("service")) - 1).cast("double")
    ).drop("_one")
    return points.join(place, "service").withColumns(
        {"x0": F.col("count").cast("double"), "x1": F.hour("minute_bucket").cast("double")}
    )


def tree_samples(inputs: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows for each tree, drawn by hash.

    At every size a row may enter any tree. Only about twice the rows the forest needs are ranked.
    """
    rate = min(1.0, 2.0 * sample / max(inputs.count(), 1))
    key = [F.lit(SEED), F.col("service"), F.col("minute_bucket")]

    def draw(*more):
        return F.pmod(F.xxhash64(*key, *more), F.lit(1 << 40)) / float(1 << 40)

    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) < rate)
    rows = inputs.withColumn("tree", F.explode(drawn))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(*key, F.col("tree"), F.lit(1)), "service", "minute_bucket")
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= sample).select("tree", *COLUMNS)


def _grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rng = np.random.default_rng([SEED, int(key[0])])
    x = rows.sort_values(COLUMNS)[COLUMNS].to_numpy()
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes = []

    def split(part: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, depth + float(_average_depth(len(part)))])
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            left = part[:, f] <= cut
            a, b = split(part[left], depth + 1), split(part[~left], depth + 1)
            nodes[me][1:5] = [f, cut, a, b]
        return me

    split(x, 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "low", "high", "path"])
    return out.assign(tree=key[0], rows=len(x))


def fit(inputs: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Node table of the forest, one task per tree over its own small sample."""
    schema = "node int, feature int, cut double, low int, high int, path double, tree int, rows int"
    return tree_samples(inputs, trees, sample).groupBy("tree").applyInPandas(_grow, schema)


def iforest_scores(points: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Add ``iforest``: how isolated a point is, from 0 for the most ordinary one."""
    inputs = with_inputs(points)
    nodes = fit(inputs, trees, sample).toPandas()  # at most trees * 2 * sample rows
    forest = [t.sort_values("node").to_numpy() for _, t in nodes.groupby("tree")]
    depth = int(np.ceil(np.log2(max(sample, 2)))) + 1
    shared = points.sparkSession.sparkContext.broadcast(forest)
    norm = float(_average_depth(nodes["rows"].max() if len(nodes) else sample)) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[COLUMNS].to_numpy()
            total = np.zeros(len(x))
            for tree in shared.value:
                at = np.zeros(len(x), dtype=int)
                for _ in range(depth):
                    f = tree[at, 1].astype(int)
                    left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 2]
                    at = np.where(f < 0, at, np.where(left, tree[at, 3], tree[at, 4]).astype(int))
                total += tree[at, 5]
            yield pdf.assign(iforest=2.0 ** (-total / max(len(shared.value), 1) / norm))

    scored = inputs.mapInPandas(score, StructType([*inputs.schema.fields, StructField("iforest", DoubleType())]))
    raw = checkpointed(scored.drop(*COLUMNS))  # read twice: for the lowest score and the result
    low = raw.agg(F.min("iforest")).scalar()
    return raw.withColumn("iforest", F.col("iforest") - low)
