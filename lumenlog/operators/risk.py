"""Risk model: training, scoring and attribution of each prediction."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lumenlog.operators.evaluate import auc_ap, best_f1
from lumenlog.operators.features import FEATURES, SERIES, stratified_split, time_split
from lumenlog.session import checkpointed, run_dir

MAX_NODES = 500_000

# Booster settings and the threshold grid of the training report.
DEPTH, STEP, ROUNDS, SUBSAMPLE, COLUMN_SHARE, MIN_CHILD, SEED = 7, 0.05, 800, 0.85, "0.8", 3, 42
GRID_LOW, GRID_HIGH, GRID_STEPS = 0.05, 0.95, 91


def assemble(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)


def train(
    labelled: DataFrame, *, split: str = "stratified", train_fraction: float = 0.75, rounds: int = ROUNDS,
    depth: int = DEPTH, step: float = STEP,
) -> tuple[GBTClassificationModel, DataFrame]:
    """Fit boosted trees on features with a ``label``; returns the model and the split rows.

    Positives weigh as much as the negatives of the training part together. The held-out part
    stops the boosting at the first round that does not lower its error.
    """
    rows = stratified_split(labelled, train_fraction) if split == "stratified" else time_split(labelled, train_fraction)
    rows = checkpointed(rows)  # every boosting round reads it
    counts = rows.where("is_train").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos = max(int(counts["p"] or 0), 1)
    weight = max(int(counts["n"]) - pos, 1) / pos
    ready = assemble(rows).withColumns(
        {
            "label": F.col("label").cast("double"),
            "w": F.when(F.col("label") == 1, weight).otherwise(1.0),
            "held_out": ~F.col("is_train"),
        }
    )
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="w", validationIndicatorCol="held_out", validationTol=0.0,
        maxDepth=depth, stepSize=step, maxIter=rounds, subsamplingRate=SUBSAMPLE,
        featureSubsetStrategy=COLUMN_SHARE, minInstancesPerNode=MIN_CHILD, seed=SEED,
    )
    return gbt.fit(ready), rows


def predict(model: GBTClassificationModel, features: DataFrame) -> DataFrame:
    """Add ``risk``, the probability of an incident."""
    scored = model.transform(assemble(features))
    return scored.withColumn("risk", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def training_report(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Held-out quality of a model, one row."""
    test = checkpointed(
        predict(model, rows.where("NOT is_train")).select(F.col("risk").alias("score"), "label")
    )
    # The grid runs from 0.05 to 0.95; a shifted score lets it start at zero.
    inside = test.withColumn("score", F.col("score") - GRID_LOW)
    best = best_f1(inside.where("score >= 0"), GRID_STEPS, GRID_HIGH - GRID_LOW)
    positives = test.agg(F.sum("label")).scalar()
    f1 = best.withColumn("fn", positives - F.col("tp")).select(
        F.struct(
            (F.col("threshold") + GRID_LOW).alias("threshold"), "precision",
            (F.col("tp") / F.greatest(positives, F.lit(1))).alias("recall"),
            (2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("f1"),
        )
    ).scalar()
    sizes = rows.agg(
        F.struct(
            F.count_if("is_train").alias("train_size"), F.count_if(~F.col("is_train")).alias("test_size"),
            F.count_if(F.col("is_train") & (F.col("label") == 1)).alias("train_positives"),
        )
    ).scalar()
    return auc_ap(test).withColumns({"_b": f1, "_s": sizes}).select(
        "_s.train_size", "_s.test_size", "_s.train_positives", F.col("positives").alias("test_positives"),
        "roc_auc", "pr_auc", F.col("_b.f1").alias("f1_best"), F.col("_b.precision").alias("precision_best"),
        F.col("_b.recall").alias("recall_best"), F.col("_b.threshold").alias("best_threshold"),
    )


def feature_importance(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, values)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def risk_scores(model: GBTClassificationModel, latest: DataFrame) -> DataFrame:
    """Risk per series, highest first."""
    rows = predict(model, latest).select(*SERIES, "minute_bucket", F.bround("risk", 4).alias("risk_score"))
    return rows.orderBy(F.desc("risk_score"), *SERIES)


def tree_nodes(spark: SparkSession, model: GBTClassificationModel) -> pd.DataFrame:
    """All nodes of the model with tree weight and cover; bounded by rounds and depth."""
    path = run_dir(spark, "model")
    model.write().overwrite().save(path)
    weights = spark.createDataFrame(list(enumerate(model.treeWeights)), "treeID int, weight double")
    nodes = spark.read.parquet(f"{path}/data").join(weights, "treeID").select(
        F.col("treeID").alias("tree"), "weight", "nodeData.id", "nodeData.prediction",
        F.element_at("nodeData.impurityStats", 1).alias("cover"), "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    if nodes.count() > MAX_NODES:
        raise ValueError("the model is too large to hand to every task")
    return nodes.toPandas()


def leaf_paths(nodes: pd.DataFrame) -> list[tuple]:
    """Each leaf as (value, {feature: (low, high, cover share)})."""
    leaves = []
    for _, tree in nodes.groupby("tree"):
        by_id = {n.id: n for n in tree.itertuples()}
        stack = [(by_id[0], {})]
        while stack:
            node, path = stack.pop()
            if node.leftChild < 0:
                leaves.append((node.weight * node.prediction, path))
                continue
            for child, is_left in ((by_id[node.leftChild], True), (by_id[node.rightChild], False)):
                low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
                bound = (low, min(high, node.threshold)) if is_left else (max(low, node.threshold), high)
                stack.append((child, {**path, node.feature: (*bound, share * child.cover / node.cover)}))
    return leaves


def attributions(leaves: list[tuple], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley value of each feature for each row, and the model's expected margin.

    For one leaf the value function is a product over its features: 1 or 0 when the feature is
    known, its cover share when not. The Shapley weights of such a product come from the
    coefficients of a polynomial in the number of known features.
    """
    phi = np.zeros(x.shape)
    expected = 0.0
    for value, path in leaves:
        names = list(path)
        share = np.array([path[f][2] for f in names])
        expected += value * share.prod()
        inside = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in names], 1) if names else None
        d = len(names)
        for i, f in enumerate(names):
            poly = np.zeros((len(x), d))
            poly[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    shifted = np.zeros_like(poly)
                    shifted[:, 1:] = poly[:, :-1]
                    poly = poly * share[j] + shifted * inside[:, [j]]
            weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
            phi[:, f] += value * (poly @ weights) * (inside[:, i] - share[i])
    return phi, expected


def explain(spark: SparkSession, model: GBTClassificationModel, features: DataFrame, top_n: int = 5) -> DataFrame:
    """Risk with the ``top_n`` features that moved each prediction most, in margin units."""
    leaves = spark.sparkContext.broadcast(leaf_paths(tree_nodes(spark, model)))
    scored = predict(model, features).select(*SERIES, "minute_bucket", "risk", F.array(*FEATURES).alias("x"))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                phi, base = attributions(leaves.value, np.stack(pdf["x"].to_numpy()))
                yield pdf.assign(phi=list(phi), base_value=base)

    schema = StructType(
        [*scored.schema.fields, StructField("phi", ArrayType(DoubleType())), StructField("base_value", DoubleType())]
    )
    rows = scored.mapInPandas(shares, schema)
    names = F.array(*[F.lit(f) for f in FEATURES])
    parts = F.transform(
        F.arrays_zip(names.alias("name"), F.col("x").alias("value"), F.col("phi").alias("contribution")),
        lambda p: F.struct(
            F.abs(p["contribution"]).alias("size"), p["name"].alias("name"), p["value"].alias("value"),
            p["contribution"].alias("contribution"),
            F.when(p["contribution"] > 0, "up").otherwise("down").alias("direction"),
        ),
    )
    ranked = F.slice(F.sort_array(parts, asc=False), 1, top_n)
    return rows.select(
        *SERIES, "minute_bucket", "risk", "base_value",
        F.aggregate("phi", F.lit(0.0), lambda a, v: a + v).alias("total_contribution"),
        F.transform(ranked, lambda p: p.dropFields("size")).alias("top_features"),
    )
