"""Anomaly detector scores and their evaluation against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.stats import CONSISTENCY, array_median, running_totals
from lumenlog.session import checkpointed

MIN_HISTORY = 5
HISTORY_ROWS, EXCLUDED_ROWS, ROLLING_ROWS = 60, 6, 15
THRESHOLDS = 200
FIXED_THRESHOLD = 3.5


def detector_scores(points: DataFrame) -> DataFrame:
    """MAD, classic and rolling z of each point against its service's earlier rows.

    ``points`` has service, minute_bucket and count. History is the 60 rows ending 7 rows
    before the point, so a running burst does not hide itself.
    """
    w = Window.partitionBy("service").orderBy("minute_bucket")
    last = -(EXCLUDED_ROWS + 1)
    full = w.rowsBetween(-(HISTORY_ROWS + EXCLUDED_ROWS), last)
    short = w.rowsBetween(-(ROLLING_ROWS + EXCLUDED_ROWS), last)
    x = F.col("count").cast("double")
    rows = points.withColumns(
        {
            "_h": F.collect_list(x).over(full),
            "_mu": F.avg(x).over(full), "_sd": F.stddev_pop(x).over(full), "_n": F.count(x).over(full),
            "_rmu": F.avg(x).over(short), "_rsd": F.stddev_pop(x).over(short), "_rn": F.count(x).over(short),
        }
    )
    rows = rows.withColumn("_med", array_median(F.col("_h")))
    rows = rows.withColumn("_mad", array_median(F.transform("_h", lambda v: F.abs(v - F.col("_med")))))

    def score(gap: Column, spread: Column, centre: Column, n: Column, factor: float = 1.0) -> Column:
        floor = F.greatest(F.lit(1.0), centre * 0.5)
        z = factor * gap / F.when(spread == 0, floor).otherwise(spread)
        return F.when(n < MIN_HISTORY, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), z))

    return rows.select(
        *points.columns,
        score(x - F.col("_med"), F.col("_mad"), F.col("_med"), F.col("_n"), CONSISTENCY).alias("mad_z"),
        score(x - F.col("_mu"), F.col("_sd"), F.col("_mu"), F.col("_n")).alias("classic_z"),
        score(x - F.col("_rmu"), F.col("_rsd"), F.col("_rmu"), F.col("_rn")).alias("rolling_z"),
    )


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def score_histogram(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score; columns ``score`` and ``label`` in."""
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )


def confusion_at(scored: DataFrame, threshold: float) -> DataFrame:
    """Confusion matrix and rates at a fixed threshold."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    counts = scored.agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
    )
    return counts.withColumns(
        {"threshold": F.lit(float(threshold)), **_rates(F.col("tp"), F.col("fp"), F.col("fn"))}
    )


def best_f1(scored: DataFrame, steps: int = THRESHOLDS, top: float | None = None) -> DataFrame:
    """Best F1 over evenly spaced thresholds from 0 to the highest score."""
    return best_f1_of(score_histogram(scored), steps, top)


def best_f1_of(hist: DataFrame, steps: int = THRESHOLDS, top: float | None = None) -> DataFrame:
    """:func:`best_f1` from a score histogram.

    Each score adds to the highest threshold it reaches; the ``steps`` bins are then summed
    from the top, so scores are neither compared with all thresholds nor sorted.
    """
    high = hist.agg(F.max("score").cast("double")).scalar() if top is None else F.lit(float(top))
    rows = hist.withColumn("_max", high)
    width = F.col("_max") / F.lit(float(steps - 1))
    guess = F.least(F.floor(F.col("score") / width).cast("int"), F.lit(steps - 1))

    def cut(i: Column) -> Column:
        return F.when(i >= steps - 1, F.col("_max")).otherwise(i * width)

    # The division may be off by one rounding step, so the neighbours are compared exactly.
    exact = (
        F.when(F.col("_max") == 0, F.lit(steps - 1))
        .when((guess + 1 <= steps - 1) & (cut(guess + 1) <= F.col("score")), guess + 1)
        .when(cut(guess) > F.col("score"), guess - 1)
        .otherwise(guess)
    )
    bins = rows.withColumn("bin", exact).groupBy("bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    totals = hist.agg(F.struct(F.sum("pos").alias("pos"), F.max("score").cast("double").alias("max"))).scalar()
    grid = hist.sparkSession.range(steps).select(F.col("id").cast("int").alias("bin"))
    w = Window.partitionBy("_one").orderBy(F.desc("bin"))  # `steps` rows
    full = grid.join(bins, "bin", "left").withColumns({"_one": F.lit(0), "_t": totals})
    limit = F.col("_t.max") if top is None else F.lit(float(top))
    full = full.select(
        "bin",
        F.coalesce(F.sum("pos").over(w), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("fp"),
        F.when(F.col("bin") == steps - 1, limit)
        .otherwise(F.col("bin") * (limit / F.lit(float(steps - 1))))
        .alias("threshold"),
        F.col("_t.pos").alias("_pos"),
    ).withColumn("fn", F.col("_pos") - F.col("tp"))
    full = full.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))
    return full.orderBy(F.desc(F.round("f1", 4)), "bin").limit(1).select(
        "threshold", "tp", "fp", "fn", "precision", "recall", "f1"
    )


def auc_ap(scored: DataFrame) -> DataFrame:
    """ROC AUC with ties averaged, and average precision as a step sum."""
    return auc_ap_of(score_histogram(scored))


def auc_ap_of(hist: DataFrame) -> DataFrame:
    """:func:`auc_ap` from a score histogram, by cumulative counts over the distinct scores."""
    cum = running_totals(hist, "score", ["pos", "neg"])
    above_neg = F.col("cum_neg") - F.col("neg")
    sums = cum.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * (above_neg + F.col("neg") / 2.0)).alias("lost"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("ap"),
    )
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), 1.0 - F.col("lost") / (F.col("p") * F.col("n")))
    return sums.select(
        auc.alias("roc_auc"),
        F.coalesce(F.col("ap") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)).alias("pr_auc"),
        F.col("p").alias("positives"), F.col("n").alias("negatives"),
    )


def evaluate_detectors(scored: DataFrame, detectors: list[str]) -> DataFrame:
    """One row of metrics per detector column of ``scored`` (which also has ``label``).

    A detector is reduced to its score histogram once; all metrics read that.
    """
    out = None
    for name in detectors:
        hist = checkpointed(score_histogram(scored.select(F.col(name).alias("score"), "label")))
        best = best_f1_of(hist).select(F.struct("threshold", "precision", "recall", "f1")).scalar()
        hit = F.col("score") >= FIXED_THRESHOLD
        fixed = hist.agg(
            F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
        )
        rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
        fixed = fixed.select(F.struct(*[c.alias(n) for n, c in rates.items()])).scalar()
        row = auc_ap_of(hist).withColumns({"detector": F.lit(name), "_best": best, "_fixed": fixed}).select(
            "detector", "roc_auc", "pr_auc",
            *[F.col(f"_best.{c}").alias(f"best_{c}") for c in ("threshold", "precision", "recall", "f1")],
            *[F.col(f"_fixed.{c}").alias(f"fixed_{c}") for c in ("precision", "recall", "f1")],
        )
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("pr_auc"), "detector")
