"""Error-budget burn rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.enrich import is_error, with_dimensions
from lumenlog.functions.ids import deterministic_id, iso_utc, minutes_before
from lumenlog.operators.stats import tail_boundaries

# Burn windows and alert thresholds.
BURN_WINDOWS = {"5m": 5, "1h": 60, "6h": 360}
ALERT_WINDOWS = {"1h": 14.4, "6h": 6.0, "24h": 3.0}
ALERT_MINUTES = {"1h": 60, "6h": 360, "24h": 1440}
ALERT_LEVELS = {"1h": "page", "6h": "ticket", "24h": "warning"}
LEVEL_ORDER = ["page", "ticket", "warning", "none"]
SLO_TARGET = 0.999


def slo_burn(enriched: DataFrame, now: Column, windows: dict[str, int] | None = None,
             slo_target: float = SLO_TARGET) -> DataFrame:
    """Burn per service, environment and window, all windows counted in one pass.

    Only rows of the longest window are read; a service silent in all of them has no row.
    """
    windows = windows or BURN_WINDOWS
    budget = max(1e-6, 1.0 - slo_target)
    rows = with_dimensions(enriched.where(F.col("timestamp") >= minutes_before(now, max(windows.values()))))
    counts = []
    for name, minutes in windows.items():
        recent = F.col("timestamp") >= minutes_before(now, minutes)
        counts += [
            F.count_if(recent).alias(f"total_{name}"),
            F.count_if(recent & is_error(F.col("severity"))).alias(f"errors_{name}"),
        ]
    wide = rows.groupBy("service", "environment").agg(*counts)
    per_window = F.array(
        *[
            F.struct(
                F.lit(name).alias("window_size"),
                F.date_trunc("minute", minutes_before(now, minutes)).alias("window_start"),
                F.col(f"errors_{name}").alias("error_count"),
                F.col(f"total_{name}").alias("total_count"),
            )
            for name, minutes in windows.items()
        ]
    )
    long = wide.select("service", "environment", F.inline(per_window))
    ratio = F.when(F.col("total_count") > 0, F.col("error_count") / F.col("total_count")).otherwise(0.0)
    return long.select(
        deterministic_id(
            "burn", F.col("service"), F.col("environment"), F.col("window_size"), iso_utc(F.col("window_start"))
        ).alias("burn_id"),
        "window_start",
        "window_size",
        "service",
        "environment",
        "error_count",
        "total_count",
        ratio.alias("error_ratio"),
        (ratio / budget).alias("error_budget_consumption"),
        now.alias("created_at"),
    )


def burn_triplet(burn: DataFrame) -> DataFrame:
    """Newest burn of each window size per service and environment, as three columns."""
    from lumenlog.operators.versioned import latest_by

    newest = latest_by(burn, ["service", "environment", "window_size"], "created_at")
    names = list(BURN_WINDOWS)
    wide = newest.groupBy("service", "environment").pivot("window_size", names).agg(
        F.first("error_budget_consumption")
    )
    return wide.select(
        "service", "environment",
        *[F.coalesce(F.col(n), F.lit(0.0)).alias(f"burn_rate_{n}") for n in names],
    )


def _status(counts: DataFrame, slo_target: float) -> DataFrame:
    """Windows array and alert level from per-label error and total counts."""
    allowed = 1.0 - slo_target
    structs, level = [], None
    for label, threshold in ALERT_WINDOWS.items():
        total, errors = F.col(f"total_{label}"), F.col(f"errors_{label}")
        rate = F.when(total > 0, errors / total).otherwise(F.lit(0.0))
        burn = rate / F.lit(max(allowed, 1e-9))
        structs.append(
            F.struct(
                F.lit(label).alias("label"),
                errors.alias("error_count"),
                total.alias("total_count"),
                rate.alias("error_rate"),
                burn.alias("burn_rate"),
                F.lit(threshold).alias("threshold"),
                (burn > threshold).alias("is_burning"),
            )
        )
        hit = burn > threshold
        name = ALERT_LEVELS[label]
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return counts.select(
        "service",
        F.lit(slo_target).alias("slo_target"),
        F.lit(allowed).alias("allowed_error_rate"),
        F.array(*structs).alias("windows"),
        level.otherwise("none").alias("alert_level"),
    )


def order_status(status: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.col("alert_level"))
    return status.orderBy(rank, "service")


def slo_status_timed(enriched: DataFrame, now: Column, slo_target: float = SLO_TARGET,
                     windows: dict[str, int] | None = None) -> DataFrame:
    """SLO status over true time windows ending at ``now``; only rows of the longest window are read."""
    windows = windows or ALERT_MINUTES
    longest = minutes_before(now, max(windows.values()))
    rows = with_dimensions(enriched.where((F.col("timestamp") >= longest) & (F.col("timestamp") <= now)))
    aggs = []
    for label, minutes in windows.items():
        recent = (F.col("timestamp") >= minutes_before(now, minutes)) & (F.col("timestamp") <= now)
        aggs += [
            F.count_if(recent).alias(f"total_{label}"),
            F.count_if(recent & is_error(F.col("severity"))).alias(f"errors_{label}"),
        ]
    return _status(rows.groupBy("service").agg(*aggs), slo_target)


def slo_status(enriched: DataFrame, slo_target: float = SLO_TARGET, ties: list[str] | None = None) -> DataFrame:
    """SLO status where the last 1/24, 6/24 and all of a service's rows stand for 1h, 6h, 24h.

    Minute counts locate each cut; only the rows of the minute a cut falls into are ranked,
    so no task ever sorts a whole service.
    """
    fractions = {"1h": 1 / 24, "6h": 6 / 24}
    ties = ties if ties is not None else [c for c in ["log_id"] if c in enriched.columns]
    rows = with_dimensions(enriched).select(
        "service", "severity", "timestamp", *ties, F.date_trunc("minute", "timestamp").alias("_bucket")
    )
    err = is_error(F.col("severity"))
    counts = rows.groupBy("service", "_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(err).alias("e")
    )
    cuts = tail_boundaries(counts, ["service"], "_bucket", fractions)
    whole = counts.groupBy("service").agg(F.sum("n").alias("total_24h"), F.sum("e").alias("errors_24h"))
    after = (
        counts.join(cuts, "service")
        .where(F.col("_bucket") > F.col("cut_bucket"))
        .groupBy("service", "label")
        .agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    )
    edge_rows = rows.join(
        cuts.withColumnRenamed("cut_bucket", "_bucket"), ["service", "_bucket"]
    )
    rank = F.row_number().over(
        Window.partitionBy("service", "label", "_bucket").orderBy("timestamp", *ties)
    )
    edge = (
        edge_rows.withColumn("_rank", rank)
        .where(F.col("_rank") > F.col("skip_in_bucket"))
        .groupBy("service", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(err).alias("e"))
    )
    tails = (
        after.unionByName(edge)
        .groupBy("service")
        .pivot("label", list(fractions))
        .agg(F.sum("n").alias("total"), F.sum("e").alias("errors"))
    )
    joined = whole.join(tails, "service", "left")
    cols = {}
    for label in fractions:
        for name in ("total", "errors"):
            cols[f"{name}_{label}"] = F.coalesce(F.col(f"{label}_{name}"), F.lit(0))
    return _status(joined.withColumns(cols), slo_target)
