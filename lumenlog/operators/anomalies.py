"""MAD anomalies, volume spikes, new-fingerprint bursts and detector candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.enrich import with_dimensions
from lumenlog.functions.ids import anomaly_id, deterministic_id, iso_utc, signal_id
from lumenlog.operators.stats import CONSISTENCY, median_mad, robust_z
from lumenlog.schemas import SIGNAL_DIMS
from lumenlog.session import checkpointed

SERIES = ["service", "category", "severity"]
DETECTOR_DIMS = ["service", "environment", "category", "severity"]
BUCKET_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def window_counts(enriched: DataFrame, bucket: str = "minute") -> DataFrame:
    return (
        with_dimensions(enriched)
        .groupBy(F.date_trunc(bucket, "timestamp").alias("window"), *SERIES)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def mad_anomalies(windows: DataFrame, threshold: float = 3.5, min_points: int = 5) -> DataFrame:
    """Upward spikes against the median and MAD of the whole series."""
    base = median_mad(windows, SERIES, "count").where(F.col("samples") >= min_points)
    spread = F.when(F.col("mad") > 0, F.col("mad")).otherwise(
        F.greatest(F.col("mean") * 0.01, F.lit(0.1))
    )
    z = CONSISTENCY * F.abs(F.col("count") - F.col("median")) / spread
    return (
        windows.join(base, SERIES)
        .withColumn("z", z)
        .where((F.col("z") >= threshold) & (F.col("count") > F.col("median")))
        .select(
            "window",
            *SERIES,
            "count",
            "z",
            F.bround("z", 3).alias("z_score"),
            F.bround("median", 2).alias("baseline_median"),
            F.bround("mad", 2).alias("baseline_mad"),
        )
    )


def score_by_service(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("service").agg(F.max("z").alias("max_z"))


def first_anomaly(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("service").agg(F.min("window").alias("first_anomaly"))


def with_history(
    current: DataFrame, history: DataFrame, lookback: int = 1440, bucket: str = "minute"
) -> DataFrame:
    """Attach trailing statistics: the key's buckets in ``[m - lookback, m)``.

    Both sides carry a block number of ``lookback`` buckets. A row meets only its own and the
    previous block, so the range condition runs inside an equi-join and every joined group
    holds at most ``lookback`` buckets, whatever the volume of the key.
    """
    step = BUCKET_SECONDS[bucket]
    slot = F.floor(F.unix_timestamp("minute_bucket") / step).cast("bigint")
    left = (
        current.withColumn("_slot", slot)
        .withColumn("_block", F.floor(F.col("_slot") / lookback).cast("bigint"))
        .withColumn("_block", F.explode(F.array(F.col("_block"), F.col("_block") - 1)))
    )
    right = history.select(
        *SIGNAL_DIMS,
        slot.alias("_hslot"),
        F.floor(slot / lookback).cast("bigint").alias("_block"),
        F.col("count").alias("_h"),
    )
    inside = (F.col("_hslot") < F.col("_slot")) & (F.col("_hslot") >= F.col("_slot") - lookback)
    joined = left.join(right, [*SIGNAL_DIMS, "_block"], "left").withColumn(
        "_h", F.when(inside, F.col("_h"))
    )
    return (
        joined.groupBy(*current.columns)
        .agg(
            F.count("_h").alias("history_samples"),
            F.coalesce(F.sum("_h"), F.lit(0)).alias("history_total"),
            F.coalesce(F.avg("_h"), F.lit(0.0)).alias("history_avg"),
            F.coalesce(
                F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _h DESC)").cast("double"), F.lit(0.0)
            ).alias("history_median"),
            F.coalesce(F.max("_h"), F.lit(0)).alias("history_max"),
        )
    )


def _event(rows: DataFrame, kind: str, baseline: Column, score: Column, extra: list[Column],
           lookback: int, bucket: str, now: Column) -> DataFrame:
    end = F.col("minute_bucket")
    start = (end.cast("long") - lookback * BUCKET_SECONDS[bucket]).cast("timestamp")
    evidence = F.to_json(
        F.struct(
            F.col("count").alias("count_now"),
            "history_samples",
            "history_total",
            F.bround("history_avg", 2).alias("history_avg"),
            *extra,
            iso_utc(start).alias("history_start"),
            iso_utc(end).alias("history_end"),
        )
    )
    dims = [F.col(c) for c in SIGNAL_DIMS]
    return rows.select(
        anomaly_id(F.lit(kind), end, *dims).alias("anomaly_id"),
        F.lit(kind).alias("anomaly_type"),
        *SIGNAL_DIMS,
        "minute_bucket",
        F.col("count").alias("signal_count"),
        baseline.alias("baseline_count"),
        "history_samples",
        "history_total",
        score.alias("score"),
        evidence.alias("evidence_json"),
        now.alias("created_at"),
    )


def volume_spikes(rows: DataFrame, *, min_samples: int = 5, min_count: int = 10, ratio: float = 3.0,
                  delta: int = 10, lookback: int = 1440, bucket: str = "minute",
                  now: Column | None = None) -> DataFrame:
    """Buckets far above their trailing median. ``rows`` comes from :func:`with_history`."""
    baseline = F.greatest("history_median", F.lit(1.0))
    over = F.col("count") / baseline
    gap = F.col("count") - F.col("history_median")
    hits = rows.where(
        (F.col("history_samples") >= max(min_samples, 1))
        & (F.col("count") >= max(min_count, 1))
        & (over >= ratio)
        & (gap >= float(max(delta, 1)))
    )
    extra = [
        F.bround("history_median", 2).alias("history_median"),
        F.col("history_max"),
        F.bround(over, 2).alias("ratio"),
        F.bround(gap, 2).alias("delta"),
    ]
    return _event(hits, "volume_spike", baseline, F.bround(over, 2), extra, lookback, bucket,
                  F.current_timestamp() if now is None else now)


def new_fingerprint_bursts(rows: DataFrame, *, min_count: int = 10, max_total: int = 3,
                           lookback: int = 1440, bucket: str = "minute",
                           now: Column | None = None) -> DataFrame:
    """Sudden volume of a key with almost no history."""
    burst = F.col("count") / (F.col("history_total") + 1)
    hits = rows.where(
        (F.col("count") >= max(min_count, 1)) & (F.col("history_total") <= max(max_total, 0))
    )
    extra = [F.bround(burst, 2).alias("burst_ratio")]
    return _event(hits, "new_fingerprint_burst", F.col("history_avg"), F.bround(burst, 2), extra,
                  lookback, bucket, F.current_timestamp() if now is None else now)


def signal_anomalies(current: DataFrame, history: DataFrame, *, min_samples: int = 5,
                     volume_min_count: int = 10, ratio: float = 3.0, delta: int = 10,
                     burst_min_count: int = 10, max_total: int = 3, lookback: int = 1440,
                     bucket: str = "minute", now: Column | None = None) -> DataFrame:
    """Both anomaly types; only buckets large enough for either are joined to history."""
    loud = current.where(F.col("count") >= max(1, min(volume_min_count, burst_min_count)))
    rows = with_history(loud, history, lookback, bucket)
    return volume_spikes(
        rows, min_samples=min_samples, min_count=volume_min_count, ratio=ratio, delta=delta,
        lookback=lookback, bucket=bucket, now=now,
    ).unionByName(
        new_fingerprint_bursts(
            rows, min_count=burst_min_count, max_total=max_total, lookback=lookback, bucket=bucket,
            now=now,
        )
    )


def detector_signals(enriched: DataFrame, bucket: str = "minute") -> DataFrame:
    """Signal counts with the newest non-empty trace id of each bucket as a sample."""
    rows = with_dimensions(enriched)
    traced = F.when(F.coalesce(F.col("trace_id"), F.lit("")) != "", F.struct("timestamp", "trace_id"))
    return rows.groupBy(
        F.date_trunc(bucket, "timestamp").alias("minute"),
        *SIGNAL_DIMS,
        F.col("message_template").alias("normalized_message"),
    ).agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.coalesce(F.max(traced)["trace_id"], F.lit("")).alias("trace_sample"),
    )


def score_signals(signals: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Robust z of each signal against all signals of its dimension."""
    signals = checkpointed(signals)  # read twice: for the medians and the result
    base = median_mad(signals, DETECTOR_DIMS, "signal_count").select(*DETECTOR_DIMS, "median", "mad")
    z = robust_z(F.col("signal_count"), F.col("median"), F.col("mad"))
    return (
        signals.join(base, DETECTOR_DIMS)
        .withColumn("robust_z", z)
        .withColumns(
            {
                "anomaly_score": F.greatest("robust_z", F.lit(0.0)),
                "is_anomaly": F.col("robust_z") >= threshold,
                "signal_id": signal_id(F.col("minute"), *[F.col(c) for c in SIGNAL_DIMS]),
            }
        )
    )


def detector_candidates(scored: DataFrame, now: Column, known: DataFrame | None = None) -> DataFrame:
    """Candidate rows for anomalous signals.

    ``known`` lists candidate ids that are already correlated; these are not emitted again.
    """
    rows = scored.where("is_anomaly").select(
        deterministic_id("cand", F.col("signal_id")).alias("candidate_id"),
        F.lit("").alias("incident_id"),
        "fingerprint",
        *DETECTOR_DIMS,
        "normalized_message",
        F.col("minute").alias("start_time"),
        F.col("minute").alias("end_time"),
        "signal_count",
        "anomaly_score",
        F.filter(F.array("trace_sample"), lambda t: t != "").alias("trace_ids"),
        F.array("signal_id").alias("source_signals"),
        F.lit("new").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    if known is None:
        return rows
    return rows.join(known.select("candidate_id"), "candidate_id", "left_anti")
