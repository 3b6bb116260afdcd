"""Bucketed signal counts and the fingerprint catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.enrich import with_dimensions
from lumenlog.schemas import SIGNAL_DIMS


def signals(enriched: DataFrame, bucket: str = "minute") -> DataFrame:
    """Log count per service, environment, category, severity, fingerprint and bucket."""
    return (
        with_dimensions(enriched)
        .groupBy(*SIGNAL_DIMS, F.date_trunc(bucket, "timestamp").alias("minute_bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def rescan_signals(stored: DataFrame, start: Column, end: Column) -> DataFrame:
    """Stored signal rows of ``[start, end)`` summed again per key.

    A replayed minute is stored twice with different ``created_at``; only its newest
    row counts.
    """
    keys = [*SIGNAL_DIMS, "minute_bucket"]
    rows = stored.where((F.col("minute_bucket") >= start) & (F.col("minute_bucket") < end))
    newest = rows.groupBy(*keys).agg(F.max_by("count", "created_at").alias("count"))
    return newest.select(*keys, "count")


def bounded_minutes(logs: DataFrame, max_rows: int, max_minutes: int | None = None) -> DataFrame:
    """Minutes that may be processed: all before the first one holding too many rows.

    Works on per-minute counts, so the ordered window sees one row per minute. Minutes
    without rows need no processing and are absent.
    """
    counts = logs.groupBy(F.date_trunc("minute", "timestamp").alias("minute_bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    first_over = (
        counts.where(F.col("rows") > max_rows).agg(F.min("minute_bucket").alias("m")).scalar()
    )
    kept = counts.where(first_over.isNull() | (F.col("minute_bucket") < first_over))
    if max_minutes is not None:
        start = logs.agg(F.date_trunc("minute", F.min("timestamp"))).scalar()
        kept = kept.where(
            F.col("minute_bucket") < start + F.make_dt_interval(mins=F.lit(max_minutes))
        )
    return kept


def observations(enriched: DataFrame) -> DataFrame:
    """One fingerprint observation per log row."""
    dims = with_dimensions(enriched)
    return dims.select(
        "fingerprint",
        F.lower("service").alias("service"),
        F.lower("category").alias("category"),
        "message_template",
        F.coalesce("message", F.lit("")).alias("example_message"),
        F.col("timestamp").alias("observed_at"),
        F.lit(1).cast("bigint").alias("occurrence_count"),
        *([F.col("log_id")] if "log_id" in dims.columns else []),
    )


def _first_where(value: str, keep: Column, order: list[str]) -> Column:
    """Value of the earliest row for which ``keep`` holds; a partial aggregate."""
    return F.min(F.when(keep, F.struct(*order, value)))[value]


def roll_up_observations(obs: DataFrame) -> DataFrame:
    """First and last seen, total count and first usable texts per fingerprint."""
    order = ["observed_at", *(["log_id"] if "log_id" in obs.columns else [])]

    def known(c):
        return F.col(c).isNotNull() & ~F.col(c).isin("", "unknown")

    def present(c):
        return F.col(c).isNotNull() & (F.col(c) != "")

    # Blank fingerprints are dropped by an aggregate's value: a filter on the key itself would be
    # pushed below the projection and compute every fingerprint again.
    return (
        obs.groupBy("fingerprint")
        .agg(
            F.max("fingerprint").alias("_key"),
            F.coalesce(_first_where("service", known("service"), order), F.lit("unknown")).alias("service"),
            F.coalesce(_first_where("category", known("category"), order), F.lit("unknown")).alias("category"),
            F.coalesce(
                _first_where("message_template", present("message_template"), order), F.lit("")
            ).alias("message_template"),
            F.coalesce(
                _first_where("example_message", present("example_message"), order), F.lit("")
            ).alias("example_message"),
            F.min("observed_at").alias("first_seen"),
            F.max("observed_at").alias("last_seen"),
            F.sum(F.greatest("occurrence_count", F.lit(1))).alias("occurrence_count"),
        )
        .where(F.col("_key") != "")
        .drop("_key")
    )


def merge_catalog(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """New catalog snapshots for the fingerprints of ``batch``.

    ``current`` holds the latest snapshot per fingerprint. Counts add up, the seen range
    widens, and the first example and creation time stay.
    """
    old = current.select(
        "fingerprint",
        F.col("example_message").alias("_example"),
        F.col("first_seen").alias("_first"),
        F.col("last_seen").alias("_last"),
        F.col("occurrence_count").alias("_count"),
        F.col("created_at").alias("_created"),
    )
    joined = batch.join(old, "fingerprint", "left")
    return joined.select(
        "fingerprint",
        "service",
        "category",
        "message_template",
        F.coalesce(F.nullif(F.col("_example"), F.lit("")), "example_message").alias("example_message"),
        F.least("first_seen", "_first").alias("first_seen"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        (F.coalesce("_count", F.lit(0)) + F.col("occurrence_count")).alias("occurrence_count"),
        F.unix_micros(now).alias("version"),
        F.coalesce("_created", now).alias("created_at"),
        now.alias("updated_at"),
    )


def fingerprint_cards(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Latest catalog card of every fingerprint listed in ``wanted``."""
    from lumenlog.operators.versioned import latest_by

    ids = wanted.groupBy("fingerprint").agg(F.max("fingerprint").alias("_key"))
    ids = ids.where(F.col("_key") != "").select("fingerprint")
    return latest_by(catalog.join(ids, "fingerprint", "left_semi"), ["fingerprint"], "version")


def history_stats(signal_rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Samples, total, mean, upper median and maximum per key over ``[start, end)``.

    The median of an even number of values is the higher middle one, which is the discrete
    median of the descending order.
    """
    per_bucket = (
        signal_rows.where((F.col("minute_bucket") >= start) & (F.col("minute_bucket") < end))
        .groupBy(*SIGNAL_DIMS, "minute_bucket")
        .agg(F.sum("count").alias("n"))
    )
    return per_bucket.groupBy(*SIGNAL_DIMS).agg(
        F.count(F.lit(1)).alias("history_samples"),
        F.sum("n").alias("history_total"),
        F.avg("n").alias("history_avg"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").cast("double").alias("history_median"),
        F.max("n").alias("history_max"),
    )


def first_signals(signal_rows: DataFrame) -> DataFrame:
    """The earliest bucket of every key."""
    w = Window.partitionBy(*SIGNAL_DIMS).orderBy("minute_bucket")
    return signal_rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
