"""Risk features per service, environment and minute, labels and data splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.ids import safe_ratio
from lumenlog.operators.anomalies import BUCKET_SECONDS
from lumenlog.operators.stats import head_by_time

SERIES = ["service", "environment"]
BURN_MINUTES = {"5m": 5, "1h": 60, "6h": 360}

# The 32 feature columns in model order, and the training severity map.
FEATURES = [
    "err_count_now", "warn_count_now", "total_count_now", "err_ratio_now",
    "err_lag_1m", "err_lag_3m", "err_lag_5m", "err_lag_10m", "warn_lag_3m", "warn_lag_5m",
    "err_mean_5m", "err_max_5m", "err_std_5m", "warn_mean_5m",
    "err_mean_15m", "err_max_15m", "err_sum_15m", "warn_mean_15m", "err_mean_60m", "err_std_60m",
    "err_delta_1m", "err_delta_5m", "err_accel_3m", "err_ratio_to_60m", "warn_ratio_to_60m", "err_slope_5m",
    "burn_rate_5m", "burn_rate_1h", "burn_rate_6h", "anomalies_last_60m", "hour_of_day", "day_of_week",
]
TRAINING_SEVERITY = {
    "critical": "error", "fatal": "error", "error": "error", "warning": "warning", "warn": "warning",
    "info": "info", "debug": "debug",
}


def training_severity(level: Column) -> Column:
    """Severity used for training data: level only, fatal levels count as errors."""
    mapping = F.create_map(*[F.lit(x) for pair in TRAINING_SEVERITY.items() for x in pair])
    return F.coalesce(mapping[F.lower(level)], F.lit("info"))


def severity_minutes(signal_rows: DataFrame) -> DataFrame:
    """Error, warning and total counts per series and minute."""
    kind = F.lower(F.coalesce("severity", F.lit("")))
    count = F.col("count")
    return (
        signal_rows.where(F.coalesce("service", F.lit("")) != "")
        .groupBy(*SERIES, "minute_bucket")
        .agg(
            F.sum(F.when(kind.isin("error", "critical", "fatal"), count).otherwise(0)).alias("err"),
            F.sum(F.when(kind.isin("warn", "warning"), count).otherwise(0)).alias("warn"),
            F.sum(count).alias("total"),
        )
    )


def series_features(minutes: DataFrame) -> DataFrame:
    """Counts, lags, rolling statistics and trends; windows run over observed minutes.

    A window named for n minutes covers the current row and the n rows before it. All
    windows share one partitioning and order, so the data is shuffled and sorted once.
    """
    w = Window.partitionBy(*SERIES).orderBy("minute_bucket")

    def rows(n: int):
        return w.rowsBetween(-n, 0)

    def lag(name: str, n: int) -> Column:
        return F.lag(name, n, 0.0).over(w)

    base = minutes.select(
        *SERIES, "minute_bucket", *[F.col(c).cast("double").alias(c) for c in ("err", "warn", "total")]
    ).withColumn("_i", F.row_number().over(w).cast("double"))
    err, warn = F.col("err"), F.col("warn")
    wide = base.withColumns(
        {
            "err_lag_1m": lag("err", 1), "_err_lag_2": lag("err", 2), "err_lag_3m": lag("err", 3),
            "err_lag_5m": lag("err", 5), "err_lag_10m": lag("err", 10),
            "warn_lag_3m": lag("warn", 3), "warn_lag_5m": lag("warn", 5),
            "err_mean_5m": F.avg("err").over(rows(5)), "err_max_5m": F.max("err").over(rows(5)),
            "err_std_5m": F.stddev_pop("err").over(rows(5)), "warn_mean_5m": F.avg("warn").over(rows(5)),
            "err_mean_15m": F.avg("err").over(rows(15)), "err_max_15m": F.max("err").over(rows(15)),
            "err_sum_15m": F.sum("err").over(rows(15)), "warn_mean_15m": F.avg("warn").over(rows(15)),
            "err_mean_60m": F.avg("err").over(rows(60)), "err_std_60m": F.stddev_pop("err").over(rows(60)),
            "_warn_mean_60": F.avg("warn").over(rows(60)),
            "err_slope_5m": F.coalesce(F.regr_slope("err", "_i").over(rows(5)), F.lit(0.0)),
        }
    )
    return wide.withColumns(
        {
            "err_count_now": err, "warn_count_now": warn, "total_count_now": F.col("total"),
            "err_ratio_now": safe_ratio(err, F.col("total")),
            "err_delta_1m": err - F.col("err_lag_1m"),
            "err_delta_5m": err - F.col("err_lag_5m"),
            "err_accel_3m": err - F.col("err_lag_1m") * 2 + F.col("_err_lag_2"),
            "err_ratio_to_60m": safe_ratio(err, F.col("err_mean_60m")),
            "warn_ratio_to_60m": safe_ratio(warn, F.col("_warn_mean_60")),
            "hour_of_day": F.hour("minute_bucket").cast("double"),
            "day_of_week": F.weekday("minute_bucket").cast("double"),
        }
    ).drop("err", "warn", "total", "_i", "_err_lag_2", "_warn_mean_60")


def burn_at_end(burn: DataFrame) -> DataFrame:
    """Burn rates per series keyed by the minute each window ends in."""
    sizes = F.create_map(*[F.lit(x) for pair in BURN_MINUTES.items() for x in pair])
    ends = burn.where(F.col("window_size").isin(*BURN_MINUTES)).withColumn(
        "minute_bucket",
        F.date_trunc("minute", F.col("window_start") + F.make_dt_interval(mins=sizes[F.col("window_size")])),
    )
    newest = F.max_by("error_budget_consumption", "created_at") if "created_at" in burn.columns else F.max(
        "error_budget_consumption"
    )
    names = list(BURN_MINUTES)
    wide = ends.groupBy(*SERIES, "minute_bucket").pivot("window_size", names).agg(newest)
    return wide.select(*SERIES, "minute_bucket", *[F.col(n).alias(f"burn_rate_{n}") for n in names])


def anomalies_last_hour(points: DataFrame, anomalies: DataFrame, bucket: str = "minute", span: int = 60) -> DataFrame:
    """Distinct anomaly buckets in the ``span`` buckets before each point, per series.

    An anomaly with an empty environment counts for every environment of its service. Each
    anomaly is placed in the two blocks of ``span`` buckets it can reach, which makes the
    range condition an equi-join. Points without anomalies are absent.
    """
    step = BUCKET_SECONDS[bucket]
    marks = anomalies.where(F.coalesce("service", F.lit("")) != "").select(
        "service", F.coalesce("environment", F.lit("")).alias("environment"),
        F.floor(F.unix_timestamp("minute_bucket") / step).cast("bigint").alias("_a"),
    )
    series = points.select(*SERIES).distinct()
    wild = marks.where("environment = ''").select("service", "_a").join(series, "service").select(*SERIES, "_a")
    marks = marks.where("environment <> ''").unionByName(wild).distinct()
    block = F.floor(F.col("_a") / span).cast("bigint")
    marks = marks.withColumn("_block", F.explode(F.array(block, block + 1)))
    slot = F.floor(F.unix_timestamp("minute_bucket") / step).cast("bigint")
    keyed = points.select(*SERIES, "minute_bucket", slot.alias("_m")).withColumn(
        "_block", F.floor(F.col("_m") / span).cast("bigint")
    )
    hit = (F.col("_a") < F.col("_m")) & (F.col("_a") >= F.col("_m") - span)
    return (
        keyed.join(marks, [*SERIES, "_block"])
        .where(hit)
        .groupBy(*SERIES, "minute_bucket")
        .agg(F.count(F.lit(1)).cast("double").alias("anomalies_last_60m"))
    )


def risk_features(signal_rows: DataFrame, burn: DataFrame | None = None, anomalies: DataFrame | None = None,
                  bucket: str = "minute") -> DataFrame:
    """The 32 features of every observed series and minute."""
    points = series_features(severity_minutes(signal_rows))
    keys = [*SERIES, "minute_bucket"]
    if burn is not None:
        points = points.join(burn_at_end(burn), keys, "left")
    if anomalies is not None:
        points = points.join(anomalies_last_hour(points, anomalies, bucket), keys, "left")
    have = set(points.columns)
    return points.select(
        *keys,
        *[(F.coalesce(f, F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in FEATURES],
    )


def latest_features(features: DataFrame) -> DataFrame:
    """Newest feature row of each series."""
    from lumenlog.operators.versioned import latest_by

    return latest_by(features, SERIES, "minute_bucket")


def lookahead_label(points: DataFrame, bursts: DataFrame, horizon: int = 15, bucket: str = "minute") -> DataFrame:
    """1 where the service has a burst in one of the next ``horizon`` buckets.

    Every burst marks the buckets before it, so the look-ahead is an equality join and works
    for buckets without rows of their own.
    """
    step = BUCKET_SECONDS[bucket]
    at = F.unix_timestamp("minute_bucket")
    marks = (
        bursts.select("service", F.explode(F.sequence(at - horizon * step, at - step, F.lit(step))).alias("_at"))
        .distinct()
        .withColumn("label", F.lit(1))
    )
    return (
        points.withColumn("_at", at)
        .join(marks, ["service", "_at"], "left")
        .drop("_at")
        .withColumn("label", F.coalesce("label", F.lit(0)))
    )


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with a label for the same service and minute; both sides must exist."""
    return features.join(labels.select("service", "minute_bucket", "label"), ["service", "minute_bucket"])


def time_split(rows: DataFrame, fraction: float = 0.7, ties: list[str] | None = None) -> DataFrame:
    """``is_train`` for the first ``fraction`` of the rows in time order."""
    out = head_by_time(rows, "minute_bucket", ties or SERIES, fraction)
    return out.withColumnRenamed("in_head", "is_train")


SPLIT_BUCKETS = 4096


def stratified_split(rows: DataFrame, fraction: float = 0.75, seed: int = 42, label: str = "label") -> DataFrame:
    """``is_train`` for the same share of each class, to one row: those with the smallest hash of their key.

    Counts by class and hash bucket tell the bucket that a class's cut falls into; only its rows are ranked.
    """
    order = F.xxhash64(F.lit(seed), *SERIES, "minute_bucket")
    drawn = rows.withColumns({"_draw": order, "_bucket": F.pmod(F.shiftrightunsigned(order, 8), F.lit(SPLIT_BUCKETS))})
    # at most SPLIT_BUCKETS rows for each class
    counts = drawn.groupBy(F.col(label).alias("_class"), "_bucket").agg(F.count("*").alias("_n"))
    line = Window.partitionBy("_class").orderBy("_bucket")
    upto = counts.withColumns(
        {"_upto": F.sum("_n").over(line), "_wanted": F.floor(F.sum("_n").over(Window.partitionBy("_class")) * fraction)}
    )
    upto = upto.withColumn("_before", F.col("_upto") - F.col("_n"))
    edge = upto.where("_before <= _wanted and _upto > _wanted").select(
        "_class", F.col("_bucket").alias("_edge"), (F.col("_wanted") - F.col("_before")).alias("_take")
    )
    joined = drawn.join(F.broadcast(edge), F.col(label).eqNullSafe(F.col("_class")), "left")  # one row a class
    at_edge = F.col("_bucket") == F.col("_edge")
    # rows off the edge are spread over their own buckets, so no class is gathered to be ranked
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_draw", *SERIES, "minute_bucket"))
    train = F.when(at_edge, place <= F.col("_take")).otherwise(F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(True)))
    return joined.withColumn("is_train", train).drop("_draw", "_bucket", "_class", "_edge", "_take")


def class_weight(rows: DataFrame, label: str = "label") -> Column:
    """Negatives per positive, as a scalar."""
    pos = F.greatest(F.sum(label), F.lit(1))
    return rows.agg(F.greatest(F.count(F.lit(1)) - pos, F.lit(1)) / pos).scalar()
