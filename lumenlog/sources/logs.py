"""Reading raw logs: ranges, look-backs, CSV files and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.ids import json_map, minutes_before
from lumenlog.schemas import LOGS


def scan_range(logs: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Rows with ``start <= timestamp < end`` in time order, nine columns.

    When the table is partitioned by day, ``dt`` bounds are added so whole days are skipped.
    """
    rows = logs.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    if "dt" in logs.columns:
        rows = rows.where((F.col("dt") >= F.to_date(start)) & (F.col("dt") <= F.to_date(end)))
    rows = rows.select(*LOGS.fieldNames())
    return rows if limit is None else rows.orderBy("timestamp").limit(limit)


def scan_recent(logs: DataFrame, ref_time: Column, minutes: int, limit: int | None = None) -> DataFrame:
    """Rows of the last ``minutes`` before ``ref_time``, newest first when limited."""
    start = minutes_before(ref_time, minutes)
    rows = logs.where(F.col("timestamp") >= start)
    if "dt" in logs.columns:
        rows = rows.where(F.col("dt") >= F.to_date(start))
    return rows if limit is None else rows.orderBy(F.desc("timestamp")).limit(limit)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header row and the log columns."""
    return spark.read.schema(LOGS).option("header", True).option("escape", '"').option(
        "multiLine", False
    ).csv(path)


def decode_json(df: DataFrame, columns: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """Turn JSON text columns into string maps; invalid text becomes an empty map."""
    return df.withColumns({c: json_map(F.col(c)) for c in columns})


def search(
    logs: DataFrame, *, product: str | None = None, service: str | None = None,
    environment: str | None = None, level: str | None = None, q: str | None = None,
) -> DataFrame:
    """Equality filters, case-insensitive level and literal case-insensitive text search."""
    for name, value in (("product", product), ("service", service), ("environment", environment)):
        if value:
            logs = logs.where(F.col(name) == value)
    if level:
        logs = logs.where(F.lower("level") == level.lower())
    if q:
        logs = logs.where(F.contains(F.lower("message"), F.lit(q.lower())))
    return logs


def list_logs(
    logs: DataFrame, *, limit: int = 200, severity: str | None = None, category: str | None = None,
    compat_limit_first: bool = False, ties: tuple[str, ...] = (), **filters: str | None,
) -> DataFrame:
    """Newest matching logs with derived fields.

    Derived filters run before the limit; ``compat_limit_first`` runs them after it.
    """
    from lumenlog.functions.enrich import enrich

    limit = max(1, limit)
    order = [F.desc("timestamp"), *[F.desc(t) for t in ties]]
    rows = search(logs, **filters)
    if compat_limit_first:
        rows = rows.orderBy(*order).limit(limit)
    rows = enrich(rows)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if category:
        rows = rows.where(F.col("category") == category)
    return rows if compat_limit_first else rows.orderBy(*order).limit(limit)


def trace_logs(logs: DataFrame, trace_id: str, limit: int | None = None) -> DataFrame:
    """Rows of one trace, oldest first; the first ``limit`` if given."""
    cols = ["timestamp", "service", "level", "status_code", "message"]
    rows = logs.where(F.col("trace_id") == trace_id).select(*cols).orderBy("timestamp")
    return rows if limit is None else rows.limit(limit)


PROFILE_COLUMNS = ["product", "service", "environment", "level", "method", "status_code"]


def profile_column(logs: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct values of one allowed column; the first ``limit`` in order if given."""
    name = column.split("=", 1)[1].strip(" '\"") if "=" in column else column.strip()
    if name not in PROFILE_COLUMNS:
        raise ValueError(f"column {name!r} may not be profiled; choose one of {PROFILE_COLUMNS}")
    values = logs.select(F.col(name).cast("string").alias("value")).distinct()
    return values if limit is None else values.orderBy("value").limit(limit)


def dimension_tree(logs: DataFrame) -> DataFrame:
    """Products with their services and environments as sorted nested arrays."""
    dims = ["product", "service", "environment"]
    filled = logs
    for c in dims:
        filled = filled.where(F.col(c).isNotNull() & (F.col(c) != ""))
    leaf = filled.select(*dims).distinct().groupBy("product", "service").agg(
        F.array_sort(F.collect_set("environment")).alias("environments")
    )
    return leaf.groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("service", "environments"))).alias("services")
    )


def category_summary(enriched: DataFrame) -> DataFrame:
    """Row counts per category and per severity in one pass, largest first."""
    kind = F.when(F.expr("grouping(category)") == 0, "category").otherwise("severity")
    counts = enriched.groupingSets([["category"], ["severity"]], "category", "severity").agg(
        kind.alias("kind"),
        F.coalesce("category", "severity").alias("name"),
        F.count(F.lit(1)).alias("count"),
    )
    return counts.select("kind", "name", "count").orderBy("kind", F.desc("count"), "name")
