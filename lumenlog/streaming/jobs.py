"""Structured Streaming jobs: signals, anomalies, catalog, incidents and templates.

Every micro-batch writes to a folder named after its batch id and replaces that folder, so a
batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DateType, IntegerType, LongType, StringType, StructField, StructType

from lumenlog.functions.enrich import enrich_with_fingerprint, with_dimensions
from lumenlog.operators import anomalies as an
from lumenlog.operators import drain as dr
from lumenlog.operators import signals as sg
from lumenlog.operators.incidents import INCIDENT_KEY, TRANSITIONS
from lumenlog.operators.versioned import latest_by
from lumenlog.schemas import FINGERPRINT_CATALOG, LOG_SIGNALS, SIGNAL_DIMS, conform
from lumenlog.session import checkpointed

TEMPLATES = StructType(
    [StructField("leaf", StringType()), StructField("ordinal", IntegerType()), StructField("template", ArrayType(StringType()))]
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_start(spark: SparkSession, checkpoint: str, now: datetime, look_back: timedelta) -> datetime:
    """Where a job begins: ``look_back`` before ``now`` on its first run, and the same instant on every later one.

    The instant is kept beside the checkpoint, so that a restart neither skips a backlog nor reaches back further.
    """
    path = f"{checkpoint.rstrip('/')}-start"
    try:
        return spark.read.schema("start timestamp").parquet(path).first()["start"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([(now - look_back,)], "start timestamp").write.mode("overwrite").parquet(path)
    return spark.read.schema("start timestamp").parquet(path).first()["start"]


def log_files(
    spark: SparkSession, path: str, schema: StructType, *, start: datetime | None = None, time: str = "timestamp",
    max_files: int | None = None, max_bytes: str | None = None, **options: str,
) -> DataFrame:
    """Stream of Parquet files of logs; a backlog comes as batches of at most ``max_files`` files or ``max_bytes``.

    Rows before ``start`` are left out by a filter that reaches the scan, so row groups and files that are older
    are skipped by their statistics.
    """
    limits = {"maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes}
    if max_files is not None and max_bytes is not None:
        raise ValueError("give max_files or max_bytes")
    reader = spark.readStream.schema(schema).options(**{k: str(v) for k, v in limits.items() if v is not None}, **options)
    rows = reader.parquet(path)
    return rows if start is None else rows.where(F.col(time) >= F.lit(start))


def run_available(stream: DataFrame, checkpoint: str, *, path: str | None = None,
                  batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> list[int]:
    """Process everything that is there and stop; the checkpoint holds the progress. Returns the ids of the batches with rows."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)
    query = writer.start()
    query.awaitTermination()
    return [p["batchId"] for p in query.recentProgress if p["numInputRows"]]


def windowed_signals(logs: DataFrame, delay: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Counts of closed windows per signal key; later rows of a closed window are dropped."""
    rows = with_dimensions(enrich_with_fingerprint(logs.withWatermark("timestamp", delay)))
    counts = rows.groupBy(F.window("timestamp", width), *SIGNAL_DIMS).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(*SIGNAL_DIMS, F.col("window.start").alias("minute_bucket"), "count")


def _write_batch(df: DataFrame, root: str, table: str, batch_id: int, ts: str) -> None:
    df.withColumn("dt", F.to_date(ts)).write.mode("overwrite").partitionBy("dt").parquet(
        f"{root}/{table}/batch={batch_id}"
    )


def read_table(spark: SparkSession, root: str, table: str, schema: StructType, by: StructField | None = None) -> DataFrame:
    """All batches of a table, with the columns ``batch`` and that which each batch is partitioned ``by`` (a day, if not
    said otherwise); an empty frame without them before the first batch."""
    parts = [] if schema == TEMPLATES else [by or StructField("dt", DateType())]
    full = StructType([*schema.fields, *parts, StructField("batch", LongType())])
    try:
        return spark.read.schema(full).parquet(f"{root}/{table}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def signal_sink(root: str, bucket: str = "minute", detect: dict[str, Any] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: store new signals, then compare them with the stored history.

    Only the days the look-back can reach are read, and only batches before this one plus the
    new rows, so a repeated batch sees the same history.
    """
    detect = detect or {}
    lookback = detect.get("lookback", 1440)
    days = lookback * an.BUCKET_SECONDS[bucket] // 86400 + 2

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = conform(batch.withColumn("created_at", F.current_timestamp()), LOG_SIGNALS)
        _write_batch(stamped, root, "log_signals_1m", batch_id, "minute_bucket")
        stored = read_table(spark, root, "log_signals_1m", LOG_SIGNALS)
        new = stored.where(F.col("batch") == batch_id)
        first = new.agg(F.min("dt")).first()[0]
        if first is None:
            return
        past = stored.where((F.col("batch") <= batch_id) & (F.col("dt") >= F.date_sub(F.lit(first), days)))
        keys = [*SIGNAL_DIMS, "minute_bucket"]
        history = past.groupBy(*keys).agg(F.max_by("count", "created_at").alias("count"))
        found = an.signal_anomalies(new.select(*keys, "count"), history, bucket=bucket, **detect)
        _write_batch(found, root, "anomaly_events", batch_id, "minute_bucket")

    return write


#: Buckets of fingerprints in the catalog, and batches after which their changes are gathered.
CATALOG_BUCKETS, CATALOG_ROUND = 64, 16
_BUCKET = StructField("bucket", IntegerType())


def catalog_state(spark: SparkSession, root: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The newest snapshot of each fingerprint (of some ``buckets``), from batches ``before`` one.

    Merges on read: the newest gathered table and the changes of the batches after it, fewer than CATALOG_ROUND.
    """
    base, changes = (read_table(spark, root, t, FINGERPRINT_CATALOG, _BUCKET) for t in ("fingerprint_catalog_base", "fingerprint_catalog"))
    names = FINGERPRINT_CATALOG.fieldNames()
    if "batch" not in changes.columns:
        return changes.select(*names)
    past = F.lit(True) if before is None else F.col("batch") < before
    some = F.lit(True) if buckets is None else F.col("bucket").isin(buckets)
    since = None
    if "batch" in base.columns:
        since = base.where(past).agg(F.max("batch")).first()[0]
    rows = changes.where(past & some & (F.col("batch") > (-1 if since is None else since))).select(*names)
    if since is not None:
        rows = rows.unionByName(base.where((F.col("batch") == since) & some).select(*names))
    return latest_by(rows, ["fingerprint"], "version")


def catalog_sink(root: str, every: int = CATALOG_ROUND) -> Callable[[DataFrame, int], None]:
    """Batch function over raw logs: merge the batch's fingerprints into the catalog.

    A batch reads only the buckets it has fingerprints of, and writes only what it changes. After ``every`` batches
    the state is gathered, so what a batch reads doesn't grow with the batches before it. Versions are batch ids, so
    that a batch that runs again leaves the same rows.
    """

    def put(df: DataFrame, table: str, batch_id: int) -> None:
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64("fingerprint"), F.lit(CATALOG_BUCKETS)).cast("int"))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{table}/batch={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        observed = checkpointed(sg.roll_up_observations(sg.observations(enrich_with_fingerprint(batch))))
        bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(CATALOG_BUCKETS)).cast("int").alias("bucket")
        buckets = [r.bucket for r in observed.select(bucket).distinct().collect()]  # at most CATALOG_BUCKETS
        current = catalog_state(spark, root, batch_id, buckets)
        merged = sg.merge_catalog(current, observed, F.current_timestamp())
        put(merged.withColumn("version", F.lit(batch_id).cast("long")), "fingerprint_catalog", batch_id)
        if batch_id % every == every - 1:
            put(catalog_state(spark, root, batch_id + 1), "fingerprint_catalog_base", batch_id)

    return write


def distinct_anomalies(anomalies: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row of each anomaly id within the watermark."""
    return anomalies.withWatermark("minute_bucket", delay).dropDuplicatesWithinWatermark(["anomaly_id"])


class IncidentLifecycle(StatefulProcessor):
    """The incident of one key: candidates open, extend or reopen it, status requests move it on, a timer ends it.

    Every batch that touches an incident emits a snapshot of it with a higher version, so open ones are seen.
    """

    def __init__(self, gap_minutes: int = 30, reopen_minutes: int = 360) -> None:
        self.gap_ms, self.reopen_ms = gap_minutes * 60_000, reopen_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "incident",
            "incident_id string, status string, start_ms bigint, end_ms bigint, resolved_ms bigint, candidates bigint, "
            "signals bigint, score double, version bigint",
        )

    def _row(self, key: tuple, now: dict, status: str | None = None) -> dict:
        return {
            **dict(zip(INCIDENT_KEY, key)), "incident_id": now["incident_id"],
            "session_start": pd.Timestamp(now["start_ms"], unit="ms", tz="UTC"),
            "session_end": pd.Timestamp(now["end_ms"], unit="ms", tz="UTC"), "candidates": now["candidates"],
            "signal_count": now["signals"], "max_score": now["score"], "status": status or now["status"], "version": now["version"],
        }

    def _opened(self, key: tuple, ms: int) -> dict:
        name = "|".join(["" if x is None else str(x) for x in key] + [str(ms)])
        return {
            "incident_id": "inc_" + hashlib.sha1(name.encode()).hexdigest(), "status": "open", "start_ms": ms, "end_ms": ms,
            "resolved_ms": None, "candidates": 0, "signals": 0, "score": float("-inf"), "version": 0,
        }

    def _candidate(self, key: tuple, now: dict | None, row: Any, done: list[dict]) -> dict:
        ms = int(row.ms)
        if now is not None:
            if now["status"] == "resolved":
                if ms - now["resolved_ms"] <= self.reopen_ms:
                    now.update(status="reopened", resolved_ms=None)
                else:
                    now = None
            elif ms - now["end_ms"] > self.gap_ms:
                done.append(self._row(key, {**now, "version": now["version"] + 1}, "closed"))
                now = None
        now = now or self._opened(key, ms)
        now.update(
            start_ms=min(now["start_ms"], ms), end_ms=max(now["end_ms"], ms), candidates=now["candidates"] + 1,
            signals=now["signals"] + int(row.signal_count), score=max(now["score"], float(row.anomaly_score)),
        )
        return now

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "to_status", "ref"], na_position="first")
        now = dict(zip(_STATE, self.state.get())) if self.state.exists() else None
        done: list[dict] = []
        for row in batch.itertuples(index=False):
            if not isinstance(row.to_status, str):
                now = self._candidate(key, now, row, done)
            elif now is not None and row.to_status in TRANSITIONS.get(now["status"], ()):
                now.update(status=row.to_status, resolved_ms=int(row.ms) if row.to_status == "resolved" else None)
        if now is not None:
            now["version"] += 1
            self.state.update(tuple(now[x] for x in _STATE))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            ends = now["resolved_ms"] + self.reopen_ms if now["status"] == "resolved" else now["end_ms"] + self.gap_ms
            self.handle.registerTimer(int(ends))
            done.append(self._row(key, now))
        if done:
            yield pd.DataFrame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            now = dict(zip(_STATE, self.state.get()))
            self.state.clear()
            now["version"] += 1
            yield pd.DataFrame([self._row(key, now, None if now["status"] == "resolved" else "closed")])

    def close(self) -> None:
        pass


_STATE = ("incident_id", "status", "start_ms", "end_ms", "resolved_ms", "candidates", "signals", "score", "version")
SESSION_SCHEMA = (
    "fingerprint string, service string, environment string, category string, incident_id string, session_start timestamp, "
    "session_end timestamp, candidates bigint, signal_count bigint, max_score double, status string, version bigint"
)


def incident_lifecycle(
    candidates: DataFrame, requests: DataFrame | None = None, *, gap_minutes: int = 30, reopen_minutes: int = 360, delay: str = "1 minute",
) -> DataFrame:
    """Stream of candidates, and of status ``requests`` (key, request_id, to_status, requested_at), to incident snapshots.

    An incident takes the candidates that start within the gap after its last one, or, once resolved, within
    ``reopen_minutes`` after that, which reopens it. Requests that the status doesn't allow change nothing. The state
    of an incident goes when its time is over. The session needs the RocksDB state store (``ROCKSDB``).
    """
    rows = candidates.withWatermark("start_time", delay).select(
        *INCIDENT_KEY, F.col("start_time").alias("at"), F.unix_millis("start_time").alias("ms"), F.col("candidate_id").alias("ref"),
        F.col("signal_count").cast("long").alias("signal_count"), F.col("anomaly_score").cast("double").alias("anomaly_score"),
        F.lit(None).cast("string").alias("to_status"),
    )
    if requests is not None:
        rows = rows.unionByName(
            requests.withWatermark("requested_at", delay).select(
                *INCIDENT_KEY, F.col("requested_at").alias("at"), F.unix_millis("requested_at").alias("ms"), F.col("request_id").alias("ref"),
                F.lit(0).cast("long").alias("signal_count"), F.lit(0.0).alias("anomaly_score"), "to_status",
            )
        )
    return rows.groupBy(*INCIDENT_KEY).transformWithStateInPandas(
        IncidentLifecycle(gap_minutes, reopen_minutes), SESSION_SCHEMA, "Append", "EventTime"
    )


def latest_snapshots(rows: DataFrame) -> DataFrame:
    """The newest snapshot of each incident."""
    return latest_by(rows, ["incident_id"], "version")


def template_sink(root: str, scope: list[str] | None = None, **options: Any) -> Callable[[DataFrame, int], None]:
    """Batch function over raw logs (with log_id): the batch's rows with their templates, and the templates after it.

    Each batch writes all templates, at most ``max_groups`` a leaf, and reads those of the newest batch before it
    alone. Only distinct messages that no template covers are learnt from. Rows of a batch are placed in the order
    of their times, after all earlier batches, as one pass over the stream would.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_table(spark, root, "templates", TEMPLATES)
        known = None
        if "batch" in before.columns:
            last = before.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
            known = before.where(F.col("batch") == last).select(*TEMPLATES.fieldNames()) if last is not None else None
        rows, changes = dr.mined(batch, scope=scope, known=known, **options)
        rows = rows.select("log_id", "leaf", "ordinal", "template_at")
        rows.write.mode("overwrite").parquet(f"{root}/template_rows/batch={batch_id}")
        now = dr.current_templates(changes).select(*TEMPLATES.fieldNames())
        now.write.mode("overwrite").parquet(f"{root}/templates/batch={batch_id}")

    return write
