"""Streaming queries: the given events as a file stream, run until everything is processed."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from lumenlog.operators.incidents import INCIDENT_KEY
from lumenlog.plans import sql as q
from lumenlog.plans import views
from lumenlog.plans.incident_plans import INCIDENT_SESSIONS_SQL
from lumenlog.plans.registry import query, ts_text
from lumenlog.plans.signal_plans import _BURST, _HISTORY, _LAX, _SPIKE, _anomaly_columns, day_candidates
from lumenlog.schemas import ANOMALY_EVENTS
from lumenlog.session import run_dir
from lumenlog.streaming import jobs


def event_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def log_stream(spark, sf):
    return views.logs_from_events(event_stream(spark, sf))


@query(
    "stream_signals",
    f"""WITH {q.signals('minute')} SELECT service, environment, category, severity, fingerprint,
        {q.ts('minute_bucket')}, count FROM signals
        WHERE signals.minute_bucket + INTERVAL 1 MINUTE <= (SELECT max(timestamp) FROM logs) - INTERVAL 2 MINUTE""",
)
def stream_signals(spark, sf):
    base = run_dir(spark, "stream-signals")
    signals = jobs.windowed_signals(log_stream(spark, sf))
    jobs.run_available(signals, f"{base}/checkpoint", path=f"{base}/out")
    return spark.read.parquet(f"{base}/out").withColumn("minute_bucket", ts_text("minute_bucket"))


@query(
    "stream_anomalies",
    f"""WITH {_HISTORY}, found AS ({_SPIKE} UNION ALL {_BURST}) SELECT * FROM found
        WHERE CAST(minute_bucket AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM logs) - INTERVAL 2 MINUTE""",
)
def stream_anomalies(spark, sf):
    base = run_dir(spark, "stream-anomalies")
    signals = jobs.windowed_signals(log_stream(spark, sf), width="1 day")
    detect = dict(volume_min_count=3, ratio=1.5, delta=1, burst_min_count=2, lookback=_LAX["lookback"])
    jobs.run_available(signals, f"{base}/checkpoint", batch=jobs.signal_sink(base, "day", detect))
    return _anomaly_columns(jobs.read_table(spark, base, "anomaly_events", ANOMALY_EVENTS))


@query(
    "stream_catalog",
    f"""WITH {q.FINGERPRINTED} SELECT fingerprint, {q.ts('min(fp.timestamp)', 'first_seen')},
        {q.ts('max(fp.timestamp)', 'last_seen')}, count(*) AS occurrence_count FROM fp GROUP BY fingerprint""",
)
def stream_catalog(spark, sf):
    base = run_dir(spark, "stream-catalog")
    jobs.run_available(log_stream(spark, sf), f"{base}/checkpoint", batch=jobs.catalog_sink(base))
    return jobs.catalog_state(spark, base).select("fingerprint", ts_text("first_seen"), ts_text("last_seen"), "occurrence_count")


@query(
    "stream_catch_up",
    f"""WITH {q.FINGERPRINTED}, late AS (SELECT * FROM fp WHERE fp.timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 10 DAY)
        SELECT fingerprint, {q.ts('min(late.timestamp)', 'first_seen')}, {q.ts('max(late.timestamp)', 'last_seen')},
        count(*) AS occurrence_count FROM late GROUP BY fingerprint""",
)
def stream_catch_up(spark, sf):
    """The catalog of a job that starts ten days back and catches up in batches of two files, with a restart between."""
    base = run_dir(spark, "stream-catch-up")
    logs = views.logs(spark, sf)
    days = logs.repartitionByRange(12, "timestamp")
    days.write.parquet(f"{base}/logs")
    now = logs.agg(F.max("timestamp")).first()[0]
    for _ in range(2):
        start = jobs.first_start(spark, f"{base}/checkpoint", now, timedelta(days=10))
        source = jobs.log_files(spark, f"{base}/logs", logs.schema, start=start, max_files=2)
        jobs.run_available(source, f"{base}/checkpoint", batch=jobs.catalog_sink(base, every=3))
    return jobs.catalog_state(spark, base).select("fingerprint", ts_text("first_seen"), ts_text("last_seen"), "occurrence_count")


@query("stream_incidents", INCIDENT_SESSIONS_SQL)
def stream_incidents(spark, sf):
    """Incidents, open ones included, of a job that is started anew for each third of the candidates' time."""
    base = run_dir(spark, "stream-incidents")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    found = day_candidates(spark, sf)
    found.write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    first, last = found.agg(F.min("start_time"), F.max("start_time")).first()
    cuts = [] if first is None else [first + (last - first) / 3, first + (last - first) * 2 / 3]
    for k in range(len(cuts) + 1):
        after, until = ([None, *cuts][k], [*cuts, None][k])
        part = found.where((F.lit(after is None) | (F.col("start_time") > F.lit(after))) & (F.lit(until is None) | (F.col("start_time") <= F.lit(until))))
        part.write.mode("append").parquet(f"{base}/candidates")
        source = jobs.log_files(spark, f"{base}/candidates", found.schema)
        jobs.run_available(jobs.incident_lifecycle(source, gap_minutes=3 * 1440), f"{base}/checkpoint", path=f"{base}/out")
    rows = jobs.latest_snapshots(spark.read.schema(jobs.SESSION_SCHEMA).parquet(f"{base}/out"))
    return rows.select(
        *INCIDENT_KEY, ts_text("session_start"), ts_text("session_end"), "candidates", "signal_count", F.round("max_score", 6).alias("max_score")
    )


@query("stream_templates")
def stream_templates(spark, sf):
    base = run_dir(spark, "stream-templates")
    jobs.run_available(log_stream(spark, sf), f"{base}/checkpoint", batch=jobs.template_sink(base))
    return spark.read.parquet(f"{base}/template_rows").drop("batch")


@query(
    "stream_dedup",
    f"""WITH {_HISTORY}, found AS ({_SPIKE} UNION ALL {_BURST}) SELECT anomaly_id, anomaly_type FROM found""",
)
def stream_dedup(spark, sf):
    from lumenlog.functions import enrich as en
    from lumenlog.operators import anomalies as an
    from lumenlog.operators import signals as sg

    base = run_dir(spark, "stream-dedup")
    rows = sg.signals(en.enrich_with_fingerprint(views.logs(spark, sf)), "day")
    found = an.signal_anomalies(
        rows, rows, volume_min_count=3, ratio=1.5, delta=1, burst_min_count=2, **_LAX
    )
    for _ in range(2):  # a repeated run writes the same anomalies again
        found.write.mode("append").parquet(f"{base}/anomalies")
    schema = spark.read.parquet(f"{base}/anomalies").schema
    source = spark.readStream.schema(schema).parquet(f"{base}/anomalies")
    jobs.run_available(jobs.distinct_anomalies(source, "60 days"), f"{base}/checkpoint", path=f"{base}/out")
    return spark.read.parquet(f"{base}/out").select("anomaly_id", "anomaly_type")
