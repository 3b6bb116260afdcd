"""One explicit schema per stored table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "TIMESTAMP": TimestampType(),
    "STRING": StringType(),
    "INT": IntegerType(),
    "BIGINT": LongType(),
    "DOUBLE": DoubleType(),
    "ARRAY<STRING>": ArrayType(StringType()),
}


def _schema(columns: str) -> StructType:
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SIGNAL_DIMS = ["service", "environment", "category", "severity", "fingerprint"]

LOGS = _schema(
    "timestamp TIMESTAMP, product STRING, service STRING, environment STRING, level STRING, "
    "status_code INT, trace_id STRING, message STRING, metadata STRING"
)
LOG_SIGNALS = _schema(
    "service STRING, environment STRING, category STRING, severity STRING, fingerprint STRING, "
    "minute_bucket TIMESTAMP, count BIGINT, created_at TIMESTAMP"
)
FINGERPRINT_CATALOG = _schema(
    "fingerprint STRING, service STRING, category STRING, message_template STRING, "
    "example_message STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, occurrence_count BIGINT, "
    "version BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP"
)
ANOMALY_EVENTS = _schema(
    "anomaly_id STRING, anomaly_type STRING, service STRING, environment STRING, category STRING, "
    "severity STRING, fingerprint STRING, minute_bucket TIMESTAMP, signal_count BIGINT, "
    "baseline_count DOUBLE, history_samples BIGINT, history_total BIGINT, score DOUBLE, "
    "evidence_json STRING, created_at TIMESTAMP"
)
INCIDENT_CANDIDATES = _schema(
    "candidate_id STRING, incident_id STRING, fingerprint STRING, service STRING, "
    "environment STRING, category STRING, severity STRING, normalized_message STRING, "
    "start_time TIMESTAMP, end_time TIMESTAMP, signal_count BIGINT, anomaly_score DOUBLE, "
    "trace_ids ARRAY<STRING>, source_signals ARRAY<STRING>, status STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
INCIDENTS = _schema(
    "incident_id STRING, version BIGINT, fingerprint STRING, title STRING, status STRING, "
    "service STRING, environment STRING, category STRING, severity STRING, opened_at TIMESTAMP, "
    "acknowledged_at TIMESTAMP, mitigated_at TIMESTAMP, resolved_at TIMESTAMP, "
    "last_seen_at TIMESTAMP, root_cause_service STRING, root_cause_score DOUBLE, "
    "impact_score DOUBLE, burn_rate_5m DOUBLE, burn_rate_1h DOUBLE, burn_rate_6h DOUBLE, "
    "affected_services INT, critical_rate DOUBLE, prod_weight DOUBLE, evidence ARRAY<STRING>, "
    "context_json STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
INCIDENT_EVENTS = _schema(
    "event_id STRING, incident_id STRING, event_type STRING, event_time TIMESTAMP, actor STRING, "
    "payload STRING, created_at TIMESTAMP"
)
DEPENDENCY_GRAPH = _schema(
    "edge_id STRING, source_service STRING, target_service STRING, criticality DOUBLE, "
    "updated_at TIMESTAMP"
)
SLO_BURN = _schema(
    "burn_id STRING, window_start TIMESTAMP, window_size STRING, service STRING, "
    "environment STRING, error_count BIGINT, total_count BIGINT, error_ratio DOUBLE, "
    "error_budget_consumption DOUBLE, created_at TIMESTAMP"
)

TABLES = {
    "logs": LOGS,
    "log_signals_1m": LOG_SIGNALS,
    "fingerprint_catalog": FINGERPRINT_CATALOG,
    "anomaly_events": ANOMALY_EVENTS,
    "incident_candidates": INCIDENT_CANDIDATES,
    "incidents": INCIDENTS,
    "incident_events": INCIDENT_EVENTS,
    "service_dependency_graph": DEPENDENCY_GRAPH,
    "slo_burn": SLO_BURN,
}

# Column each table is partitioned on by day, and its sort order inside a file.
TABLE_LAYOUT = {
    "logs": ("timestamp", ["service", "environment", "timestamp"]),
    "log_signals_1m": ("minute_bucket", ["service", "environment", "minute_bucket"]),
    "fingerprint_catalog": ("updated_at", ["fingerprint", "version"]),
    "anomaly_events": ("minute_bucket", ["service", "environment", "minute_bucket"]),
    "incident_candidates": ("start_time", ["service", "environment", "start_time"]),
    "incidents": ("updated_at", ["incident_id", "version"]),
    "incident_events": ("event_time", ["incident_id", "event_time"]),
    "service_dependency_graph": ("updated_at", ["source_service", "target_service"]),
    "slo_burn": ("window_start", ["service", "environment", "window_start"]),
}


def conform(df, schema: StructType):
    """Project ``df`` onto ``schema``: same columns, order and types; missing ones are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
