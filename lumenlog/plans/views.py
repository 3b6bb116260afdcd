"""Views over the given tables that the registered queries read.

``SQL_*`` texts are the same mappings for the SQL side of the result check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = [
    "checkout", "identity", "catalogue", "ledger-db",
    "storefront-ui", "mailer", "lookup", "edge-router",
]

# Tables whose rows cost much work each.
SPREAD = {"events", "orders", "documents", "pages"}

# One mapping text for both engines; {ts} and {service} differ by dialect.
_LOGS = """
SELECT event_id AS log_id,
       {ts} AS timestamp,
       'web' AS product,
       {service} AS service,
       CASE WHEN user_id % 3 < 2 THEN 'prod' ELSE 'qa' END AS environment,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'warn'
                       WHEN 'signup' THEN 'notice' ELSE ' Info ' END AS level,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 503
            WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status_code,
       CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('t', CAST(FLOOR(event_id / 4) AS BIGINT)) END
           AS trace_id,
       CASE
         WHEN event_type = 'error' AND event_id % 4 = 0 THEN
           concat('Connection to 10.', user_id % 256, '.', event_id % 251,
                  '.7:5432 refused after ', event_id % 9 + 1, ' retries')
         WHEN event_type = 'error' AND event_id % 4 = 1 THEN
           concat('Query timeout for shard ', user_id, ' after ',
                  CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(30)), 'ms')
         WHEN event_type = 'error' AND event_id % 4 = 2 THEN
           concat('Unhandled exception in worker 0x', lower(hex(event_id)),
                  ': ''code ', event_id % 13, '''')
         WHEN event_type = 'error' THEN
           concat('Disk ', user_id % 100, '% full on volume "vol-', user_id % 5, '"')
         WHEN event_type = 'purchase' THEN
           concat('Payment of ', CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(30)),
                  ' EUR captured for order ', substr(md5(CAST(event_id AS VARCHAR(30))), 1, 8), '-',
                  substr(md5(CAST(event_id AS VARCHAR(30))), 9, 4), '-4',
                  substr(md5(CAST(event_id AS VARCHAR(30))), 14, 3), '-8',
                  substr(md5(CAST(event_id AS VARCHAR(30))), 18, 3), '-',
                  substr(md5(CAST(event_id AS VARCHAR(30))), 21, 12))
         WHEN event_type = 'signup' THEN
           concat('New account ', user_id, ' created from 192.168.', user_id % 256, '.', event_id % 256)
         WHEN event_type = 'click' THEN
           concat('  Clicked link ', event_id % 97, '   at position x', event_id % 640, ' ')
         ELSE concat('Rendered page ', event_id % 97, ' in ',
                     CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(30)), 'ms')
       END AS message,
       CASE WHEN event_id % 11 = 0
              THEN concat(chr(123), '"layer": " Network-edge ", "k": ', user_id, chr(125))
            WHEN event_id % 13 = 0 THEN concat(chr(123), 'bad json')
            ELSE props END AS metadata,
       event_type, value, user_id
FROM events
"""

_PICK = "CASE {col} % 8 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(SERVICES)
) + " END"

_INCIDENTS = """
SELECT concat('inc-', CAST(o_orderkey AS VARCHAR(30))) AS incident_id,
       o_orderkey, o_custkey, o_totalprice,
       {service} AS service,
       CASE o_custkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'qa' ELSE 'staging' END AS environment,
       CASE o_orderkey % 7 WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' WHEN 2 THEN 'database'
            WHEN 3 THEN 'network' WHEN 4 THEN 'infrastructure' WHEN 5 THEN 'os_system'
            ELSE 'unknown' END AS category,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'error'
            WHEN '3' THEN 'warning' WHEN '4' THEN 'info' ELSE 'debug' END AS severity,
       CASE WHEN o_orderstatus = 'F' THEN 'resolved'
            WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'mitigated'
            WHEN o_orderstatus = 'P' THEN 'acknowledged'
            WHEN o_orderkey % 7 = 0 THEN 'reopened' ELSE 'open' END AS status,
       {ts} AS opened_at
FROM orders
"""

_INCIDENTS_FULL = """
SELECT *,
       CASE WHEN o_orderkey % 10 = 0
            THEN concat('Manual ', CAST(o_custkey % 50 AS VARCHAR(30)), ' outage of ', service, ' reported')
            ELSE concat(service, ':', category, ':', severity, ' anomaly') END AS title,
       sha1(concat(service, '|', category, '|', CAST(o_custkey % 20 AS VARCHAR(30)))) AS fingerprint,
       CAST(o_orderkey % 5 + 1 AS INT) AS affected_services,
       o_totalprice / 1000.0 AS impact_score,
       CAST(o_totalprice / 10000.0 AS DOUBLE) AS burn_rate_1h,
       {updated} AS updated_at
FROM ({base}) i
"""


def sql_logs() -> str:
    return _LOGS.format(ts="ts", service=_PICK.format(col="user_id"))


def sql_incidents() -> str:
    base = _INCIDENTS.format(ts="o_orderdate", service=_PICK.format(col="o_custkey"))
    updated = "opened_at + to_minutes(CAST(o_orderkey % 1440 AS INT))"
    return _INCIDENTS_FULL.format(base=base, updated=updated)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. An input too small to give every core a split is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as raw logs."""
    return logs_from_events(table(spark, sf_dir, "events"))


def logs_from_events(events: DataFrame) -> DataFrame:
    """The log mapping over any batch or streaming ``events`` frame."""
    text = _LOGS.format(ts="CAST(ts AS TIMESTAMP)", service=_PICK.format(col="user_id"))
    return events.sparkSession.sql(text.replace("FROM events", "FROM {events}"), events=events)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``orders`` table as latest incident cards."""
    base = _INCIDENTS.format(
        ts="CAST(o_orderdate AS TIMESTAMP)", service=_PICK.format(col="o_custkey")
    ).replace("FROM orders", "FROM {orders}")
    updated = "opened_at + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0)"
    text = _INCIDENTS_FULL.format(base=base, updated=updated)
    df = spark.sql(text, orders=table(spark, sf_dir, "orders"))
    return df.withColumn("version", F.unix_micros("updated_at"))


_VERSIONS = """
SELECT concat('inc-', CAST(user_id AS VARCHAR(30))) AS incident_id, event_id AS version, user_id,
       CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'mitigated'
            WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'reopened' ELSE 'open' END AS status,
       {service} AS service,
       CASE WHEN user_id % 3 < 2 THEN 'prod' ELSE 'qa' END AS environment,
       CASE user_id % 3 WHEN 0 THEN 'backend' WHEN 1 THEN 'database' ELSE 'network' END AS category,
       CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'warning'
            WHEN 3 THEN 'info' ELSE 'debug' END AS severity,
       sha1(concat('fp-', CAST(user_id AS VARCHAR(30)))) AS fingerprint,
       concat('Case ', CAST(user_id AS VARCHAR(30)), ' in ', {service}) AS title,
       {ts} AS opened_at, {ts} AS last_seen_at, {ts} AS updated_at, {ts} AS created_at,
       CASE WHEN event_type = 'purchase' THEN {ts} END AS resolved_at,
       CAST(event_id % 4 + 1 AS INT) AS affected_services, value AS impact_score, value / 10.0 AS burn_rate_1h,
       concat(chr(123), '"custom": ', CAST(event_id AS VARCHAR(30)), ', "last_signal_count": 1', chr(125)) AS context_json
FROM events
"""

_INCIDENT_EVENTS = """
SELECT concat('evt-', CAST(event_id AS VARCHAR(30))) AS event_id,
       concat('inc-', CAST(user_id AS VARCHAR(30))) AS incident_id,
       CASE event_type WHEN 'error' THEN 'candidate_attached' WHEN 'signup' THEN 'opened'
            WHEN 'purchase' THEN 'reopened' WHEN 'view' THEN 'rca_recomputed' ELSE 'acknowledged' END AS event_type,
       {ts} AS event_time, 'harness' AS actor,
       CASE WHEN event_type = 'error' AND event_id % 23 = 0 THEN 'not json'
            WHEN event_type = 'error' THEN concat(chr(123), '"candidate_id": "c', CAST(event_id AS VARCHAR(30)),
              '", "trace_ids": ["t', CAST(CAST(FLOOR(event_id / 4) AS BIGINT) AS VARCHAR(30)), '", "t',
              CAST(CAST(FLOOR(event_id / 40) AS BIGINT) AS VARCHAR(30)), '", ""], "anomaly_score": ',
              CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(30)), chr(125))
            WHEN event_type = 'view' THEN concat(chr(123), '"root_cause_service": "lookup", "root_cause_score": 0.5', chr(125))
            ELSE concat(chr(123), chr(125)) END AS payload
FROM events
"""


def _events_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    sql = text.format(ts="CAST(ts AS TIMESTAMP)", service=_PICK.format(col="user_id"))
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def incident_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as incident snapshots, one version per event."""
    return _events_sql(spark, sf_dir, _VERSIONS)


def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the incident event log."""
    return _events_sql(spark, sf_dir, _INCIDENT_EVENTS)


def sql_incident_versions() -> str:
    return _VERSIONS.format(ts="ts", service=_PICK.format(col="user_id"))


def sql_incident_events() -> str:
    return _INCIDENT_EVENTS.format(ts="ts", service="")
