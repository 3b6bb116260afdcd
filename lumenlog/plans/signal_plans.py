"""Queries over signals: counts, baselines, anomalies, SLO burn and detector evaluation.

The given events are sparse (about one row every few minutes), so the harness counts per day
and uses lower thresholds; the operators' defaults are per minute.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import enrich as en
from lumenlog.functions.ids import ref_column
from lumenlog.operators import anomalies as an
from lumenlog.operators import signals as sg
from lumenlog.operators import slo
from lumenlog.operators.stats import median_mad
from lumenlog.plans import sql as q
from lumenlog.plans import views
from lumenlog.plans.log_plans import now
from lumenlog.plans.registry import query, r6, ts_text

DIMS = "service, environment, category, severity, fingerprint"
NOW = "(SELECT max(timestamp) FROM logs)"


def _fp(spark, sf):
    return en.enrich_with_fingerprint(views.logs(spark, sf))


@query("signals_1m", f"WITH {q.signals('minute')} SELECT {DIMS}, {q.ts('minute_bucket')}, count FROM signals")
def signals_1m(spark, sf):
    return sg.signals(_fp(spark, sf)).withColumn("minute_bucket", ts_text("minute_bucket"))


@query(
    "top_signals",
    f"""WITH {q.signals('day')} SELECT service, category, severity, fingerprint, {q.ts('minute_bucket')}, count
        FROM signals ORDER BY count DESC, signals.minute_bucket, {DIMS} LIMIT 100""",
)
def top_signals(spark, sf):
    rows = sg.signals(_fp(spark, sf), "day")
    top = rows.orderBy(F.desc("count"), "minute_bucket", *sg.SIGNAL_DIMS).limit(100)
    return top.select("service", "category", "severity", "fingerprint", ts_text("minute_bucket"), "count")


@query(
    "signal_rescan",
    f"""WITH {q.signals('hour')} SELECT {DIMS}, {q.ts('minute_bucket')}, count FROM signals
        WHERE signals.minute_bucket >= TIMESTAMP '2024-01-05' AND signals.minute_bucket < TIMESTAMP '2024-01-20'""",
)
def signal_rescan(spark, sf):
    once = sg.signals(_fp(spark, sf), "hour").withColumn("created_at", ref_column("2024-02-01 00:00:00"))
    replay = once.withColumn("created_at", ref_column("2024-02-02 00:00:00"))
    rows = sg.rescan_signals(
        once.unionByName(replay), ref_column("2024-01-05 00:00:00"), ref_column("2024-01-20 00:00:00")
    )
    return rows.withColumn("minute_bucket", ts_text("minute_bucket"))


@query(
    "history_stats",
    f"""WITH {q.signals('day')}, h AS (SELECT {DIMS}, count(*) AS history_samples, sum(count) AS history_total,
          avg(count) AS history_avg, list_sort(list(count)) AS xs, max(count) AS history_max FROM signals
          WHERE minute_bucket >= TIMESTAMP '2024-01-03' AND minute_bucket < TIMESTAMP '2024-01-25' GROUP BY ALL)
        SELECT {DIMS}, history_samples, CAST(history_total AS BIGINT) AS history_total,
          round(history_avg, 6) AS history_avg,
          CAST(xs[CAST(floor(history_samples * 0.5) AS BIGINT) + 1] AS DOUBLE) AS history_median, history_max FROM h""",
)
def history_stats(spark, sf):
    rows = sg.signals(_fp(spark, sf), "day")
    stats = sg.history_stats(rows, ref_column("2024-01-03 00:00:00"), ref_column("2024-01-25 00:00:00"))
    return stats.withColumn("history_avg", r6("history_avg"))


@query(
    "window_counts",
    f"""WITH {q.ENRICHED} SELECT {q.ts("date_trunc('minute', timestamp)", 'window')}, service, category, severity,
        count(*) AS count FROM enriched GROUP BY ALL""".replace("AS window", 'AS "window"'),
)
def window_counts(spark, sf):
    rows = an.window_counts(en.enrich(views.logs(spark, sf)))
    return rows.withColumn("window", ts_text("window"))


_WINDOWS = f"""{q.ENRICHED},
w AS (SELECT date_trunc('day', timestamp) AS win, service, category, severity, count(*) AS c
      FROM enriched GROUP BY ALL),
med AS (SELECT service, category, severity, median(c) AS med, avg(c) AS mean, count(*) AS n FROM w GROUP BY ALL),
mad AS (SELECT service, category, severity, median(abs(c - med)) AS mad
        FROM w JOIN med USING (service, category, severity) GROUP BY ALL),
scored AS (SELECT *, 0.6745 * abs(c - med) / (CASE WHEN mad > 0 THEN mad ELSE greatest(mean * 0.01, 0.1) END) AS z
           FROM w JOIN med USING (service, category, severity) JOIN mad USING (service, category, severity)),
anomalies AS (SELECT * FROM scored WHERE n >= 5 AND z >= 2.0 AND c > med)"""


def _day_anomalies(spark, sf):
    return an.mad_anomalies(an.window_counts(en.enrich(views.logs(spark, sf)), "day"), threshold=2.0)


@query(
    "mad_anomalies",
    f"""WITH {_WINDOWS} SELECT {q.ts('win', 'window')}, service, category, severity, c AS count, round(z, 6) AS z,
        round(med, 6) AS baseline_median, round(mad, 6) AS baseline_mad FROM anomalies""".replace(
        "AS window", 'AS "window"'
    ),
)
def mad_anomalies(spark, sf):
    rows = _day_anomalies(spark, sf)
    return rows.select(
        ts_text("window"), "service", "category", "severity", "count", r6("z"), "baseline_median", "baseline_mad"
    )


@query(
    "median_mad",
    f"""WITH {_WINDOWS} SELECT service, category, severity, round(med, 6) AS median, round(mad, 6) AS mad,
        round(mean, 6) AS mean, n AS samples FROM med JOIN mad USING (service, category, severity)""",
)
def series_median_mad(spark, sf):
    rows = median_mad(an.window_counts(en.enrich(views.logs(spark, sf)), "day"), an.SERIES, "count")
    return rows.select(*an.SERIES, r6("median"), r6("mad"), r6("mean"), "samples")


@query("anomaly_by_service", f"WITH {_WINDOWS} SELECT service, round(max(z), 6) AS max_z FROM anomalies GROUP BY service")
def anomaly_by_service(spark, sf):
    return an.score_by_service(_day_anomalies(spark, sf)).select("service", r6("max_z"))


@query(
    "first_anomaly",
    f"WITH {_WINDOWS} SELECT service, {q.ts('min(win)', 'first_anomaly')} FROM anomalies GROUP BY service",
)
def first_anomaly(spark, sf):
    return an.first_anomaly(_day_anomalies(spark, sf)).select("service", ts_text("first_anomaly"))


_HISTORY = f"""{q.signals('day')},
h AS (SELECT s.service, s.environment, s.category, s.severity, s.fingerprint, s.minute_bucket, s.count,
             count(p.count) AS samples, coalesce(sum(p.count), 0) AS total, coalesce(avg(p.count), 0.0) AS mean,
             list_sort(list(p.count) FILTER (p.count IS NOT NULL)) AS xs, coalesce(max(p.count), 0) AS mx
      FROM signals s LEFT JOIN signals p
        ON p.service = s.service AND p.environment = s.environment AND p.category = s.category
       AND p.severity = s.severity AND p.fingerprint = s.fingerprint
       AND p.minute_bucket < s.minute_bucket AND p.minute_bucket >= s.minute_bucket - INTERVAL 10 DAY
      GROUP BY ALL),
hist AS (SELECT * EXCLUDE (xs), CAST(coalesce(xs[CAST(floor(samples * 0.5) AS BIGINT) + 1], 0) AS DOUBLE) AS med FROM h)"""
_LAX = dict(lookback=10, bucket="day")


@query(
    "trailing_baseline",
    f"""WITH {_HISTORY} SELECT {DIMS}, {q.ts('minute_bucket')}, count, samples AS history_samples,
        CAST(total AS BIGINT) AS history_total, round(mean, 6) AS history_avg, med AS history_median,
        mx AS history_max FROM hist""",
)
def trailing_baseline(spark, sf):
    rows = sg.signals(_fp(spark, sf), "day")
    out = an.with_history(rows, rows, 10, "day")
    return out.withColumns({"minute_bucket": ts_text("minute_bucket"), "history_avg": r6("history_avg")})


_ANOM_ID = (
    "'anom_' || sha1('{kind}|' || strftime(minute_bucket, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || service || '|' "
    "|| environment || '|' || category || '|' || severity || '|' || fingerprint)"
)
_SPIKE = f"""SELECT {_ANOM_ID.format(kind='volume_spike')} AS anomaly_id, 'volume_spike' AS anomaly_type, {DIMS},
 {q.ts('minute_bucket')}, count AS signal_count, greatest(med, 1.0) AS baseline_count, samples AS history_samples,
 CAST(total AS BIGINT) AS history_total, round(count / greatest(med, 1.0), 2) AS score FROM hist
 WHERE samples >= 5 AND count >= 3 AND count / greatest(med, 1.0) >= 1.5 AND count - med >= 1"""
_BURST = f"""SELECT {_ANOM_ID.format(kind='new_fingerprint_burst')} AS anomaly_id,
 'new_fingerprint_burst' AS anomaly_type, {DIMS}, {q.ts('minute_bucket')}, count AS signal_count,
 round(mean, 6) AS baseline_count, samples AS history_samples, CAST(total AS BIGINT) AS history_total,
 round(count / (total + 1.0), 2) AS score FROM hist WHERE count >= 2 AND total <= 3"""


def _anomaly_columns(df):
    return df.select(
        "anomaly_id", "anomaly_type", *sg.SIGNAL_DIMS, ts_text("minute_bucket"), "signal_count",
        r6("baseline_count"), "history_samples", "history_total", F.round("score", 2).alias("score"),
    )


@query("volume_spikes", f"WITH {_HISTORY} {_SPIKE}")
def volume_spikes(spark, sf):
    rows = sg.signals(_fp(spark, sf), "day")
    hist = an.with_history(rows.where("count >= 3"), rows, 10, "day")
    return _anomaly_columns(an.volume_spikes(hist, min_count=3, ratio=1.5, delta=1, **_LAX))


@query("new_fingerprint_bursts", f"WITH {_HISTORY} {_BURST}")
def new_fingerprint_bursts(spark, sf):
    rows = sg.signals(_fp(spark, sf), "day")
    hist = an.with_history(rows.where("count >= 2"), rows, 10, "day")
    return _anomaly_columns(an.new_fingerprint_bursts(hist, min_count=2, **_LAX))


@query("signal_anomalies", f"WITH {_HISTORY} {_SPIKE} UNION ALL {_BURST}")
def signal_anomalies(spark, sf):
    rows = sg.signals(_fp(spark, sf), "day")
    return _anomaly_columns(
        an.signal_anomalies(rows, rows, volume_min_count=3, ratio=1.5, delta=1, burst_min_count=2, **_LAX)
    )


_DETECT = f"""{q.FINGERPRINTED},
s AS (SELECT date_trunc('day', timestamp) AS minute, {DIMS}, message_template, count(*) AS signal_count,
             coalesce((max({{'t': timestamp, 'id': trace_id}}) FILTER (trace_id <> '')).id, '') AS trace_sample
      FROM fp GROUP BY ALL),
med AS (SELECT service, environment, category, severity, median(signal_count) AS med FROM s GROUP BY ALL),
mad AS (SELECT service, environment, category, severity, median(abs(signal_count - med)) AS mad
        FROM s JOIN med USING (service, environment, category, severity) GROUP BY ALL),
z AS (SELECT *, CASE WHEN mad <= 1e-9 THEN CASE WHEN signal_count <= med THEN 0.0
                     ELSE 0.6745 * (signal_count - med) / greatest(1.0, 0.5 * med) END
                ELSE 0.6745 * (signal_count - med) / mad END AS robust_z,
          'sig_' || sha1(strftime(minute, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || service || '|' || environment
             || '|' || category || '|' || severity || '|' || fingerprint) AS signal_id
      FROM s JOIN med USING (service, environment, category, severity)
             JOIN mad USING (service, environment, category, severity))"""


@query(
    "detector_signals",
    f"""WITH {_DETECT} SELECT {q.ts('minute')}, {DIMS}, message_template AS normalized_message, signal_count,
        trace_sample FROM s""",
)
def detector_signals(spark, sf):
    return an.detector_signals(_fp(spark, sf), "day").withColumn("minute", ts_text("minute"))


def day_candidates(spark, sf, threshold=2.0):
    scored = an.score_signals(an.detector_signals(_fp(spark, sf), "day"), threshold)
    return an.detector_candidates(scored, ref_column("2024-02-01 00:00:00"))


CANDIDATES_SQL = f"""{_DETECT},
cand AS (SELECT 'cand_' || sha1(signal_id) AS candidate_id, {DIMS}, message_template AS normalized_message, minute,
                signal_count, greatest(robust_z, 0.0) AS anomaly_score, trace_sample, signal_id
         FROM z WHERE robust_z >= 2.0)"""


@query(
    "detector_candidates",
    f"""WITH {CANDIDATES_SQL} SELECT candidate_id, {DIMS}, normalized_message, {q.ts('minute', 'start_time')},
        signal_count, round(anomaly_score, 6) AS anomaly_score, trace_sample AS trace_ids,
        signal_id AS source_signals, 'new' AS status FROM cand""",
)
def detector_candidates(spark, sf):
    return day_candidates(spark, sf).select(
        "candidate_id", *sg.SIGNAL_DIMS, "normalized_message", ts_text("start_time"), "signal_count",
        r6("anomaly_score"), F.array_join("trace_ids", ",").alias("trace_ids"),
        F.array_join("source_signals", ",").alias("source_signals"), "status",
    )


_BURN_WINDOWS = {"5m": 5 * 1440, "1h": 10 * 1440, "6h": 20 * 1440}


def _burn_sql(name: str, minutes: int) -> str:
    return f"""SELECT '{name}' AS window_size, service, environment,
      date_trunc('minute', {NOW} - INTERVAL {minutes} MINUTE) AS window_start,
      count(*) FILTER (timestamp >= {NOW} - INTERVAL {minutes} MINUTE) AS total_count,
      count(*) FILTER (timestamp >= {NOW} - INTERVAL {minutes} MINUTE AND severity IN ('error', 'critical'))
        AS error_count FROM enriched GROUP BY service, environment"""


BURN_SQL = f"""{q.ENRICHED}, burn0 AS ({' UNION ALL '.join(_burn_sql(n, m) for n, m in _BURN_WINDOWS.items())}),
burn AS (SELECT *, CASE WHEN total_count > 0 THEN error_count / total_count ELSE 0.0 END AS error_ratio FROM burn0)"""


def day_burn(spark, sf):
    logs = views.logs(spark, sf)
    return slo.slo_burn(en.enrich(logs), now(logs), _BURN_WINDOWS)


@query(
    "slo_burn",
    f"""WITH {BURN_SQL} SELECT service, environment, window_size, {q.ts('window_start')}, error_count, total_count,
        round(error_ratio, 6) AS error_ratio, round(error_ratio / greatest(1e-6, 1.0 - 0.999), 4)
        AS error_budget_consumption FROM burn""",
)
def slo_burn(spark, sf):
    return day_burn(spark, sf).select(
        "service", "environment", "window_size", ts_text("window_start"), "error_count", "total_count",
        r6("error_ratio"), F.round("error_budget_consumption", 4).alias("error_budget_consumption"),
    )


def _pivot_sql(name: str) -> str:
    return f"round(max(CASE WHEN window_size = '{name}' THEN error_ratio / 0.001 END), 4) AS burn_rate_{name}"


@query(
    "burn_triplet",
    f"""WITH {BURN_SQL} SELECT service, environment, {', '.join(_pivot_sql(n) for n in _BURN_WINDOWS)}
        FROM burn GROUP BY service, environment""",
)
def burn_triplet(spark, sf):
    fresh = day_burn(spark, sf)
    stale = fresh.withColumns(
        {"created_at": F.col("created_at") - F.expr("INTERVAL 1 DAY"), "error_budget_consumption": F.lit(-1.0)}
    )
    wide = slo.burn_triplet(fresh.unionByName(stale))
    return wide.select(
        "service", "environment", *[F.round(f"burn_rate_{n}", 4).alias(f"burn_rate_{n}") for n in _BURN_WINDOWS]
    )


def _level_sql(cols: dict[str, str]) -> str:
    whens = " ".join(
        f"WHEN e_{label} / greatest(t_{label}, 1) / greatest(1.0 - 0.999, 1e-9) > {slo.ALERT_WINDOWS[label]} "
        f"THEN '{slo.ALERT_LEVELS[label]}'"
        for label in slo.ALERT_WINDOWS
    )
    return f"CASE {whens} ELSE 'none' END"


def _counts(status):
    cols = []
    for i, label in enumerate(slo.ALERT_WINDOWS):
        w = F.col("windows")[i]
        cols += [w["error_count"].alias(f"e_{label}"), w["total_count"].alias(f"t_{label}"),
                 F.round(w["burn_rate"], 4).alias(f"burn_{label}"), w["is_burning"].alias(f"hot_{label}")]
    return status.select("service", "alert_level", *cols)


def _counts_sql() -> str:
    cols = []
    for label, threshold in slo.ALERT_WINDOWS.items():
        burn = f"e_{label} / greatest(t_{label}, 1) / greatest(1.0 - 0.999, 1e-9)"
        cols += [f"CAST(e_{label} AS BIGINT) AS e_{label}", f"CAST(t_{label} AS BIGINT) AS t_{label}",
                 f"round({burn}, 4) AS burn_{label}", f"{burn} > {threshold} AS hot_{label}"]
    return ", ".join(cols)


_TAIL = {"1h": "1.0/24", "6h": "6.0/24", "24h": "1.0"}


@query(
    "slo_status",
    f"""WITH {q.ENRICHED}, r AS (SELECT service, severity IN ('error', 'critical') AS err,
          row_number() OVER (PARTITION BY service ORDER BY timestamp, log_id) - 1 AS i,
          count(*) OVER (PARTITION BY service) AS n FROM enriched),
        c AS (SELECT service, {', '.join(
            f"count(*) FILTER (i >= floor(n * (1.0 - CAST({f} AS DOUBLE)))) AS t_{k}, "
            f"count(*) FILTER (err AND i >= floor(n * (1.0 - CAST({f} AS DOUBLE)))) AS e_{k}"
            for k, f in _TAIL.items())} FROM r GROUP BY service)
        SELECT service, {_level_sql(_TAIL)} AS alert_level, {_counts_sql()} FROM c""",
)
def slo_status(spark, sf):
    return _counts(slo.order_status(slo.slo_status(en.enrich(views.logs(spark, sf)))))


_TIMED = {"1h": 1440, "6h": 5 * 1440, "24h": 20 * 1440}


@query(
    "slo_status_timed",
    f"""WITH {q.ENRICHED}, c AS (SELECT service, {', '.join(
            f"count(*) FILTER (timestamp >= {NOW} - INTERVAL {m} MINUTE) AS t_{k}, "
            f"count(*) FILTER (severity IN ('error', 'critical') AND timestamp >= {NOW} - INTERVAL {m} MINUTE) AS e_{k}"
            for k, m in _TIMED.items())} FROM enriched GROUP BY service)
        SELECT service, {_level_sql(_TIMED)} AS alert_level, {_counts_sql()} FROM c""",
)
def slo_status_timed(spark, sf):
    logs = views.logs(spark, sf)
    return _counts(slo.slo_status_timed(en.enrich(logs), now(logs), windows=_TIMED))
