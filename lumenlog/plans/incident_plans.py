"""Queries over incidents: reads, lifecycle, similarity and legacy grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import enrich as en
from lumenlog.functions.ids import ref_column
from lumenlog.operators import anomalies as an
from lumenlog.operators import incidents as inc
from lumenlog.operators import postmortem as pm
from lumenlog.operators import similar as sim
from lumenlog.operators import slo
from lumenlog.operators import versioned as ver
from lumenlog.plans import sql as q
from lumenlog.plans import views
from lumenlog.plans.log_plans import now
from lumenlog.plans.registry import query, r6, ts_text
from lumenlog.plans.signal_plans import _DETECT, CANDIDATES_SQL, day_burn, day_candidates
from lumenlog.session import run_dir
from lumenlog.sources import tables

VERSIONS = f"versions AS ({views.sql_incident_versions()})"
EVENTS = f"ievents AS ({views.sql_incident_events()})"
RATE = (
    "CASE severity WHEN 'critical' THEN 1.0 WHEN 'error' THEN 0.7 WHEN 'warning' THEN 0.4 "
    "WHEN 'info' THEN 0.1 WHEN 'debug' THEN 0.05 ELSE 0.1 END"
)


def _latest_versions(spark, sf):
    return ver.latest_by(views.incident_versions(spark, sf), ["incident_id"], "version")


@query(
    "latest_incidents",
    f"""WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY version DESC) AS rn
        FROM versions) SELECT incident_id, version, status, service, severity, {q.ts('resolved_at')} FROM r WHERE rn = 1""",
)
def latest_incidents(spark, sf):
    return _latest_versions(spark, sf).select(
        "incident_id", "version", "status", "service", "severity", ts_text("resolved_at")
    )


@query(
    "dedup_latest",
    f"""WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY service, status ORDER BY version DESC) AS rn
        FROM versions) SELECT service, status, version, incident_id FROM r WHERE rn = 1""",
)
def dedup_latest(spark, sf):
    rows = ver.dedup_latest(views.incident_versions(spark, sf), ["service", "status"], "version")
    return rows.select("service", "status", "version", "incident_id")


@query(
    "latest_candidates",
    f"""WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY updated_at DESC, version DESC)
        AS rn FROM versions) SELECT incident_id AS candidate_id, status, {q.ts('updated_at')} FROM r
        WHERE rn = 1 AND status IN ('new', 'reopened')""",
)
def latest_candidates(spark, sf):
    rows = views.incident_versions(spark, sf).select(
        F.col("incident_id").alias("candidate_id"), "status", "updated_at", F.col("opened_at").alias("start_time")
    )
    pending = inc.pending_candidates(rows, ref_column("2024-01-01 00:00:00"))
    return pending.select("candidate_id", "status", ts_text("updated_at"))


@query(
    "incident_cards",
    f"""WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY version DESC) AS rn
        FROM versions) SELECT incident_id, title, json_extract_string(context_json, '$.custom') AS custom,
        strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S+00:00') AS last_seen_at FROM r WHERE rn = 1""",
)
def incident_cards(spark, sf):
    from lumenlog.functions.ids import iso_utc, json_map

    cards = _latest_versions(spark, sf).withColumn("context", json_map(F.col("context_json")))
    return cards.select(
        "incident_id", "title", F.col("context")["custom"].alias("custom"),
        iso_utc(F.col("last_seen_at")).alias("last_seen_at"),
    )


@query(
    "patch_context",
    f"""WITH {VERSIONS} SELECT incident_id, version, json_extract_string(j, '$.custom') AS custom,
        json_extract_string(j, '$.last_signal_count') AS last_signal_count,
        json_extract_string(j, '$.last_status_note') AS note, len(json_keys(j)) AS n_keys
        FROM (SELECT incident_id, version, json_merge_patch(context_json,
              json_object('last_signal_count', version % 7, 'last_status_note', title)) AS j FROM versions)""",
)
def patch_context(spark, sf):
    patch = F.struct((F.col("version") % 7).alias("last_signal_count"), F.col("title").alias("last_status_note"))
    rows = views.incident_versions(spark, sf).withColumn("j", inc.patch_context(F.col("context_json"), patch))
    return rows.select(
        "incident_id", "version", F.get_json_object("j", "$.custom").alias("custom"),
        F.get_json_object("j", "$.last_signal_count").alias("last_signal_count"),
        F.get_json_object("j", "$.last_status_note").alias("note"),
        F.size(F.json_object_keys("j")).alias("n_keys"),
    )


@query(
    "incident_delete",
    f"""WITH {VERSIONS}, {EVENTS}, gone AS (SELECT DISTINCT incident_id FROM versions WHERE status = 'resolved'
          AND severity = 'critical')
        SELECT 'incidents' AS table_name, incident_id, count(*) AS rows FROM versions ANTI JOIN gone USING (incident_id)
          GROUP BY ALL
        UNION ALL SELECT 'incident_events', incident_id, count(*) FROM ievents ANTI JOIN gone USING (incident_id)
          GROUP BY ALL""",
)
def incident_delete(spark, sf):
    root = run_dir(spark, "delete")
    versions, events = views.incident_versions(spark, sf), views.incident_events(spark, sf)
    tables.append(versions, "incidents", root)
    tables.append(events, "incident_events", root)
    tables.append(day_candidates(spark, sf), "incident_candidates", root)
    gone = versions.where("status = 'resolved' AND severity = 'critical'").select("incident_id").distinct()
    tables.delete_incidents(spark, gone, root)

    def left(name):
        rows = tables.read(spark, name, root).groupBy("incident_id").agg(F.count(F.lit(1)).alias("rows"))
        return rows.select(F.lit(name).alias("table_name"), "incident_id", "rows")

    return left("incidents").unionByName(left("incident_events"))


@query(
    "impact_score",
    f"""WITH {q.INCIDENTS} SELECT incident_id, title, round(greatest(1, affected_services) * {RATE}
        * CASE WHEN environment = 'prod' THEN 1.0 ELSE 0.4 END, 6) AS impact FROM incidents""",
)
def impact_score(spark, sf):
    impact = inc.impact_score(F.col("affected_services"), F.col("severity"), F.col("environment"))
    return views.incidents(spark, sf).select("incident_id", "title", r6(impact, "impact"))


@query(
    "incident_search",
    f"""WITH {q.INCIDENTS} SELECT incident_id, title, status, service FROM incidents
        WHERE environment = 'prod' AND (contains(lower(title), 'ledger') OR contains(lower(fingerprint), 'ledger'))""",
)
def incident_search(spark, sf):
    rows = inc.search_incidents(views.incidents(spark, sf), q="LEDGER", environment="prod")
    return rows.select("incident_id", "title", "status", "service")


@query(
    "incidents_page",
    f"""WITH {q.INCIDENTS} SELECT incident_id, status, {q.ts('updated_at')} FROM incidents
        ORDER BY incidents.updated_at DESC, incident_id LIMIT 50 OFFSET 100""",
)
def incidents_page(spark, sf):
    page = inc.incidents_page(views.incidents(spark, sf), limit=50, offset=100)
    return page.select("incident_id", "status", ts_text("updated_at"))


@query(
    "active_incidents",
    f"""WITH {q.INCIDENTS} SELECT incident_id, status, {q.ts('updated_at')} FROM incidents
        WHERE status IN ('open', 'acknowledged', 'mitigated', 'reopened')
        ORDER BY incidents.updated_at DESC, incident_id LIMIT 200""",
)
def active_incidents(spark, sf):
    rows = inc.active_incidents(views.incidents(spark, sf), 200)
    return rows.select("incident_id", "status", ts_text("updated_at"))


@query(
    "top_impact",
    f"WITH {q.INCIDENTS} SELECT incident_id, impact_score FROM incidents ORDER BY impact_score DESC, incident_id LIMIT 5",
)
def top_impact(spark, sf):
    rows = views.incidents(spark, sf).orderBy(F.desc("impact_score"), "incident_id").limit(5)
    return rows.select("incident_id", "impact_score")


_KPI_SLO = f"""{q.ENRICHED}, c AS (SELECT service, avg(CASE WHEN severity IN ('error', 'critical') AND
 timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 1440 MINUTE THEN 1.0
 WHEN timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 1440 MINUTE THEN 0.0 END) AS r1 FROM enriched GROUP BY service)"""


@query(
    "overview_kpis",
    f"""WITH {q.INCIDENTS}, {_KPI_SLO}, a AS (SELECT * FROM incidents WHERE status <> 'resolved')
        SELECT (SELECT count(*) FROM a) AS active, (SELECT count(*) FROM a WHERE severity = 'critical') AS critical,
        (SELECT count(*) FROM a WHERE severity = 'error') AS error,
        (SELECT count(*) FROM a WHERE severity = 'warning') AS warning,
        (SELECT count(*) FROM c WHERE r1 / 0.001 > 14.4) AS page_alerts,
        (SELECT count(*) FROM c WHERE coalesce(r1, 0) = 0) AS healthy_services""",
)
def overview_kpis(spark, sf):
    logs = views.logs(spark, sf)
    day = {"1h": 1440, "6h": 1440, "24h": 1440}
    status = slo.slo_status_timed(en.enrich(logs), now(logs), windows=day)
    return inc.overview_kpis(views.incidents(spark, sf), status)


@query(
    "incident_timeline",
    f"""WITH {EVENTS} SELECT event_id, event_type, {q.ts('event_time')}, payload FROM ievents
        WHERE incident_id = 'inc-7' ORDER BY ievents.event_time DESC, event_id DESC LIMIT 200""",
)
def incident_timeline(spark, sf):
    rows = inc.incident_timeline(views.incident_events(spark, sf), "inc-7")
    return rows.select("event_id", "event_type", ts_text("event_time"), "payload")


@query(
    "incident_evidence",
    f"""WITH {EVENTS}, page AS (SELECT * FROM ievents WHERE incident_id = 'inc-7'
          AND event_type = 'candidate_attached' ORDER BY event_time DESC, event_id DESC LIMIT 40)
        SELECT event_id, payload FROM page""",
)
def incident_evidence(spark, sf):
    rows = inc.incident_evidence(views.incident_events(spark, sf), "inc-7", limit=40)
    return rows.select("event_id", "payload")


_TRACES = f"""{EVENTS}, tids AS (SELECT incident_id, event_time, event_id, unnest(CAST(json_extract(payload, '$.trace_ids')
   AS VARCHAR[])) AS trace_id FROM ievents WHERE event_type = 'candidate_attached' AND json_valid(payload)),
itraces AS (SELECT incident_id, trace_id, max(event_time) AS mentioned FROM tids WHERE trace_id <> '' GROUP BY ALL)"""


@query(
    "incident_trace_ids",
    f"WITH {_TRACES} SELECT incident_id, trace_id, {q.ts('mentioned')} FROM itraces",
)
def incident_trace_ids(spark, sf):
    rows = inc.incident_trace_ids(views.incident_events(spark, sf))
    return rows.select("incident_id", "trace_id", ts_text("mentioned.event_time", "mentioned"))


TRACE_SERVICES = f"""{q.LOGS}, {_TRACES}, tsvc AS (SELECT incident_id, service, min(timestamp) AS first_seen
   FROM itraces JOIN logs USING (trace_id) WHERE timestamp >= TIMESTAMP '2000-01-01' GROUP BY ALL)"""


def trace_services(spark, sf):
    traces = inc.incident_trace_ids(views.incident_events(spark, sf))
    return inc.trace_services(traces, views.logs(spark, sf), ref_column("2000-01-01 00:00:00"))  # a look-back over all logs


@query("trace_first_seen", f"WITH {TRACE_SERVICES} SELECT incident_id, service, {q.ts('first_seen')} FROM tsvc")
def trace_first_seen(spark, sf):
    return trace_services(spark, sf).select("incident_id", "service", ts_text("first_seen"))


_SESSION_SQL = f"""{CANDIDATES_SQL},
flag AS (SELECT *, minute - lag(minute) OVER k > INTERVAL 3 DAY OR lag(minute) OVER k IS NULL AS opens FROM cand
         WINDOW k AS (PARTITION BY fingerprint, service, environment, category ORDER BY minute, candidate_id)),
sess AS (SELECT *, max(CASE WHEN opens THEN minute END) OVER (PARTITION BY fingerprint, service, environment, category
                   ORDER BY minute, candidate_id) AS session_start FROM flag)"""


INCIDENT_SESSIONS_SQL = f"""WITH {_SESSION_SQL} SELECT fingerprint, service, environment, category, {q.ts('session_start')},
        {q.ts('max(minute)', 'session_end')}, count(*) AS candidates, CAST(sum(signal_count) AS BIGINT) AS signal_count,
        round(max(anomaly_score), 6) AS max_score FROM sess GROUP BY fingerprint, service, environment, category,
        sess.session_start"""


@query("incident_sessions", INCIDENT_SESSIONS_SQL)
def incident_sessions(spark, sf):
    rows = inc.incident_sessions(day_candidates(spark, sf), gap_minutes=3 * 1440)
    return rows.select(
        *inc.INCIDENT_KEY, ts_text("session_start"), ts_text("session_end"), "candidates", "signal_count",
        r6("max_score"),
    )


_HALF = "2024-01-16 00:00:00"


def _known_incidents(candidates):
    """Incidents the first half of the month left behind, one per key."""
    early = candidates.where(F.col("start_time") < ref_column(_HALF))
    rows = early.groupBy(*inc.INCIDENT_KEY).agg(
        F.max("start_time").alias("last_seen_at"), F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity")
    )
    done = F.col("n") % 2 == 0
    return rows.select(
        F.concat(F.lit("old-"), F.sha1(F.concat_ws("|", *inc.INCIDENT_KEY))).alias("incident_id"),
        *inc.INCIDENT_KEY, "severity", "last_seen_at",
        F.when(done, "resolved").otherwise("open").alias("status"),
        F.when(done, F.col("last_seen_at") + F.expr("INTERVAL 1 DAY")).alias("resolved_at"),
        F.lit("known").alias("title"), F.col("last_seen_at").alias("opened_at"),
        F.col("last_seen_at").alias("updated_at"), F.col("last_seen_at").alias("created_at"),
        F.lit(2).alias("affected_services"), F.lit("lookup").alias("root_cause_service"),
        F.lit(1.5).alias("root_cause_score"), F.array(F.lit("cand_0")).alias("evidence"),
        F.lit('{"custom": 1}').alias("context_json"), F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.lit(None).cast("timestamp").alias("mitigated_at"),
    )


def _correlated(spark, sf, compat):
    candidates = day_candidates(spark, sf)
    burn = slo.burn_triplet(day_burn(spark, sf))
    late = candidates.where(F.col("start_time") >= ref_column(_HALF))
    return inc.correlate_candidates(
        late, _known_incidents(candidates), burn, ref_column("2024-02-01 00:00:00"),
        merge_minutes=5 * 1440, reopen_minutes=4 * 1440, compat=compat,
    )


_KNOWN_SQL = f"""known AS (SELECT fingerprint, service, environment, category, max(minute) AS last_seen, count(*) AS n
   FROM cand WHERE minute < TIMESTAMP '{_HALF}' GROUP BY ALL)"""
_ACTION = """CASE WHEN n % 2 = 1 AND {start} - last_seen <= INTERVAL 5 DAY THEN 'attach'
   WHEN n % 2 = 0 AND {start} - (last_seen + INTERVAL 1 DAY) <= INTERVAL 4 DAY THEN 'reopen' ELSE 'open' END"""


@query(
    "correlate_candidates",
    f"""WITH {CANDIDATES_SQL}, {_KNOWN_SQL},
        late AS (SELECT * FROM cand WHERE minute >= TIMESTAMP '{_HALF}'),
        flag AS (SELECT *, lag(minute) OVER k IS NULL OR minute - lag(minute) OVER k > INTERVAL 5 DAY AS opens FROM late
                 WINDOW k AS (PARTITION BY fingerprint, service, environment, category ORDER BY minute, candidate_id)),
        sess AS (SELECT *, max(CASE WHEN opens THEN minute END) OVER (PARTITION BY fingerprint, service, environment,
                 category ORDER BY minute, candidate_id) AS session_start FROM flag),
        d AS (SELECT *, {_ACTION.format(start='session_start')} AS action
              FROM sess LEFT JOIN known USING (fingerprint, service, environment, category)),
        g AS (SELECT fingerprint, service, environment, category, session_start, action, count(*) AS n_cand,
                     arg_max(severity, (minute, candidate_id)) AS severity,
                     arg_max(candidate_id, (minute, candidate_id)) AS last_candidate,
                     arg_max(signal_count, (minute, candidate_id)) AS last_count,
                     arg_min(severity, (minute, candidate_id)) AS first_severity FROM d GROUP BY ALL)
        SELECT fingerprint, service, environment, category, severity,
          CASE action WHEN 'reopen' THEN 'reopened' ELSE 'open' END AS status,
          CASE action WHEN 'open' THEN service || ':' || category || ':' || first_severity || ' anomaly' ELSE 'known' END AS title,
          CASE action WHEN 'open' THEN n_cand ELSE n_cand + 1 END AS n_evidence,
          round(CASE action WHEN 'open' THEN 1 ELSE 2 END * {RATE}
                * CASE WHEN environment = 'prod' THEN 1.0 ELSE 0.4 END, 6) AS impact,
          last_candidate, CAST(last_count AS VARCHAR) AS last_count, CASE action WHEN 'open' THEN NULL ELSE '1' END AS custom FROM g""",
)
def correlate_candidates(spark, sf):
    rows = _correlated(spark, sf, compat=False)["snapshots"]
    return rows.select(
        *inc.INCIDENT_KEY, "severity", "status", "title", F.size("evidence").alias("n_evidence"),
        r6("impact_score", "impact"), F.get_json_object("context_json", "$.last_candidate_id").alias("last_candidate"),
        F.get_json_object("context_json", "$.last_signal_count").alias("last_count"),
        F.get_json_object("context_json", "$.custom").alias("custom"),
    )


@query(
    "correlate_single",
    f"""WITH {CANDIDATES_SQL}, {_KNOWN_SQL}, late AS (SELECT * FROM cand WHERE minute >= TIMESTAMP '{_HALF}'),
        d AS (SELECT *, {_ACTION.format(start='minute')} AS action FROM late
              LEFT JOIN known USING (fingerprint, service, environment, category))
        SELECT CASE action WHEN 'open' THEN 'opened' ELSE 'reopened' END AS event_type, candidate_id,
               {q.ts('minute', 'event_time')} FROM d WHERE action <> 'attach'
        UNION ALL SELECT 'candidate_attached', candidate_id, strftime(minute, '%Y-%m-%d %H:%M:%S') FROM d""",
)
def correlate_single(spark, sf):
    rows = _correlated(spark, sf, compat=True)["events"]
    return rows.select(
        "event_type", F.get_json_object("payload", "$.candidate_id").alias("candidate_id"), ts_text("event_time")
    )


def _requests(spark, sf):
    wanted = F.create_map(
        *[F.lit(x) for x in ("click", "acknowledged", "view", "mitigated", "purchase", "resolved", "signup", "reopened", "error", "closed")]
    )
    return views.logs(spark, sf).select(
        F.concat(F.lit("inc-"), F.col("user_id").cast("string")).alias("incident_id"),
        F.col("log_id").alias("request_id"), wanted[F.col("event_type")].alias("next_status"),
        F.lit("ops").alias("actor"), F.when(F.col("log_id") % 3 == 0, F.concat(F.lit("note "), "log_id")).alias("note"),
        F.col("timestamp").alias("requested_at"),
    )


_WALK = f"""RECURSIVE {q.INCIDENTS},
req AS (SELECT 'inc-' || user_id AS incident_id, event_id AS request_id, ts,
          CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'mitigated' WHEN 'purchase' THEN 'resolved'
               WHEN 'signup' THEN 'reopened' ELSE 'closed' END AS next_status,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT incident_id, CAST(0 AS BIGINT) AS rn, status AS before, status AS after FROM incidents
         UNION ALL
         SELECT w.incident_id, r.rn, w.after,
           CASE WHEN (w.after IN ('open', 'reopened') AND r.next_status IN ('acknowledged', 'mitigated', 'resolved'))
                  OR (w.after = 'acknowledged' AND r.next_status IN ('mitigated', 'resolved'))
                  OR (w.after = 'mitigated' AND r.next_status IN ('resolved', 'reopened'))
                  OR (w.after = 'resolved' AND r.next_status = 'reopened') THEN r.next_status ELSE w.after END
         FROM walk w JOIN req r ON r.incident_id = w.incident_id AND r.rn = w.rn + 1),
outcome AS (SELECT r.incident_id, request_id, ts, next_status, before AS from_status,
          CASE WHEN next_status = 'closed' THEN 'unknown_status' WHEN before IS NULL THEN 'incident_not_found'
               WHEN before = after THEN 'transition_not_allowed' END AS reason
          FROM req r LEFT JOIN walk w ON w.incident_id = r.incident_id AND w.rn = r.rn)"""


@query(
    "transition_outcomes",
    f"WITH {_WALK} SELECT incident_id, request_id, next_status, from_status, reason FROM outcome",
)
def transition_outcomes(spark, sf):
    rows = inc.transition_outcomes(_requests(spark, sf), views.incidents(spark, sf))
    return rows.select("incident_id", "request_id", "next_status", "from_status", "reason")


@query(
    "apply_transitions",
    f"""WITH {_WALK}, ok AS (SELECT *, CASE WHEN request_id % 3 = 0 THEN 'note ' || request_id END AS note FROM outcome
          WHERE reason IS NULL)
        SELECT incident_id, arg_max(next_status, (ts, request_id)) AS status,
          {q.ts("max(ts) FILTER (next_status = 'acknowledged')", 'acknowledged_at')},
          {q.ts("max(ts) FILTER (next_status = 'resolved')", 'resolved_at')},
          arg_max(note, (ts, request_id)) FILTER (note IS NOT NULL) AS note FROM ok GROUP BY incident_id""",
)
def apply_transitions(spark, sf):
    rows = inc.apply_transitions(_requests(spark, sf), views.incidents(spark, sf))["snapshots"]
    return rows.select(
        "incident_id", "status", ts_text("acknowledged_at"), ts_text("resolved_at"),
        F.get_json_object("context_json", "$.last_status_note").alias("note"),
    )


@query(
    "open_manual",
    f"""WITH {q.INCIDENTS}, m AS (SELECT *, {q.template('title')} AS t FROM incidents)
        SELECT incident_id AS request_id, title, sha1(service || '|' || category || '|' || t) AS fingerprint, t AS template,
        round({RATE} * CASE WHEN environment = 'prod' THEN 1.0 ELSE 0.4 END, 6) AS impact FROM m""",
)
def open_manual(spark, sf):
    requests = views.incidents(spark, sf).select(
        F.col("incident_id").alias("request_id"), "title", "service", "environment", "category", "severity",
        F.lit("").alias("message"), F.lit("ops").alias("actor"),
    )
    burn = slo.burn_triplet(day_burn(spark, sf))
    out = inc.open_manual(requests, burn, ref_column("2024-02-01 00:00:00"))
    asked = requests.select(
        "request_id", F.concat(F.lit("inc_"), F.sha1(F.concat_ws("|", F.lit("manual"), "request_id"))).alias("incident_id")
    )
    return out["snapshots"].join(asked, "incident_id").select(
        "request_id", "title", "fingerprint",
        F.get_json_object("context_json", "$.normalized_message").alias("template"), r6("impact_score", "impact"),
    )


_TOKENS = """list_sort(list_distinct(list_filter(list_transform(list_filter(
  regexp_extract_all({x}, '[a-zA-Zа-яА-Я0-9_-]+'), lambda w: length(w) > 2), lambda w: lower(w)),
  lambda w: w NOT IN ('anomaly', 'incident', 'error', 'alert', 'warning'))))"""
_PREFIX = """(SELECT count(*) FROM range(1, 17) t(i) WHERE i <= length({a}) AND i <= length({b})
  AND substr({a}, 1, i) = substr({b}, 1, i)) / 16.0"""
_SEV = "list_position(['debug', 'info', 'warning', 'error', 'critical'], {x})"


@query(
    "title_tokens",
    f"WITH {q.INCIDENTS} SELECT incident_id, array_to_string({_TOKENS.format(x='title')}, ',') AS tokens FROM incidents",
)
def title_tokens(spark, sf):
    return views.incidents(spark, sf).select(
        "incident_id", F.array_join(sim.title_tokens(F.col("title")), ",").alias("tokens")
    )


def _jaccard_sql(a, b):
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared} / (len({a}) + len({b}) - {shared}) END"


def _score_sql(a: str, b: str) -> str:
    return f"""0.25 * CAST({a}.service = {b}.service AS INT) + 0.15 * CAST({a}.category = {b}.category AS INT)
      + 0.10 * CAST({a}.severity = {b}.severity AS INT) + 0.05 * CAST({a}.environment = {b}.environment AS INT)
      + 0.15 * {_PREFIX.format(a=a + '.fingerprint', b=b + '.fingerprint')}
      + 0.20 * ({_jaccard_sql(a + '.tokens', b + '.tokens')})
      + 0.10 * (1.0 - abs({_SEV.format(x=a + '.severity')} - {_SEV.format(x=b + '.severity')}) / 4.0)"""


_TOKENED = f"{q.INCIDENTS}, c AS (SELECT *, {_TOKENS.format(x='title')} AS tokens FROM incidents)"


@query(
    "similarity_parts",
    f"""WITH {_TOKENED} SELECT a.incident_id, round({_jaccard_sql('a.tokens', 'b.tokens')}, 6) AS title_jaccard,
        round({_PREFIX.format(a='a.fingerprint', b='b.fingerprint')}, 6) AS prefix_similarity,
        round(1.0 - abs({_SEV.format(x='a.severity')} - {_SEV.format(x='b.severity')}) / 4.0, 6) AS severity_distance
        FROM c a JOIN c b ON b.o_orderkey = a.o_orderkey + 20""",
)
def similarity_parts(spark, sf):
    cards = views.incidents(spark, sf).withColumn("tokens", sim.title_tokens(F.col("title")))
    a, b = cards.alias("a"), cards.alias("b")
    pairs = a.join(b, F.col("b.o_orderkey") == F.col("a.o_orderkey") + 20)
    return pairs.select(
        "a.incident_id", r6(sim.jaccard(F.col("a.tokens"), F.col("b.tokens")), "title_jaccard"),
        r6(sim.prefix_score(F.col("a.fingerprint"), F.col("b.fingerprint")), "prefix_similarity"),
        r6(sim.severity_closeness(F.col("a.severity"), F.col("b.severity")), "severity_distance"),
    )


@query(
    "similar_incidents",
    f"""WITH {_TOKENED}, s AS (SELECT a.incident_id, {_score_sql('a', 'b')} AS score FROM c a, c b
          WHERE b.incident_id = 'inc-11' AND a.incident_id <> 'inc-11')
        SELECT incident_id, round(score, 6) AS score FROM s WHERE score >= 0.1
        ORDER BY round(s.score, 9) DESC, incident_id LIMIT 5""",
)
def similar_incidents(spark, sf):
    return sim.similar_to(views.incidents(spark, sf), "inc-11").select("incident_id", r6("score"))


@query(
    "similar_to_recent",
    # classes of incidents with equal scores: the best six of all classes hold the best six incidents
    f"""WITH {_TOKENED}, k AS (
          SELECT min(incident_id) AS kid, service, category, severity, environment, tokens, substr(fingerprint, 1, 16) AS fingerprint,
            list_sort(list(incident_id))[1:6] AS ids FROM c GROUP BY ALL),
        t AS (SELECT row_number() OVER () AS tid, * FROM (SELECT DISTINCT service, category, severity, environment, tokens, '' AS fingerprint FROM k)),
        base AS MATERIALIZED (SELECT a.tid, b.tid AS other, {_score_sql('a', 'b')} AS base FROM t a, t b),
        f AS (SELECT DISTINCT fingerprint FROM k),
        pre AS MATERIALIZED (SELECT a.fingerprint AS fa, b.fingerprint AS fb, {_PREFIX.format(a='a.fingerprint', b='b.fingerprint')} AS pre FROM f a, f b),
        kt AS (SELECT kid, ids, k.fingerprint, tid FROM k JOIN t USING (service, category, severity, environment, tokens)),
        best AS (SELECT a.kid, min({{'minus': -round(base + 0.15 * pre, 9), 'kid': b.kid, 'score': base + 0.15 * pre}}, 6) AS best
                 FROM kt a JOIN base USING (tid) JOIN kt b ON b.tid = base.other JOIN pre ON fa = a.fingerprint AND fb = b.fingerprint
                 WHERE base + 0.15 * pre >= 0.1 GROUP BY a.kid),
        few AS (SELECT best.kid, unnest(o.ids) AS similar_id, x.score FROM (SELECT kid, unnest(best) AS x FROM best) best JOIN k o ON o.kid = x.kid),
        s AS (SELECT unnest(m.members) AS incident_id, similar_id, score FROM few
              JOIN (SELECT min(incident_id) AS kid, list(incident_id) AS members FROM c
                    GROUP BY service, category, severity, environment, tokens, substr(fingerprint, 1, 16)) m USING (kid)),
        r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(score, 9) DESC, similar_id) AS rank
              FROM s WHERE incident_id <> similar_id)
        SELECT incident_id, similar_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def similar_to_recent(spark, sf):
    rows = sim.similar_to_recent(views.incidents(spark, sf))
    return rows.select("incident_id", "similar_id", r6("score"), "rank")


@query("postmortems")
def postmortems(spark, sf):
    cards = _latest_versions(spark, sf)
    return pm.postmortems(cards, views.incident_events(spark, sf), sim.similar_to_recent(cards))


_V0 = f"""{q.ENRICHED}, n0 AS (SELECT *, {q.legacy('message')} AS normalized FROM enriched
   WHERE severity IN ('warning', 'error', 'critical')),
v AS (SELECT *, substr(sha256(service || '|' || category || '|' || normalized), 1, 16) AS fingerprint,
        CASE severity WHEN 'critical' THEN 1.0 WHEN 'error' THEN 0.8 ELSE 0.4 END AS w FROM n0),
g AS (SELECT fingerprint, min(service) AS service, min(category) AS category, min(normalized) AS normalized, count(*) AS n,
        arg_max(severity, w) AS severity, max(w) AS w, min(timestamp) AS first_ts, max(timestamp) AS last_ts
      FROM v GROUP BY fingerprint HAVING count(*) >= 3),
p AS (SELECT *, row_number() OVER (ORDER BY first_ts, fingerprint) - 1 AS pos, count(*) OVER () AS total,
        max(n) OVER () AS max_n FROM g)"""


@query(
    "incidents_v0",
    f"""WITH {_V0} SELECT fingerprint, service, category, '[' || category || '] ' || service || ': ' || substr(normalized, 1, 80)
        AS title, severity, n AS event_count, {q.ts('first_ts', 'first_seen')}, {q.ts('last_ts', 'last_seen')},
        round(0.35 * n / max_n + 0.25 * CASE WHEN total > 1 THEN 1.0 - pos / (total - 1) ELSE 1.0 END + 0.20 + 0.20 * w, 4)
          AS score FROM p""",
)
def incidents_v0(spark, sf):
    rows = inc.legacy_incidents(en.enrich(views.logs(spark, sf)))
    return rows.select(
        "fingerprint", "service", "category", "title", "severity", "event_count", ts_text("first_seen"),
        ts_text("last_seen"), "score",
    )


@query("incidents_v0_scored")
def incidents_v0_scored(spark, sf):
    """Second run: anomaly scores known, and half of the groups already stored as resolved."""
    enriched = en.enrich(views.logs(spark, sf))
    z = an.score_by_service(an.mad_anomalies(an.window_counts(enriched, "day"), threshold=2.0))
    stored = inc.legacy_incidents(enriched).select(
        "id", "fingerprint", F.lit("resolved").alias("status"), "first_seen", "event_count"
    )
    return inc.legacy_incidents(enriched, stored, z)
