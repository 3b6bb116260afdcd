"""Queries over the service graph, cascades, templates and root-cause reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import enrich as en
from lumenlog.operators import anomalies as an
from lumenlog.operators import drain as dr
from lumenlog.operators import graph as gr
from lumenlog.operators import incidents as inc
from lumenlog.operators import rca, slo
from lumenlog.plans import sql as q
from lumenlog.plans import views
from lumenlog.plans.incident_plans import TRACE_SERVICES, _latest_versions, trace_services
from lumenlog.plans.log_plans import now
from lumenlog.plans.registry import query, r6, ts_text
from lumenlog.plans.signal_plans import _day_anomalies, day_burn
from lumenlog.session import run_dir
from lumenlog.sources import tables

GRAPH = """first_seen AS (SELECT trace_id, service, min(timestamp) AS first_ts FROM logs
   WHERE trace_id <> '' AND service <> '' GROUP BY ALL),
pairs AS (SELECT service AS src, lead(service) OVER (PARTITION BY trace_id ORDER BY first_ts, service) AS dst FROM first_seen),
graph AS (SELECT src, dst, count(*) AS weight FROM pairs WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL
          HAVING count(*) >= 3)"""


def _graph(spark, sf):
    return gr.service_graph(gr.trace_first_seen(views.logs(spark, sf)))


@query("service_graph", f"WITH {q.LOGS}, {GRAPH} SELECT src, dst, weight FROM graph")
def service_graph(spark, sf):
    return _graph(spark, sf)


@query("service_graph_turns", """WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL),
   p AS (SELECT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY first_turn, role) AS dst FROM f)
   SELECT src, dst, count(*) AS weight FROM p WHERE dst IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""")
def service_graph_turns(spark, sf):
    turns = views.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("trace_id"), F.col("role").alias("service"),
        F.timestamp_seconds("turn").alias("timestamp"),
    )
    return gr.service_graph(gr.trace_first_seen(turns))


@query("edges_by_weight", f"WITH {q.LOGS}, {GRAPH} SELECT src, dst, weight FROM graph ORDER BY weight DESC, src, dst LIMIT 10")
def edges_by_weight(spark, sf):
    return _graph(spark, sf).orderBy(F.desc("weight"), "src", "dst").limit(10)


def _stored_edges(spark, sf):
    edges = _graph(spark, sf)
    top = edges.agg(F.max("weight")).scalar()
    return edges.select(
        F.col("src").alias("source_service"), F.col("dst").alias("target_service"),
        (F.col("weight") / top).alias("criticality"),
    )


NODES = """crit AS (SELECT src, dst, weight / (SELECT max(weight) FROM graph) AS crit FROM graph),
ends AS (SELECT src AS service, 1 AS o, least(greatest(crit, 0.0), 1.0) AS c FROM crit
         UNION ALL SELECT dst, 0, least(greatest(crit * 0.8, 0.0), 1.0) FROM crit),
nodes AS (SELECT service, CAST(sum(o) AS BIGINT) AS fanout, greatest(max(c), 0.5) AS criticality FROM ends GROUP BY service)"""


@query(
    "node_stats",
    f"WITH {q.LOGS}, {GRAPH}, {NODES} SELECT service, fanout, round(criticality, 6) AS criticality FROM nodes",
)
def node_stats(spark, sf):
    return gr.node_stats(_stored_edges(spark, sf)).select("service", "fanout", r6("criticality"))


# Each day of errors acts as one incident; its services fire at their first error of the day.
_DAYS = f"""{q.LOGS}, {GRAPH}, affected AS (SELECT strftime(timestamp, '%Y-%m-%d') AS incident_id, service,
   min(timestamp) AS onset FROM logs WHERE status_code = 503 GROUP BY ALL)"""


def _daily(spark, sf):
    hits = views.logs(spark, sf).where("status_code = 503")
    return hits.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("incident_id"), "service").agg(
        F.min("timestamp").alias("onset")
    )


_ROOT = """blocked AS (SELECT DISTINCT a.incident_id, a.service FROM affected a JOIN graph e ON e.dst = a.service
   JOIN affected c ON c.incident_id = a.incident_id AND c.service = e.src WHERE c.onset < a.onset),
calls AS (SELECT DISTINCT a.incident_id, a.service FROM affected a JOIN graph e ON e.src = a.service
   JOIN affected c ON c.incident_id = a.incident_id AND c.service = e.dst),
root AS (SELECT incident_id, arg_min(service, (NOT calling, onset, service)) AS root_service FROM (
   SELECT a.*, EXISTS (SELECT 1 FROM calls k WHERE k.incident_id = a.incident_id AND k.service = a.service) AS calling
   FROM affected a ANTI JOIN blocked USING (incident_id, service)) GROUP BY incident_id)"""


@query("cascade_root", f"WITH {_DAYS}, {_ROOT} SELECT incident_id, root_service FROM root")
def cascade_root(spark, sf):
    return gr.cascade_root(_daily(spark, sf), _graph(spark, sf))


@query(
    "cascade_path",
    f"""WITH RECURSIVE {_DAYS}, {_ROOT},
        walk AS (SELECT incident_id, root_service AS node, [root_service] AS path FROM root
          UNION ALL SELECT w.incident_id, e.dst, list_append(w.path, e.dst) FROM walk w JOIN graph e ON e.src = w.node
            JOIN affected a ON a.incident_id = w.incident_id AND a.service = e.dst
          WHERE NOT list_contains(w.path, e.dst) AND len(w.path) < 8),
        short AS (SELECT incident_id, node, path, len(path) AS depth, min(len(path)) OVER (PARTITION BY incident_id, node)
                  AS least FROM walk),
        deep AS (SELECT incident_id, path, depth, max(depth) OVER (PARTITION BY incident_id) AS deepest
                 FROM short WHERE depth = least)
        SELECT incident_id, array_to_string(min(path), '>') AS cascade_path FROM deep WHERE depth = deepest
        GROUP BY incident_id""",
)
def cascade_path(spark, sf):
    affected, edges = _daily(spark, sf), _graph(spark, sf)
    paths = gr.cascade_path(gr.cascade_root(affected, edges), affected, edges)
    return paths.select("incident_id", F.array_join("cascade_path", ">").alias("cascade_path"))


_EARLY = """early AS (SELECT incident_id, service, 1.0 - (row_number() OVER (PARTITION BY incident_id
   ORDER BY first_seen, service) - 1) / greatest(1, count(*) OVER (PARTITION BY incident_id) - 1) AS earliness FROM tsvc)"""


@query("earliness", f"WITH {TRACE_SERVICES}, {_EARLY} SELECT incident_id, service, round(earliness, 6) AS earliness FROM early")
def earliness(spark, sf):
    return rca.earliness(trace_services(spark, sf)).select("incident_id", "service", r6("earliness"))


def _active(spark, sf):
    return inc.active_incidents(_latest_versions(spark, sf))


def _scores(spark, sf):
    active = _active(spark, sf)
    anomalies = active.select("incident_id", (F.col("impact_score") / 30.0).alias("anomaly_score"))
    return rca.rca_scores(active, _stored_edges(spark, sf), trace_services(spark, sf), anomalies)


_SCORES = f"""{TRACE_SERVICES}, {GRAPH}, {NODES}, {_EARLY},
v AS (SELECT * FROM ({views.sql_incident_versions()}) QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY version DESC) = 1),
active AS (SELECT incident_id, service AS own, least(1.0, greatest(impact_score / 30.0, 0.0) / 10.0) AS lvl FROM v
           WHERE status <> 'resolved'),
near AS (SELECT src AS service, dst AS neighbor FROM graph UNION SELECT dst, src FROM graph),
cands AS (SELECT incident_id, own AS service FROM active
   UNION SELECT a.incident_id, n.neighbor FROM active a JOIN near n ON n.service = a.own
   UNION SELECT t.incident_id, t.service FROM tsvc t SEMI JOIN active USING (incident_id)),
parts AS (SELECT c.incident_id, c.service, c.service = a.own AS is_own,
   CASE WHEN c.service = a.own THEN lvl ELSE lvl * 0.6 END AS anomaly, coalesce(e.earliness, 0.0) AS earliness,
   least(1.0, coalesce(n.fanout, 0) / greatest(1, (SELECT max(fanout) FROM nodes))) AS fanout,
   coalesce(n.criticality, 0.5) AS criticality
   FROM cands c JOIN active a USING (incident_id) LEFT JOIN early e USING (incident_id, service)
   LEFT JOIN nodes n USING (service)),
scores AS (SELECT *, 0.35 * anomaly + 0.25 * earliness + 0.2 * fanout + 0.2 * criticality AS score FROM parts)"""


@query(
    "rca_scores",
    f"WITH {_SCORES} SELECT incident_id, service, round(anomaly, 6) AS anomaly, round(score, 6) AS score FROM scores",
)
def rca_scores(spark, sf):
    return _scores(spark, sf).select("incident_id", "service", r6("anomaly"), r6("score"))


@query(
    "rca_recompute",
    f"""WITH {_SCORES}, best AS (SELECT *, row_number() OVER (PARTITION BY incident_id
          ORDER BY round(score, 9) DESC, is_own DESC, service) AS rn FROM scores)
        SELECT b.incident_id, b.service AS root_cause_service, round(b.score, 6) AS root_cause_score,
          coalesce((SELECT count(*) FROM tsvc t WHERE t.incident_id = b.incident_id), 0) AS seen,
          CAST(json_extract(v.context_json, '$.custom') AS VARCHAR) AS custom FROM best b JOIN v USING (incident_id) WHERE rn = 1""",
)
def rca_recompute(spark, sf):
    seen = trace_services(spark, sf)
    active = _active(spark, sf)
    burn = slo.burn_triplet(day_burn(spark, sf))
    snapshots = rca.recompute_rca(active, _scores(spark, sf), seen, burn, now(views.logs(spark, sf)))["snapshots"]
    counts = seen.groupBy("incident_id").agg(F.count(F.lit(1)).alias("seen"))
    return snapshots.join(counts, "incident_id", "left").select(
        "incident_id", "root_cause_service", r6("root_cause_score"), F.coalesce("seen", F.lit(0)).alias("seen"),
        F.get_json_object("context_json", "$.custom").alias("custom"),
    )


@query("drain_templates")
def drain_templates(spark, sf):
    return dr.top_templates(dr.assign_templates(views.logs(spark, sf)), 20)


@query("drain_assign")
def drain_assign(spark, sf):
    rows = dr.assign_templates(views.logs(spark, sf))
    return rows.select("log_id", "cluster_id", "template_at", "template_final")


@query("drain_texts")
def drain_texts(spark, sf):
    """Templates of whole document lines."""
    lines = views.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "message")
    )
    rows = lines.where("message <> ''").select(
        (F.col("doc_id") * 1_000_000 + F.col("line")).alias("log_id"), "message",
        F.timestamp_seconds("doc_id").alias("timestamp"),
    )
    return dr.top_templates(dr.assign_templates(rows), 20)


@query("hot_templates")
def hot_templates(spark, sf):
    logs = en.enrich(views.logs(spark, sf))
    wanted = views.incident_versions(spark, sf).select("service", F.col("opened_at").alias("cutoff"))
    return rca.hot_templates(logs, wanted)


def _report(spark, sf):
    logs = views.logs(spark, sf)
    enriched = en.enrich(logs)
    return rca.rca_report(
        _active(spark, sf), enriched, _day_anomalies(spark, sf), _graph(spark, sf),
        slo.slo_status_timed(enriched, now(logs)), now(logs),
    )


@query("rca_report")
def rca_report(spark, sf):
    return _report(spark, sf)


@query("rca_timeline")
def rca_timeline(spark, sf):
    return rca.rca_timeline(_report(spark, sf), _day_anomalies(spark, sf))


@query("rca_reports")
def rca_reports(spark, sf):
    path = run_dir(spark, "reports")
    tables.append_reports(_report(spark, sf), path)
    return tables.list_reports(spark, path)
