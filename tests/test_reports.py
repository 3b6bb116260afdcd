"""Reports: attribution, templates that rose, postmortems and stored tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenlog.operators import postmortem as pm
from lumenlog.operators import rca
from lumenlog.operators.iforest import tree_samples
from lumenlog.operators.risk import attributions, leaf_paths
from lumenlog.sources import tables

LOG = "service string, severity string, level string, status_code int, message string, timestamp timestamp, log_id bigint"


def test_hot_templates(make):
    rows = [("db", "error", "error", 200, f"slow query {i}", f"2024-01-01 09:{i:02d}:00", i) for i in range(6)]
    rows += [("db", "error", "error", 200, f"pool exhausted at node {i} now", f"2024-01-01 10:{i:02d}:00", 10 + i) for i in range(4)]
    rows += [("db", "error", "error", 200, "slow query 9", "2024-01-01 10:05:00", 30), ("db", "info", "info", 200, "ping", "2024-01-01 10:06:00", 31)]
    wanted = make([("db", "2024-01-01 10:00:00"), ("db", "2024-01-01 12:00:00")], "service string, cutoff timestamp")
    got = [(str(r["cutoff"])[11:13], r["rank"], r["template"], r["hot"], r["base"]) for r in
           rca.hot_templates(make(rows, LOG), wanted).orderBy("cutoff", "rank").collect()]
    assert got == [
        ("10", 1, "pool exhausted at node <*> now", 4, 0), ("10", 2, "slow query <*>", 1, 6),
        ("12", 1, "slow query <*>", 0, 7), ("12", 2, "pool exhausted at node <*> now", 0, 4),
    ]

def test_cutoffs_are_exact(make):
    rows = [("db", "error", "error", 200, f"disk full {i}", f"2024-01-01 10:00:00.{i}00000", i) for i in range(1, 8)]
    rows += [("db", "error", "error", 200, "link down", "2024-01-01 10:00:00.600000", 20), ("db", "error", "error", 200, "link down", "2024-01-01 09:00:00", 21)]
    wanted = make([("db", "2024-01-01 10:00:00.500000"), ("db", "2024-01-01 10:00:00.600000"), ("db", None)], "service string, cutoff timestamp")
    got = rca.hot_templates(make(rows, LOG), wanted).collect()
    found = {(r["cutoff"] and r["cutoff"].microsecond, r["template"]): (r["hot"], r["base"]) for r in got}
    assert found == {
        (500_000, "disk full <*>"): (3, 4), (500_000, "link down"): (1, 1), (600_000, "disk full <*>"): (2, 5),
        (600_000, "link down"): (1, 1), (None, "disk full <*>"): (7, 0), (None, "link down"): (2, 0),
    }


def test_slices_of_time_give_the_same_templates(make, monkeypatch):
    draw = np.random.default_rng(3)
    at = "2024-01-01 {:02d}:{:02d}:00.{:03d}000"
    moments = [at.format(*x) for x in zip(draw.integers(8, 12, 300), draw.integers(0, 4, 300), draw.integers(0, 3, 300))]
    kinds = ["disk full on {}", "link {} went down", "no route to {} any more now"]
    rows = [("db" if k % 4 else "web", "error", "error", 200, kinds[k * 7 % 3].format(k), m, k) for k, m in enumerate(moments)]
    rows += [("thin", "error", "error", 200, "once", moments[0], 999)]
    logs = make(rows, LOG)
    asked = [(s, m) for s in ("db", "web", "thin", None) for m in [*moments[::9], "2024-01-01 07:00:00", "2024-01-02 07:00:00", None]]
    wanted = make(asked, "service string, cutoff timestamp")
    monkeypatch.setattr(rca, "CUTS_PER_RUN", 3)
    monkeypatch.setattr(rca, "SLICE_ROWS", 10)
    cut = rca.hot_templates(logs, wanted)
    times = [(r[0], r[4], pd.Timestamp(r[5])) for r in rows if r[0] != "thin"]
    names = {k.format(n): k.format("<*>") for n in range(300) for k in kinds}
    want = []
    for service, moment in {(s, m) for s, m in asked if s in ("db", "web")}:
        moment = None if moment is None else pd.Timestamp(moment)
        found = []
        for kind in (k.format("<*>") for k in kinds):
            mine = [t for s, text, t in times if s == service and names[text] == kind]
            base = 0 if moment is None else sum(t < moment for t in mine)
            found.append((kind, len(mine) - base, base))
        hot = any(h for _, h, _ in found)
        rated = [((h / (b + 1) if hot else 0.0), (h if hot else h + b), t, h, b) for t, h, b in found if h or not hot]
        rated.sort(key=lambda x: (-x[0], -x[1], x[2]))
        want += [(service, moment, n, t, h, b) for n, (_, _, t, h, b) in enumerate(rated, 1)]
    have = [(r["service"], r["cutoff"] and pd.Timestamp(r["cutoff"]), r["rank"], r["template"], r["hot"], r["base"]) for r in cut.collect()]
    assert len(want) > 100 and sorted(map(str, have)) == sorted(map(str, want))


def _reports(make, hours=None):
    incidents = make(
        [("i1", "f1", "db", "database", "2024-01-02 10:00:00"), ("i2", "f2", "web", "network", "2024-01-02 10:00:00")],
        "incident_id string, fingerprint string, service string, category string, opened_at timestamp",
    )
    logs = [("db", "error", "error", 200, f"disk full {i}", f"2024-01-02 10:{i:02d}:00", i) for i in range(5)]
    logs += [("web", "error", "error", 500, "refused by peer", "2024-01-02 10:01:00", 50)]
    logs += [("web", "info", "info", 200, f"served {i} pages", f"2024-01-01 10:{i:02d}:00", 100 + i) for i in range(9)]
    anomalies = make(
        [("db", "database", "error", "2024-01-02 09:30:00", 9, 4.0), ("web", "network", "error", "2024-01-01 09:00:00", 9, 7.0)],
        "service string, category string, severity string, window timestamp, count long, z double",
    )
    edges = make([("a", "b", 3)], "src string, dst string, weight long").limit(0)
    slo = make([("db", "page")], "service string, alert_level string")
    now = F.lit("2024-01-02 11:00:00").cast("timestamp")
    reports = rca.rca_report(incidents, make(logs, LOG), anomalies, edges, slo, now, hours)
    return reports, rca.rca_timeline(reports, anomalies, hours)


def test_thin_evidence_gives_the_most_frequent_templates(make):
    reports, lines = _reports(make)
    got = {r["incident_id"]: r["evidence_templates"] for r in reports.collect()}
    assert got == {"i1": ["disk full <*>"], "i2": ["served <*> pages", "disk full <*>", "refused by peer"]}
    assert lines.count() == 4


def test_reports_look_back(make):
    reports, lines = _reports(make, hours=6)
    got = {r["incident_id"]: (r["evidence_templates"], r["anomaly_score"], sorted(r["affected_services"])) for r in reports.collect()}
    assert got == {"i1": (["disk full <*>"], 4.0, ["db"]), "i2": (["disk full <*>", "refused by peer"], 4.0, ["db", "web"])}
    assert sorted((r["incident_id"], r["service"]) for r in lines.collect()) == [("i1", "db"), ("i2", "db")]


def _nodes():
    rows = [  # tree, weight, id, prediction, cover, left, right, feature, threshold
        (0, 1.0, 0, 0.0, 10.0, 1, 2, 0, 0.5), (0, 1.0, 1, -1.0, 6.0, -1, -1, -1, None),
        (0, 1.0, 2, 0.0, 4.0, 3, 4, 1, 2.0), (0, 1.0, 3, 2.0, 1.0, -1, -1, -1, None), (0, 1.0, 4, 5.0, 3.0, 5, 6, 0, 0.8),
        (0, 1.0, 5, 4.0, 2.0, -1, -1, -1, None), (0, 1.0, 6, 7.0, 1.0, -1, -1, -1, None),
        (1, 0.5, 0, 0.0, 10.0, 1, 2, 2, 1.0), (1, 0.5, 1, 3.0, 5.0, -1, -1, -1, None), (1, 0.5, 2, -3.0, 5.0, -1, -1, -1, None),
    ]
    return pd.DataFrame(rows, columns=["tree", "weight", "id", "prediction", "cover", "leftChild", "rightChild", "feature", "threshold"])


def _expected_value(nodes, x, known):
    """Tree value with unknown features averaged by cover."""
    total = 0.0
    for _, t in nodes.groupby("tree"):
        by = {r.id: r for r in t.itertuples()}

        def walk(n):
            if n.leftChild < 0:
                return n.prediction
            a, b = by[n.leftChild], by[n.rightChild]
            if n.feature in known:
                return walk(a if x[n.feature] <= n.threshold else b)
            return (walk(a) * a.cover + walk(b) * b.cover) / n.cover

        total += by[0].weight * walk(by[0])
    return total


def test_attributions_are_shapley_values():
    from itertools import permutations

    nodes = _nodes()
    x = np.array([[0.7, 3.0, 0.0], [0.2, 1.0, 2.0], [0.9, 3.0, 2.0]])
    phi, base = attributions(leaf_paths(nodes), x)
    assert abs(base - _expected_value(nodes, x[0], set())) < 1e-9
    for row, got in zip(x, phi):
        want = np.zeros(3)
        for order in permutations(range(3)):
            seen = set()
            for f in order:
                before = _expected_value(nodes, row, seen)
                seen.add(f)
                want[f] += (_expected_value(nodes, row, seen) - before) / 6
        assert np.allclose(got, want)


def test_postmortem(make):
    cards = make(
        [("i1", "f1", "db down", "db", "prod", "database", "critical", "open", "2024-01-01 10:00:00", "lookup", 0.5, 1.25, 2.0, 3,
          '{"rca_breakdown": {"anomaly": 0.25, "fanout": 1.0}}'),
         ("i2", "f2", "quiet", "web", "qa", "network", "info", "open", None, None, None, None, None, None, None)],
        "incident_id string, fingerprint string, title string, service string, environment string, category string, severity string, "
        "status string, opened_at timestamp, root_cause_service string, root_cause_score double, impact_score double, "
        "burn_rate_1h double, affected_services int, context_json string",
    )
    events = make(
        [("e1", "i1", "opened", "2024-01-01 10:00:00", "ops", "{}"),
         ("e2", "i1", "candidate_attached", "2024-01-01 10:01:00", "ops", '{"candidate_id": "c1", "anomaly_score": 4.5, "trace_ids": ["t1", "t2"]}'),
         ("e3", "i1", "rca_recomputed", "2024-01-01 10:02:00", "ops", '{"root_cause_service": "lookup", "root_cause_score": 0.5}')],
        "event_id string, incident_id string, event_type string, event_time timestamp, actor string, payload string",
    )
    similar = make([("i1", "i2", 0.42, 1)], "incident_id string, similar_id string, score double, rank int")
    got = {r["incident_id"]: r["markdown"] for r in pm.postmortems(cards, events, similar).collect()}
    one, two = got["i1"], got["i2"]
    for text in (
        "# Postmortem: db down\n\n**Incident ID:** `i1`  \n", "**lookup** (RCA score 0.50).", "Сервисов в инциденте: **3**.",
        "Burn rate за час: **2.0×**.", "- Начало: **2024-01-01 10:00 UTC**", "Impact score: 1.250",
        "  - `anomaly` × 0.35: **0.250**\n  - `fanout` × 0.2: **1.000**",
        "- candidate_id=`c1`, anomaly_score=4.50, trace_ids: `t1`, `t2`",
        "- **2024-01-01 10:00 UTC** · _Инцидент открыт_ · actor: `ops`\n- **2024-01-01 10:01 UTC**",
        "_RCA пересчитан_ · actor: `ops`  \n    root_cause_service=`lookup`, score=0.500",
        "| 1 | `web` | `network` | `info` | 0.42 | — |",
    ):
        assert text in one, text
    for text in ("**неизвестно**.", pm.NO_EVIDENCE, pm.NO_EVENTS, pm.NO_SIMILAR, "- Начало: **—**"):
        assert text in two, text
    assert [h for h in one.split("\n") if h.startswith("## ")][-1] == "## 8. Lessons learned"


def test_evidence_behind_many_newer_events(make):
    rows = [("a0", "i", "candidate_attached", "2024-01-01 00:00:00", "ops", '{"candidate_id": "c0"}')]
    rows += [(f"e{n:03d}", "i", "status_changed", f"2024-01-02 {n // 60:02d}:{n % 60:02d}:00", "ops", "{}") for n in range(300)]
    events = make(rows, "event_id string, incident_id string, event_type string, event_time timestamp, actor string, payload string")
    got = pm.timelines(events).first()
    assert got["evidence_lines"] == ["- candidate_id=`c0`"]
    assert len(got["timeline"]) == pm.TIMELINE_EVENTS and got["timeline"][0].startswith("- **2024-01-02 01:40")


def test_a_report_has_all_events_candidates_and_traces(make):
    rows = [(f"a{n}", "i", "candidate_attached", f"2024-01-01 00:00:0{n}", "ops", f'{{"candidate_id": "c{n}", "trace_ids": ["t1", "t2", "t3", "t4"]}}') for n in range(8)]
    rows += [(f"e{n:03d}", "i", "status_changed", f"2024-01-02 {n // 60:02d}:{n % 60:02d}:00", "ops", "{}") for n in range(300)]
    events = make(rows, "event_id string, incident_id string, event_type string, event_time timestamp, actor string, payload string")
    cards = make([("i",)], "incident_id string")
    similar = make([], "incident_id string, similar_id string, score double, rank int")
    columns = {n: F.lit(None).cast("string") for n in ("service", "category", "severity", "opened_at")}
    text = pm.postmortems(cards.withColumns(columns), events, similar).first()["markdown"]
    assert text.count(" · actor: `ops`") == 308
    proofs = [line for line in text.split("\n") if line.startswith("- candidate_id=")]
    assert proofs == [f"- candidate_id=`c{n}`, trace_ids: `t1`, `t2`, `t3`, `t4`" for n in range(7, -1, -1)]
    few = pm.postmortems(cards.withColumns(columns), events, similar, shown=200, evidence_shown=5, traces_shown=3).first()["markdown"]
    assert few.count(" · actor: `ops`") == 200 and few.count("- candidate_id=") == 5 and "`t4`" not in few


def test_forest_samples_follow_one_rule(spark):
    def points(n):
        return spark.range(n).selectExpr(
            "concat('s', id % 3) AS service", "timestamp_seconds(id * 60) AS minute_bucket", "double(id) AS x0", "0D AS x1", "0D AS x2"
        )

    few = tree_samples(points(50), trees=4, sample=64)
    assert [r["count"] for r in few.groupBy("tree").count().collect()] == [50] * 4
    many = tree_samples(points(5000), trees=4, sample=64)  # more than the trees need
    assert sorted(r["count"] for r in many.groupBy("tree").count().collect()) == [64] * 4
    assert many.groupBy("x0").count().where("count > 1").count() > 0  # a row may enter several trees


def test_delete_rewrites_only_touched_days(spark, make, tmp_path):
    root = str(tmp_path)
    rows = make([("a", 1, "2024-01-01 10:00:00"), ("b", 1, "2024-01-01 11:00:00"), ("a", 2, "2024-01-02 10:00:00"), ("c", 1, "2024-01-03 10:00:00")],
                "incident_id string, version bigint, updated_at timestamp")
    tables.append(rows, "incidents", root)
    tables.append(rows.select(F.concat("incident_id", "version").alias("event_id"), "incident_id", F.col("updated_at").alias("event_time")), "incident_events", root)
    tables.append(rows.select("incident_id", F.col("updated_at").alias("start_time")), "incident_candidates", root)
    tables.delete_incidents(spark, make([("a",)], "incident_id string"), root)
    for name in ("incidents", "incident_events", "incident_candidates"):
        assert sorted(r["incident_id"] for r in tables.read(spark, name, root).collect()) == ["b", "c"]


def test_markdown_table(make):
    df = make([("a", 1)], "x string, y int")
    assert tables.markdown_table(df).first()[0] == "| a | 1 |"
