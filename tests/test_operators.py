"""Operators on small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.ids import ref_column
from lumenlog.operators import anomalies as an
from lumenlog.operators import evaluate as ev
from lumenlog.operators import features as ft
from lumenlog.operators import graph as gr
from lumenlog.operators import incidents as inc
from lumenlog.operators import risk
from lumenlog.operators import signals as sg
from lumenlog.operators import similar as sim
from lumenlog.operators import slo, stats
from lumenlog.plans import risk_plans
from lumenlog.sources import logs as src
from lumenlog.sources import tables

WINDOW = "window timestamp, service string, category string, severity string, count bigint"
SIGNAL = "service string, environment string, category string, severity string, fingerprint string, minute_bucket timestamp, count bigint"


def minute(i, hour=10):
    return f"2024-01-01 {hour + i // 60:02d}:{i % 60:02d}:00"


@pytest.mark.parametrize("counts,hits", [([2] * 8 + [50], [50]), ([2, 2, 50], []), ([10] * 8 + [0], [])])
def test_mad_anomalies(make, counts, hits):
    df = make([(minute(i), "api", "backend", "error", c) for i, c in enumerate(counts)], WINDOW)
    got = an.mad_anomalies(df).collect()
    assert [r["count"] for r in got] == hits and all(r["z"] > 3.5 for r in got)


def _signals(make, history, now):
    rows = [("api", "prod", "database", "error", "f", minute(i), c) for i, c in enumerate(history)]
    current = [("api", "prod", "database", "error", "f", minute(len(history)), now)]
    return make(current, SIGNAL), make(rows + current, SIGNAL)


def test_volume_spike(make):
    current, history = _signals(make, [5, 5, 5, 5, 2, 8], 40)
    got = an.signal_anomalies(current, history).collect()
    assert [(r["anomaly_type"], r["score"], r["history_samples"], r["history_total"]) for r in got] == [
        ("volume_spike", 8.0, 6, 30)
    ]


def test_new_fingerprint_burst(make):
    current, history = _signals(make, [1], 25)
    got = an.signal_anomalies(current, history).collect()
    assert [(r["anomaly_type"], r["score"]) for r in got] == [("new_fingerprint_burst", 12.5)]


def test_history_excludes_now_and_old(make):
    rows = [("s", "e", "c", "v", "f", t, n) for t, n in (
        ("2024-01-01 10:00:00", 7), ("2024-01-02 09:59:00", 1), ("2024-01-02 10:00:00", 3), ("2024-01-02 10:01:00", 9))]
    df = make(rows, SIGNAL)
    got = {str(r["minute_bucket"]): (r["history_samples"], r["history_total"], r["history_median"]) for r in
           an.with_history(df, df).collect()}
    assert got["2024-01-02 10:00:00"] == (2, 8, 7.0)
    assert got["2024-01-02 10:01:00"] == (2, 4, 3.0)


def test_upper_median(make):
    rows = [("s", "e", "c", "v", "f", minute(i), n) for i, n in enumerate([1, 2, 3, 4])]
    got = sg.history_stats(make(rows, SIGNAL), ref_column("2024-01-01"), ref_column("2024-01-02")).first()
    assert (got["history_median"], got["history_max"], got["history_total"]) == (3.0, 4, 10)


def test_robust_z(make):
    df = make([(5.0, 2.0, 1.0), (5.0, 5.0, 0.0), (9.0, 4.0, 0.0)], "x double, m double, d double")
    got = [round(r[0], 4) for r in df.select(stats.robust_z(F.col("x"), F.col("m"), F.col("d"))).collect()]
    assert got == [2.0235, 0.0, round(0.6745 * 5 / 2, 4)]


def test_catalog_merge(make):
    old = make([("f", "timeout 1", "2024-01-01 09:00:00", "2024-01-01 09:10:00", 5, "2024-01-01 08:00:00")],
               "fingerprint string, example_message string, first_seen timestamp, last_seen timestamp, occurrence_count bigint, created_at timestamp")
    obs = make([("f", "db", "database", "timeout <num>", "timeout 2", "2024-01-01 10:00:00", 2),
                ("f", "db", "database", "timeout <num>", "timeout 3", "2024-01-01 10:05:00", 3)],
               "fingerprint string, service string, category string, message_template string, example_message string, observed_at timestamp, occurrence_count bigint")
    got = sg.merge_catalog(old, sg.roll_up_observations(obs), ref_column("2024-01-02")).first()
    assert (got["occurrence_count"], got["example_message"], str(got["first_seen"]), str(got["last_seen"])) == (
        10, "timeout 1", "2024-01-01 09:00:00", "2024-01-01 10:05:00")


def test_bounded_minutes(make):
    rows = [(minute(0),)] + [(minute(1),)] * 4 + [(minute(2),)]
    df = make(rows, "timestamp timestamp")
    assert [str(r["minute_bucket"]) for r in sg.bounded_minutes(df, 3).collect()] == ["2024-01-01 10:00:00"]
    assert sg.bounded_minutes(df, 10).count() == 3
    assert sg.bounded_minutes(df, 10, max_minutes=2).count() == 2


def _status(make, errors, total):
    rows = [("api", "prod", "backend", "error" if i < errors else "info", minute(i % 59)) for i in range(total)]
    df = make(rows, "service string, environment string, category string, severity string, timestamp timestamp")
    return slo.slo_status_timed(df, ref_column("2024-01-01 10:59:00")).first()


def test_slo_page(make):
    got = _status(make, 50, 100)
    assert got["alert_level"] == "page" and abs(got["windows"][0]["burn_rate"] - 500) < 1


def test_slo_ticket(make):
    got = _status(make, 8, 1000)
    assert got["alert_level"] == "ticket" and got["windows"][1]["is_burning"] and not got["windows"][0]["is_burning"]


def test_slo_tail_matches_plain_ranking(make, spark):
    rows = [(f"s{i % 3}", "p", "c", "error" if i % 7 == 0 else "info", minute(i // 20, 1), i) for i in range(997)]
    df = make(rows, "service string, environment string, category string, severity string, timestamp timestamp, log_id int")
    got = {r["service"]: [(w["error_count"], w["total_count"]) for w in r["windows"]] for r in slo.slo_status(df).collect()}
    for name in got:
        own = sorted((r[4], r[5], r[3]) for r in rows if r[0] == name)
        want = []
        for share in (1 / 24, 6 / 24, 1.0):
            tail = own[max(0, int(len(own) * (1.0 - share))):]
            want.append((sum(t[2] == "error" for t in tail), len(tail)))
        assert got[name] == want


TRACE = "trace_id string, service string, timestamp timestamp"


def test_service_graph(make):
    rows = [(f"t{i}", s, minute(j)) for i in range(3) for j, s in enumerate(["api", "auth"])]
    edges = gr.service_graph(gr.trace_first_seen(make(rows, TRACE)), min_weight=1)
    assert [tuple(r) for r in edges.collect()] == [("api", "auth", 3)]
    assert gr.service_graph(gr.trace_first_seen(make(rows[:4], TRACE)), min_weight=1).count() == 0


EDGE = "src string, dst string, weight bigint"
AFFECTED = "incident_id string, service string, onset timestamp"


def _path(make, edges, affected, depth=8):
    e = make([(a, b, 3) for a, b in edges] or [("-", "-", 3)], EDGE)
    a = make(affected, AFFECTED)
    roots = gr.cascade_root(a, e)
    return {r["incident_id"]: (r["root_service"], r["cascade_path"]) for r in gr.cascade_path(roots, a, e, depth).collect()}


def test_cascade(make):
    affected = [("i", "auth", minute(0)), ("i", "api", minute(1)), ("i", "frontend", minute(2)), ("j", "api", minute(0)), ("j", "worker", minute(5))]
    got = _path(make, [("auth", "api"), ("api", "frontend"), ("api", "db")], affected)
    assert got == {"i": ("auth", ["auth", "api", "frontend"]), "j": ("api", ["api"])}


def test_cascade_cycle_and_depth(make):
    chain = [f"s{i}" for i in range(10)]
    affected = [("i", s, minute(i)) for i, s in enumerate(chain)]
    edges = list(zip(chain, chain[1:])) + [("s9", "s0")]
    assert _path(make, edges, affected, 4)["i"] == ("s0", chain[:4])
    assert _path(make, edges, affected)["i"] == ("s0", chain[:8])


INCIDENT = "incident_id string, service string, category string, severity string, environment string, fingerprint string, title string, updated_at timestamp"


def test_similar(make):
    rows = [
        ("a", "api", "database", "error", "prod", "f" * 40, "db down hard", minute(0)),
        ("b", "api", "database", "error", "prod", "f" * 40, "db down hard", minute(1)),
        ("c", "web", "network", "debug", "qa", "0" * 40, "slow dns", minute(2)),
    ]
    df = make(rows, INCIDENT)
    got = [(r["incident_id"], round(r["score"], 6)) for r in sim.similar_to(df, "a", min_score=0.0).collect()]
    assert got[0] == ("b", 1.0) and got[1][0] == "c" and got[1][1] < 0.3


@pytest.mark.parametrize("pool_size", [12, None])
def test_similar_to_recent_matches_brute_force(make, monkeypatch, pool_size):
    monkeypatch.setattr(sim, "BLOCK", 4)
    rows = [
        (f"i{n:02d}", f"s{n % 3}", f"c{n % 2}", ["debug", "info", "error"][n % 3], "prod" if n % 4 else "qa",
         f"{n * 7919 % 256:02x}{n % 4:016d}" if n % 9 else None, f"{'disk' if n % 2 else 'queue'} case {n % 5} down", minute(n))
        for n in range(40)
    ]
    df = make(rows, INCIDENT)
    got = {}
    for r in sim.similar_to_recent(df, pool_size=pool_size, k=3).collect():
        got.setdefault(r["incident_id"], []).append((r["rank"], r["similar_id"], round(r["score"], 6)))
    pool = df.orderBy(F.desc("updated_at")).limit(pool_size or 40)
    for n in (0, 17, 35, 39):
        source = f"i{n:02d}"
        both = pool.unionByName(df.where(F.col("incident_id") == source)).dropDuplicates(["incident_id"])
        want = [(i + 1, r["incident_id"], round(r["score"], 6)) for i, r in enumerate(sim.similar_to(both, source, k=3).collect())]
        assert sorted(got[source]) == want


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_titles_with_rare_words_match_brute_force(make, monkeypatch, common):
    monkeypatch.setattr(sim, "COMMON", common)
    blocks = []
    compare = sim._near_classes
    monkeypatch.setattr(sim, "_near_classes", lambda kinds, pool, *rest: blocks.append(kinds.count()) or compare(kinds, pool, *rest))
    draw = random.Random(4)
    rows = [
        (f"i{n:02d}", f"s{n % 2}", "c", draw.choice(["info", "error"]), "prod", f"{draw.randrange(4):x}{n:015x}" if n % 9 else None,
         None if n == 5 else f"case{n} of host{n // 3} {draw.choice(['down', 'slow', 'disk down'])}", minute(n))
        for n in range(60)
    ]
    df = make(rows, INCIDENT)
    got = {}
    for r in sim.similar_to_recent(df, k=3).collect():
        got.setdefault(r["incident_id"], []).append((r["rank"], r["similar_id"], round(r["score"], 6)))
    for n in (0, 5, 17, 35, 59):
        want = [(i + 1, r["incident_id"], round(r["score"], 6)) for i, r in enumerate(sim.similar_to(df, f"i{n:02d}", k=3).collect())]
        assert sorted(got[f"i{n:02d}"]) == want
    assert common != 3 or blocks[0] < 30  # not the 60 distinct titles


def test_transitions(make):
    latest = make([("i", "resolved"), ("j", "open")], "incident_id string, status string")
    asked = make(
        [("i", 1, "acknowledged", "a", None, minute(0)), ("i", 2, "reopened", "a", "again", minute(1)),
         ("i", 3, "mitigated", "a", None, minute(90)), ("j", 4, "closed", "a", None, minute(0)),
         ("k", 5, "open", "a", None, minute(0)), ("j", 6, "resolved", "a", "done", minute(3))],
        "incident_id string, request_id int, next_status string, actor string, note string, requested_at timestamp",
    )
    out = inc.apply_transitions(asked, latest)
    got = {r["request_id"]: (r["from_status"], r["reason"]) for r in out["outcomes"].collect()}
    assert got == {
        1: ("resolved", "transition_not_allowed"), 2: ("resolved", None), 3: ("reopened", None),
        4: ("open", "unknown_status"), 5: (None, "incident_not_found"), 6: ("open", None),
    }
    final = {r["incident_id"]: r for r in out["snapshots"].collect()}
    assert final["i"]["status"] == "mitigated" and '"last_status_note":"again"' in final["i"]["context_json"]
    assert final["j"]["status"] == "resolved" and str(final["j"]["resolved_at"]) == "2024-01-01 10:03:00"
    assert out["events"].count() == 3


def test_transitions_of_a_hot_incident(spark):
    draw = random.Random(5)
    names = [*inc.STATUSES, "closed", None]
    rows = [("hot", k, draw.choice(names), draw.randrange(3_000_000_000)) for k in range(20_000)]
    rows += [(f"i{k % 40}", 20_000 + k, draw.choice(names), draw.randrange(40) * 1_800_000_000) for k in range(400)]
    rows += [("odd", 30_000, "resolved", 5), ("odd", 30_001, "reopened", None)]
    asked = spark.createDataFrame(rows, "incident_id string, request_id int, next_status string, us long").select(
        "incident_id", "request_id", "next_status", F.lit("a").alias("actor"), F.lit(None).cast("string").alias("note"),
        F.timestamp_micros("us").alias("requested_at"),
    )
    base = {"hot": "open", "odd": "resolved", **{f"i{k}": inc.STATUSES[k % 5] for k in range(40)}}
    latest = spark.createDataFrame(list(base.items()), "incident_id string, status string")
    want, state = {}, dict(base)
    for incident, request, wanted, _ in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[1])):
        want[request] = state[incident]
        if wanted in inc.TRANSITIONS[state[incident]]:
            state[incident] = wanted
    got = {r["request_id"]: r["from_status"] for r in inc.transition_outcomes(asked, latest).collect()}
    assert got == want


def test_sessions(make):
    rows = [("f", "s", "e", "c", f"c{i}", minute(m), minute(m), 1, float(m)) for i, m in enumerate((0, 20, 45, 120))]
    df = make(rows, "fingerprint string, service string, environment string, category string, candidate_id string, start_time timestamp, end_time timestamp, signal_count int, anomaly_score double")
    got = inc.incident_sessions(df).orderBy("session_start").collect()
    assert [(r["candidates"], r["max_score"]) for r in got] == [(3, 45.0), (1, 120.0)]


LOG = "service string, category string, severity string, message string, timestamp timestamp, log_id int"


def test_legacy_incidents(make):
    rows = [("api", "database", "error", f"db timeout {i}", minute(i), i) for i in range(4)]
    rows += [("web", "network", "critical", "dns", minute(9), 8), ("web", "network", "critical", "dns", minute(8), 9)]
    got = inc.legacy_incidents(make(rows, LOG)).collect()
    assert len(got) == 1 and got[0]["event_count"] == 4 and got[0]["status"] == "open"
    assert got[0]["title"] == "[database] api: db timeout <n>"
    assert got[0]["sample_messages"] == [f"db timeout {i}" for i in range(4)]
    old = make([(got[0]["fingerprint"], "x", "resolved", minute(0, 8), 7)],
               "fingerprint string, id string, status string, first_seen timestamp, event_count bigint")
    again = inc.legacy_incidents(make(rows, LOG), old).first()
    assert (again["id"], again["status"], again["event_count"], str(again["first_seen"])) == (
        "x", "reopened", 11, "2024-01-01 08:00:00")


FEATURE = "service string, environment string, severity string, minute_bucket timestamp, count bigint"


def test_features_burn_and_anomalies(make):
    base = [("api", "prod", "error", minute(120), 4), ("api", "prod", "info", minute(120), 6), ("api", "qa", "error", minute(120), 1)]
    burn = make([("api", "prod", minute(115), "5m", 75.0), ("api", "prod", minute(60), "1h", 12.5), ("api", "prod", minute(60), "9h", 1.0)],
                "service string, environment string, window_start timestamp, window_size string, error_budget_consumption double")
    marks = make([("api", "prod", minute(110)), ("api", "prod", minute(70)), ("api", "prod", minute(0)), ("api", "", minute(60)),
                  ("api", "prod", minute(120))], "service string, environment string, minute_bucket timestamp")
    got = {r["environment"]: r for r in ft.risk_features(make(base, FEATURE), burn, marks).collect()}
    p = got["prod"]
    assert (p["burn_rate_5m"], p["burn_rate_1h"], p["burn_rate_6h"]) == (75.0, 12.5, 0.0)
    assert (p["anomalies_last_60m"], got["qa"]["anomalies_last_60m"]) == (3.0, 1.0)
    assert (p["err_ratio_now"], p["total_count_now"], p["hour_of_day"], p["day_of_week"]) == (0.4, 10.0, 12.0, 0.0)
    assert len(p) == 3 + 32


def test_rolling_windows_are_one_row_longer(make):
    rows = [("s", "e", "error", minute(i), i) for i in range(10)]
    last = ft.risk_features(make(rows, FEATURE)).orderBy(F.desc("minute_bucket")).first()
    assert (last["err_mean_5m"], last["err_slope_5m"], last["err_lag_10m"], last["err_lag_3m"]) == (6.5, 1.0, 0.0, 6.0)
    assert last["err_accel_3m"] == 0.0


def test_lookahead(make):
    points = make([("s", minute(i)) for i in (0, 14, 15, 30)], "service string, minute_bucket timestamp")
    bursts = make([("s", minute(15))], "service string, minute_bucket timestamp")
    got = {str(r["minute_bucket"])[11:16]: r["label"] for r in ft.lookahead_label(points, bursts).collect()}
    assert got == {"10:00": 1, "10:14": 1, "10:15": 0, "10:30": 0}


def test_time_split(make):
    rows = [("s", "e", minute(i // 3)) for i in range(100)]
    df = make([(f"s{i}", "e", r[2]) for i, r in enumerate(rows)], "service string, environment string, minute_bucket timestamp")
    got = ft.time_split(df, 0.7)
    assert got.where("is_train").count() == 70 and got.count() == 100
    assert got.where("is_train").agg(F.max("minute_bucket")).first()[0] <= got.where("NOT is_train").agg(F.min("minute_bucket")).first()[0]


def test_average_precision_and_auc(make):
    df = make([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "score double, label int")
    got = ev.auc_ap(df).first()
    pairs = [(a, b) for a, la in [(0.9, 1), (0.7, 1)] for b, lb in [(0.8, 0), (0.7, 0), (0.1, 0)]]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(got["roc_auc"] - auc) < 1e-9
    assert abs(got["pr_auc"] - (0.5 * 1.0 + 0.5 * 2 / 4)) < 1e-9


def test_best_f1_brute_force(make):
    rows = [((i * 37 % 101) / 10.0, int(i % 3 == 0 and i * 37 % 101 > 40)) for i in range(101)]
    got = ev.best_f1(make(rows, "score double, label int")).first()
    top = max(s for s, _ in rows)
    best = None
    for k in range(200):
        t = top if k == 199 else k * (top / 199)
        tp = sum(s >= t and y for s, y in rows)
        fp = sum(s >= t and not y for s, y in rows)
        fn = sum(s < t and y for s, y in rows)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if best is None or round(f1, 4) > round(best[1], 4):
            best = (t, f1)
    assert abs(got["threshold"] - best[0]) < 1e-9 and abs(got["f1"] - best[1]) < 1e-9


def test_guarded_sql(spark):
    spark.range(5).createOrReplaceTempView("guarded")
    assert tables.guarded_sql(spark, "```sql\nSELECT id FROM guarded LIMIT 2\n```").count() == 2
    for text in ("DROP TABLE guarded", "SELECT id FROM guarded"):
        with pytest.raises(ValueError):
            tables.guarded_sql(spark, text)


def test_profile_allows_listed_columns(make):
    df = make([("a", "s")], "product string, service string")
    assert src.profile_column(df, "column_name='service'").first()[0] == "s"
    with pytest.raises(ValueError):
        src.profile_column(df, "message")


def test_stratified_split_takes_the_same_share_of_each_class(spark):
    from lumenlog.operators import features as ft

    rows = spark.range(2000).selectExpr(
        "concat('s', id % 7) AS service", "'prod' AS environment", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT), 0) AS minute_bucket",
        "CAST(id % 40 = 0 AS INT) AS label",
    )
    got = {(r.label, r.is_train): r["count"] for r in ft.stratified_split(rows).groupBy("label", "is_train").count().collect()}
    assert got == {(1, True): 37, (1, False): 13, (0, True): 1462, (0, False): 488}


def test_every_hour_has_burn_rows(spark):
    dir = "/root/testdata/sf0.001"
    hours = ft.severity_minutes(risk_plans._signals(spark, dir)).count()
    assert risk_plans._burn_rows(spark, dir).count() == 3 * hours
    assert risk_plans._features(spark, dir).where("(err_count_now > 0) != (burn_rate_5m > 0)").count() == 0


def test_risk_queries_train_with_the_operators_settings(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(risk, "train", lambda labelled, **settings: asked.append(settings))
    risk_plans._model(spark, "/root/testdata/sf0.001")
    assert asked == [{}]


def test_small_gains_do_not_stop_the_boosting(spark):
    dir = "/root/testdata/sf0.001"
    labelled = ft.join_labels(risk_plans._features(spark, dir), risk_plans._labels(spark, dir))
    model, _ = risk.train(labelled, rounds=3, depth=2)
    assert model.getNumTrees > 1 and model.getOrDefault("validationTol") == 0


@pytest.mark.parametrize("limit", [None, 50])
def test_all_candidates_are_evidence(spark, limit):
    start = "timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id)"
    candidates = spark.range(60).selectExpr(
        "concat('c', lpad(id, 2, '0')) AS candidate_id", "CAST(NULL AS STRING) AS incident_id", "'f' AS fingerprint", "'s' AS service",
        "'prod' AS environment", "'c' AS category", "'error' AS severity", "'m' AS normalized_message", f"{start} AS start_time",
        f"{start} AS end_time", "1L AS signal_count", "1.0D AS anomaly_score", "array('t') AS trace_ids", "array('x') AS source_signals",
        "'new' AS status", f"{start} AS created_at", f"{start} AS updated_at",
    )
    latest = spark.createDataFrame([], inc.INCIDENTS)
    burn = spark.createDataFrame([], "service string, environment string, burn_rate_5m double, burn_rate_1h double, burn_rate_6h double")
    now = ref_column("2024-01-02 00:00:00")
    [row] = inc.correlate_candidates(candidates, latest, burn, now, evidence_limit=limit)["snapshots"].collect()
    assert row["evidence"] == [f"c{k:02d}" for k in range(60)][-(limit or 60) :]


def test_scoring_makes_the_signals_once(spark, make):
    made = spark.sparkContext.accumulator(0)

    def count(n):
        made.add(1)
        return n

    rows = [(minute(i), "api", "prod", "database", "error", f"f{i}", "text", c, "") for i, c in enumerate([2, 3, 2, 4, 3, 90])]
    names = "minute timestamp, service string, environment string, category string, severity string, fingerprint string, normalized_message string, signal_count bigint, trace_sample string"
    signals = make(rows, names).withColumn("signal_count", F.udf(count, "bigint")("signal_count"))
    got = an.score_signals(signals, threshold=3.5).where("is_anomaly").collect()
    assert [r.signal_count for r in got] == [90]
    assert made.value == len(rows)
