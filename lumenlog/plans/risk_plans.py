"""Queries over risk features, labels, detector evaluation and the risk model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import enrich as en
from lumenlog.functions.ids import ref_column
from lumenlog.operators import anomalies as an
from lumenlog.operators import evaluate as ev
from lumenlog.operators import features as ft
from lumenlog.operators import signals as sg
from lumenlog.plans import sql as q
from lumenlog.plans import views
from lumenlog.plans.registry import query, r6, ts_text

# Hourly points: the given events are too sparse for one-minute series.
POINTS = f"""{q.ENRICHED}, pts AS (SELECT service, environment, date_trunc('hour', timestamp) AS m,
   CAST(count(*) FILTER (severity IN ('error', 'critical')) AS DOUBLE) AS err,
   CAST(count(*) FILTER (severity = 'warning') AS DOUBLE) AS warn, CAST(count(*) AS DOUBLE) AS total
   FROM enriched GROUP BY ALL)"""


def _signals(spark, sf):
    rows = en.with_dimensions(en.enrich(views.logs(spark, sf)))
    return rows.groupBy("service", "environment", "severity", F.date_trunc("hour", "timestamp").alias("minute_bucket")).agg(
        F.count(F.lit(1)).alias("count")
    )


@query(
    "severity_minutes",
    f"""WITH {POINTS} SELECT service, environment, {q.ts('m', 'minute_bucket')}, CAST(err AS BIGINT) AS err,
        CAST(warn AS BIGINT) AS warn, CAST(total AS BIGINT) AS total FROM pts""",
)
def severity_minutes(spark, sf):
    return ft.severity_minutes(_signals(spark, sf)).withColumn("minute_bucket", ts_text("minute_bucket"))


def _over(expr: str, n: int) -> str:
    return f"{expr} OVER (PARTITION BY service, environment ORDER BY m ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _lag(c: str, n: int) -> str:
    return f"lag({c}, {n}, 0.0) OVER (PARTITION BY service, environment ORDER BY m)"


_SERIES_SQL = {
    "err_count_now": "err", "warn_count_now": "warn", "total_count_now": "total", "err_ratio_now": "err / total",
    "err_lag_1m": _lag("err", 1), "err_lag_3m": _lag("err", 3), "err_lag_5m": _lag("err", 5),
    "err_lag_10m": _lag("err", 10), "warn_lag_3m": _lag("warn", 3), "warn_lag_5m": _lag("warn", 5),
    "err_mean_5m": _over("avg(err)", 5), "err_max_5m": _over("max(err)", 5), "err_std_5m": _over("stddev_pop(err)", 5),
    "warn_mean_5m": _over("avg(warn)", 5), "err_mean_15m": _over("avg(err)", 15), "err_max_15m": _over("max(err)", 15),
    "err_sum_15m": _over("sum(err)", 15), "warn_mean_15m": _over("avg(warn)", 15),
    "err_mean_60m": _over("avg(err)", 60), "err_std_60m": _over("stddev_pop(err)", 60),
    "err_delta_1m": f"err - {_lag('err', 1)}", "err_delta_5m": f"err - {_lag('err', 5)}",
    "err_accel_3m": f"(err - {_lag('err', 1)}) - ({_lag('err', 1)} - {_lag('err', 2)})",
    "err_ratio_to_60m": f"CASE WHEN {_over('avg(err)', 60)} > 0 THEN err / {_over('avg(err)', 60)} ELSE 0.0 END",
    "warn_ratio_to_60m": f"CASE WHEN {_over('avg(warn)', 60)} > 0 THEN warn / {_over('avg(warn)', 60)} ELSE 0.0 END",
    "err_slope_5m": f"CASE WHEN {_over('count(*)', 5)} < 2 THEN 0.0 ELSE {_over('regr_slope(err, i)', 5)} END",
    "hour_of_day": "CAST(hour(m) AS DOUBLE)", "day_of_week": "CAST(isodow(m) - 1 AS DOUBLE)",
}
_NUMBERED = f"{POINTS}, num AS (SELECT *, CAST(row_number() OVER (PARTITION BY service, environment ORDER BY m) AS DOUBLE) AS i FROM pts)"


def _series_query(names):
    cols = ", ".join(f"round({_SERIES_SQL[n]}, 6) AS {n}" for n in names)
    return f"WITH {_NUMBERED} SELECT service, environment, {q.ts('m', 'minute_bucket')}, {cols} FROM num"


_LAGS = [n for n in ft.FEATURES if "_lag_" in n]
_ROLLING = [n for n in ft.FEATURES if any(k in n for k in ("_mean_", "_max_", "_std_", "_sum_"))]
_TREND = [n for n in ft.FEATURES if any(k in n for k in ("delta", "accel", "ratio", "slope"))]


def _series(spark, sf, names):
    rows = ft.series_features(ft.severity_minutes(_signals(spark, sf)))
    return rows.select("service", "environment", ts_text("minute_bucket"), *[r6(n) for n in names])


@query("lag_features", _series_query(_LAGS))
def lag_features(spark, sf):
    return _series(spark, sf, _LAGS)


@query("rolling_features", _series_query(_ROLLING))
def rolling_features(spark, sf):
    return _series(spark, sf, _ROLLING)


@query("trend_features", _series_query(_TREND))
def trend_features(spark, sf):
    return _series(spark, sf, _TREND)


def _burn_rows(spark, sf):
    """A burn row of each size for every hour of a series."""
    rows = ft.severity_minutes(_signals(spark, sf))
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.lit(m).alias("mins")) for n, m in ft.BURN_MINUTES.items()]))
    return rows.withColumn("s", sizes).select(
        "service", "environment", F.col("s.size").alias("window_size"),
        (F.col("minute_bucket") - F.make_dt_interval(mins=F.col("s.mins"))).alias("window_start"),
        (F.col("err") / F.col("total") * F.col("s.mins")).alias("error_budget_consumption"),
        F.col("minute_bucket").alias("created_at"),
    )


_BURN_COLS = ", ".join(
    f"round(err / total * {mins}, 6) AS burn_rate_{name}"
    for name, mins in ft.BURN_MINUTES.items()
)


def _marks(spark, sf):
    """Hours with a server error; the mailer's carry no environment and count everywhere."""
    hits = views.logs(spark, sf).where("status_code = 503")
    return hits.select(
        "service", F.when(F.col("service") == "mailer", "").otherwise(F.col("environment")).alias("environment"),
        F.date_trunc("hour", "timestamp").alias("minute_bucket"),
    )


_MARKS = """marks AS (SELECT DISTINCT service, CASE WHEN service = 'mailer' THEN '' ELSE environment END AS env,
   date_trunc('hour', timestamp) AS a FROM logs WHERE status_code = 503),
near AS (SELECT p.service, p.environment, p.m, count(DISTINCT k.a) AS n FROM pts p LEFT JOIN marks k
   ON k.service = p.service AND k.env IN (p.environment, '') AND k.a < p.m AND k.a >= p.m - INTERVAL 60 HOUR GROUP BY ALL)"""


@query(
    "anomalies_last_60m",
    f"""WITH {POINTS}, {_MARKS} SELECT service, environment, {q.ts('m', 'minute_bucket')},
        CAST(n AS DOUBLE) AS anomalies_last_60m FROM near WHERE n > 0""",
)
def anomalies_last_60m(spark, sf):
    points = ft.severity_minutes(_signals(spark, sf))
    rows = ft.anomalies_last_hour(points, _marks(spark, sf), "hour")
    return rows.withColumn("minute_bucket", ts_text("minute_bucket"))


def _features(spark, sf):
    return ft.risk_features(_signals(spark, sf), _burn_rows(spark, sf), _marks(spark, sf), "hour")


_ALL_COLS = ", ".join(f"round({x}, 6) AS {n}" for n, x in _SERIES_SQL.items())
_FEATURES_SQL = f"""{_NUMBERED}, {_MARKS}, feats AS (SELECT service, environment, m, {_ALL_COLS}, {_BURN_COLS},
   CAST(n AS DOUBLE) AS anomalies_last_60m FROM num JOIN near USING (service, environment, m))"""


@query("risk_features", f"WITH {_FEATURES_SQL} SELECT * EXCLUDE (m), {q.ts('m', 'minute_bucket')} FROM feats")
def risk_features(spark, sf):
    rows = _features(spark, sf)
    return rows.select("service", "environment", ts_text("minute_bucket"), *[r6(n) for n in ft.FEATURES])


@query(
    "latest_features",
    f"""WITH {_FEATURES_SQL} SELECT * EXCLUDE (m, rn), strftime(m, '%Y-%m-%d %H:%M:%S') AS minute_bucket
        FROM (SELECT *, row_number() OVER (PARTITION BY service, environment ORDER BY m DESC) AS rn FROM feats) WHERE rn = 1""",
)
def latest_features(spark, sf):
    rows = ft.latest_features(_features(spark, sf))
    return rows.select("service", "environment", ts_text("minute_bucket"), *[r6(n) for n in ft.FEATURES])


_BURSTS = """bursts AS (SELECT DISTINCT service, date_trunc('hour', timestamp) AS b FROM logs
   WHERE status_code = 503 AND event_type = 'error')"""


def _bursts(spark, sf):
    hits = views.logs(spark, sf).where("status_code = 503 AND event_type = 'error'")
    return hits.select("service", F.date_trunc("hour", "timestamp").alias("minute_bucket")).distinct()


_LABELLED = f"""{POINTS}, {_BURSTS}, spots AS (SELECT DISTINCT service, m FROM pts),
lab AS (SELECT s.service, s.m, max(CASE WHEN b IS NULL THEN 0 ELSE 1 END) AS label FROM spots s LEFT JOIN bursts k
   ON k.service = s.service AND k.b > s.m AND k.b <= s.m + INTERVAL 15 HOUR GROUP BY ALL)"""


def _labels(spark, sf):
    points = ft.severity_minutes(_signals(spark, sf)).select("service", "minute_bucket").distinct()
    return ft.lookahead_label(points, _bursts(spark, sf), 15, "hour")


@query("lookahead_label", f"WITH {_LABELLED} SELECT service, {q.ts('m', 'minute_bucket')}, label FROM lab")
def lookahead_label(spark, sf):
    return _labels(spark, sf).withColumn("minute_bucket", ts_text("minute_bucket"))


@query(
    "labelled_features",
    f"""WITH {_LABELLED} SELECT service, label, count(*) AS rows, CAST(sum(err) AS DOUBLE) AS errors
        FROM pts JOIN lab USING (service, m) GROUP BY ALL""",
)
def labelled_features(spark, sf):
    rows = ft.join_labels(_features(spark, sf), _labels(spark, sf))
    return rows.groupBy("service", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("err_count_now").alias("errors")
    )


@query(
    "time_split",
    f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (ORDER BY m, service, environment) AS rn, count(*) OVER () AS n FROM pts)
        SELECT service, environment, {q.ts('m', 'minute_bucket')}, rn <= floor(n * 0.7) AS is_train FROM r""",
)
def time_split(spark, sf):
    rows = ft.time_split(ft.severity_minutes(_signals(spark, sf)), 0.7)
    return rows.select("service", "environment", ts_text("minute_bucket"), "is_train")


@query(
    "class_weight",
    f"WITH {_LABELLED} SELECT round((count(*) - sum(label)) / sum(label), 6) AS weight, count(*) AS rows FROM lab",
)
def class_weight(spark, sf):
    rows = _labels(spark, sf)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("weight", F.round(ft.class_weight(rows), 6))


def _detector_points(spark, sf):
    rows = en.enrich(views.logs(spark, sf))
    return rows.groupBy("service", F.date_trunc("hour", "timestamp").alias("minute_bucket")).agg(
        F.count_if(F.lower(F.trim("level")).isin("error", "critical", "fatal")).alias("count")
    )


def _hist(expr: str, far: int, near: int) -> str:
    return f"{expr} OVER (PARTITION BY service ORDER BY m ROWS BETWEEN {far} PRECEDING AND {near} PRECEDING)"


_DETECT = f"""{q.LOGS}, p AS (SELECT service, date_trunc('hour', timestamp) AS m,
   CAST(count(*) FILTER (lower(trim(level)) IN ('error', 'critical', 'fatal')) AS DOUBLE) AS x FROM logs GROUP BY ALL),
h AS (SELECT *, {_hist('list(x)', 66, 7)} AS xs, {_hist('avg(x)', 66, 7)} AS mu, {_hist('stddev_pop(x)', 66, 7)} AS sd,
   {_hist('count(x)', 66, 7)} AS n, {_hist('avg(x)', 21, 7)} AS rmu, {_hist('stddev_pop(x)', 21, 7)} AS rsd,
   {_hist('count(x)', 21, 7)} AS rn FROM p),
md AS (SELECT *, list_aggregate(xs, 'median') AS med FROM h),
mm AS (SELECT *, list_aggregate(list_transform(xs, lambda v: abs(v - med)), 'median') AS mad FROM md),
det AS (SELECT service, m, x,
   CASE WHEN n < 5 THEN 0.0 ELSE greatest(0.0, 0.6745 * (x - med) / (CASE WHEN mad = 0 THEN greatest(1.0, med * 0.5) ELSE mad END)) END AS mad_z,
   CASE WHEN n < 5 THEN 0.0 ELSE greatest(0.0, (x - mu) / (CASE WHEN sd = 0 THEN greatest(1.0, mu * 0.5) ELSE sd END)) END AS classic_z,
   CASE WHEN rn < 5 THEN 0.0 ELSE greatest(0.0, (x - rmu) / (CASE WHEN rsd = 0 THEN greatest(1.0, rmu * 0.5) ELSE rsd END)) END AS rolling_z
   FROM mm)"""


@query(
    "detector_scores",
    f"""WITH {_DETECT} SELECT service, {q.ts('m', 'minute_bucket')}, CAST(x AS BIGINT) AS count, round(mad_z, 6) AS mad_z,
        round(classic_z, 6) AS classic_z, round(rolling_z, 6) AS rolling_z FROM det""",
)
def detector_scores(spark, sf):
    rows = ev.detector_scores(_detector_points(spark, sf))
    return rows.select("service", ts_text("minute_bucket"), "count", r6("mad_z"), r6("classic_z"), r6("rolling_z"))


def _scored(spark, sf):
    return views.table(spark, sf, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label")
    )


SCORED = "scored AS (SELECT value AS score, CAST(event_type = 'error' AS INT) AS label FROM events)"
_F1 = "CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END"


@query(
    "confusion_at",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 50 AND label = 1) AS tp,
          count(*) FILTER (score >= 50 AND label = 0) AS fp, count(*) FILTER (score < 50 AND label = 1) AS fn,
          count(*) FILTER (score < 50 AND label = 0) AS tn FROM scored)
        SELECT tp, fp, fn, tn, 50.0 AS threshold, round(tp / greatest(tp + fp, 1), 6) AS precision,
          round(tp / greatest(tp + fn, 1), 6) AS recall, round({_F1}, 6) AS f1 FROM c""",
)
def confusion_at(spark, sf):
    rows = ev.confusion_at(_scored(spark, sf), 50.0)
    return rows.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(
    "best_f1",
    f"""WITH {SCORED}, grid AS (SELECT i, CASE WHEN i = 199 THEN mx ELSE i * (mx / 199.0) END AS threshold
          FROM (SELECT max(score) AS mx FROM scored), range(200) r(i)),
        hist AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
        c AS (SELECT i, threshold, coalesce(sum(pos) FILTER (score >= threshold), 0) AS tp,
              coalesce(sum(neg) FILTER (score >= threshold), 0) AS fp,
              coalesce(sum(pos) FILTER (score < threshold), 0) AS fn FROM grid, hist GROUP BY ALL)
        SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
          CAST(fn AS BIGINT) AS fn, round({_F1}, 6) AS f1 FROM c ORDER BY round({_F1}, 4) DESC, i LIMIT 1""",
)
def best_f1(spark, sf):
    rows = ev.best_f1(_scored(spark, sf))
    return rows.select(r6("threshold"), "tp", "fp", "fn", r6("f1"))


_AUC = """hist AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM hist)
SELECT round(1.0 - sum(pos * (cn - neg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc,
  round(sum(pos * cp / CAST(cp + cn AS DOUBLE)) / sum(pos), 6) AS pr_auc, CAST(sum(pos) AS BIGINT) AS positives,
  CAST(sum(neg) AS BIGINT) AS negatives FROM cum"""


def _auc_columns(df):
    return df.select(r6("roc_auc"), r6("pr_auc"), "positives", "negatives")


@query("auc_ap", f"WITH {SCORED}, {_AUC}")
def auc_ap(spark, sf):
    return _auc_columns(ev.auc_ap(_scored(spark, sf)))


@query(
    "auc_ap_documents",
    f"WITH scored AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id)), {_AUC}",
)
def auc_ap_documents(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return _auc_columns(ev.auc_ap(docs.join(labels, "doc_id").select("score", "label")))


def _truth(spark, sf):
    """Detector scores with ground truth; points without a label count as normal."""
    scores = ev.detector_scores(_detector_points(spark, sf))
    truth = _bursts(spark, sf).withColumn("label", F.lit(1))
    joined = scores.join(truth, ["service", "minute_bucket"], "left")
    return joined.withColumn("label", F.coalesce("label", F.lit(0)))


def _eval_sql(name: str) -> str:
    return f"""SELECT '{name}' AS detector, (SELECT round(1.0 - sum(pos * (cn - neg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6)
      FROM cum_{name}) AS roc_auc, (SELECT round(sum(pos * cp / CAST(cp + cn AS DOUBLE)) / sum(pos), 6) FROM cum_{name}) AS pr_auc,
      (SELECT round({_F1}, 6) FROM (SELECT sum(pos) FILTER (score >= 3.5) AS tp, sum(neg) FILTER (score >= 3.5) AS fp,
        sum(pos) FILTER (score < 3.5) AS fn FROM cum_{name})) AS fixed_f1"""


def _cum_sql(name: str) -> str:
    return f"""cum_{name} AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn
      FROM (SELECT round({name}, 9) AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM truth GROUP BY 1))"""


DETECTORS = ["mad_z", "classic_z", "rolling_z"]


@query(
    "detector_eval",
    f"""WITH {_DETECT}, {_BURSTS}, truth AS (SELECT det.*, CASE WHEN b IS NULL THEN 0 ELSE 1 END AS label FROM det
          LEFT JOIN bursts ON bursts.service = det.service AND b = m),
        {', '.join(_cum_sql(n) for n in DETECTORS)} {' UNION ALL '.join(_eval_sql(n) for n in DETECTORS)}""",
)
def detector_eval(spark, sf):
    rows = _truth(spark, sf).withColumns({d: F.round(d, 9) for d in DETECTORS})
    return ev.evaluate_detectors(rows, DETECTORS).select("detector", r6("roc_auc"), r6("pr_auc"), r6("fixed_f1"))


def _model(spark, sf):
    from lumenlog.operators import risk

    labelled = ft.join_labels(_features(spark, sf), _labels(spark, sf))
    return risk.train(labelled)


@query("train_risk_model")
def train_risk_model(spark, sf):
    from lumenlog.operators import risk

    return risk.training_report(*_model(spark, sf))


@query("risk_scores")
def risk_scores(spark, sf):
    from lumenlog.operators import risk

    model, rows = _model(spark, sf)
    return risk.risk_scores(model, ft.latest_features(rows.drop("label", "is_train")))


@query("risk_explain")
def risk_explain(spark, sf):
    from lumenlog.operators import risk

    model, rows = _model(spark, sf)
    return risk.explain(spark, model, ft.latest_features(rows.drop("label", "is_train")))


@query("iforest_scores")
def iforest_scores(spark, sf):
    from lumenlog.operators.iforest import iforest_scores as score

    return score(_detector_points(spark, sf))


@query("iforest_eval")
def iforest_eval(spark, sf):
    from lumenlog.operators.iforest import iforest_scores as score

    truth = _bursts(spark, sf).withColumn("label", F.lit(1))
    rows = score(_detector_points(spark, sf)).join(truth, ["service", "minute_bucket"], "left")
    return ev.evaluate_detectors(rows.withColumn("label", F.coalesce("label", F.lit(0))), ["iforest"])
