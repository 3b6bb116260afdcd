"""Queries over raw and enriched logs: scans, search, enrichment and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import enrich as en
from lumenlog.functions import text as tx
from lumenlog.functions.ids import (
    anomaly_id, iso_utc, json_map, parse_timestamp, ref_column, signal_id,
)
from lumenlog.operators import signals as sg
from lumenlog.plans import sql as q
from lumenlog.plans import views
from lumenlog.plans.registry import query, r6, ts_text
from lumenlog.session import run_dir
from lumenlog.sources import logs as src
from lumenlog.sources import tables

NOW = "(SELECT max(timestamp) FROM logs)"


def now(logs):
    """Harness reference time: the newest log."""
    return logs.agg(F.max("timestamp")).scalar()


@query(
    "log_scan_range",
    f"""WITH {q.LOGS} SELECT {q.ts('timestamp')}, product, service, environment, level, status_code, trace_id,
        message, metadata FROM logs
        WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-12 00:00:00'""",
)
def log_scan_range(spark, sf):
    rows = src.scan_range(
        views.logs(spark, sf), ref_column("2024-01-10 00:00:00"), ref_column("2024-01-12 00:00:00")
    )
    return rows.withColumn("timestamp", ts_text("timestamp"))


@query(
    "log_scan_recent",
    f"""WITH {q.LOGS} SELECT log_id, {q.ts('timestamp')}, service FROM logs
        WHERE timestamp >= {NOW} - INTERVAL 2880 MINUTE""",
)
def log_scan_recent(spark, sf):
    logs = views.logs(spark, sf)
    return src.scan_recent(logs, now(logs), 2880).select("log_id", ts_text("timestamp"), "service")


@query(
    "recent_logs",
    f"""WITH {q.LOGS} SELECT log_id, {q.ts('timestamp')}, message FROM logs
        ORDER BY timestamp DESC, log_id DESC LIMIT 200""",
)
def recent_logs(spark, sf):
    rows = views.logs(spark, sf).orderBy(F.desc("timestamp"), F.desc("log_id")).limit(200)
    return rows.select("log_id", ts_text("timestamp"), "message")


@query(
    "log_search",
    f"""WITH {q.ENRICHED} SELECT log_id, {q.ts('timestamp')}, service, message, category, severity, origin
        FROM enriched WHERE environment = 'prod' AND contains(lower(message), 'after') AND severity = 'critical'
        ORDER BY enriched.timestamp DESC, log_id DESC LIMIT 100""",
)
def log_search(spark, sf):
    rows = src.list_logs(
        views.logs(spark, sf), limit=100, severity="critical", environment="prod", q="AFTER",
        ties=("log_id",),
    )
    return rows.select("log_id", ts_text("timestamp"), "service", "message", "category", "severity", "origin")


@query(
    "log_search_limit_first",
    f"""WITH {q.ENRICHED},
        page AS (SELECT * FROM enriched WHERE lower(level) = 'error' AND product = 'web'
                 ORDER BY timestamp DESC, log_id DESC LIMIT 500)
        SELECT log_id, category, severity FROM page WHERE category = 'network'""",
)
def log_search_limit_first(spark, sf):
    rows = src.list_logs(
        views.logs(spark, sf), limit=500, category="network", product="web", level="Error",
        compat_limit_first=True, ties=("log_id",),
    )
    return rows.select("log_id", "category", "severity")


@query(
    "trace_logs",
    f"""WITH {q.LOGS} SELECT {q.ts('timestamp')}, service, level, status_code, message FROM logs
        WHERE trace_id = 't40'""",
)
def trace_logs(spark, sf):
    return src.trace_logs(views.logs(spark, sf), "t40").withColumn("timestamp", ts_text("timestamp"))


@query(
    "json_decode",
    f"""WITH {q.LOGS}, decoded AS (SELECT log_id, CASE WHEN json_valid(metadata) THEN metadata END AS j FROM logs)
        SELECT log_id, coalesce(len(json_keys(j)), 0) AS n_keys, json_extract_string(j, '$.k') AS k,
               json_extract_string(j, '$.layer') AS layer FROM decoded""",
)
def json_decode(spark, sf):
    rows = src.decode_json(views.logs(spark, sf))
    return rows.select(
        "log_id", F.size("metadata").alias("n_keys"), F.col("metadata")["k"].alias("k"),
        F.col("metadata")["layer"].alias("layer"),
    )


@query(
    "csv_ingest",
    f"""WITH {q.LOGS} SELECT service, level, count(*) AS rows, sum(status_code) AS status_sum,
        sum(length(message)) AS message_chars, sum(length(metadata)) AS metadata_chars
        FROM logs GROUP BY ALL""",
)
def csv_ingest(spark, sf):
    path = run_dir(spark, "csv")
    rows = views.logs(spark, sf).select(*src.LOGS.fieldNames())
    rows.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = src.read_csv(spark, path)
    return back.groupBy("service", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("status_code").alias("status_sum"),
        F.sum(F.length("message")).alias("message_chars"),
        F.sum(F.length("metadata")).alias("metadata_chars"),
    )


@query(
    "append_sink",
    f"""WITH {q.LOGS} SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, service, count(*) AS rows,
        count(DISTINCT log_id) AS ids FROM logs GROUP BY ALL""",
)
def append_sink(spark, sf):
    root = run_dir(spark, "tables")
    tables.append(views.logs(spark, sf), "logs", root)
    stored = tables.read(spark, "logs", root)
    return stored.groupBy(F.col("dt").cast("string").alias("day"), "service").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("ids")
    )


@query(
    "guarded_sql",
    f"""WITH {q.LOGS} SELECT service, count(*) AS errors FROM logs WHERE status_code >= 500
        GROUP BY service ORDER BY errors DESC, service LIMIT 20""",
)
def guarded_sql(spark, sf):
    views.logs(spark, sf).createOrReplaceTempView("guarded_logs")
    return tables.guarded_sql(
        spark,
        "```sql\nSELECT service, count(*) AS errors FROM guarded_logs WHERE status_code >= 500 "
        "GROUP BY service ORDER BY errors DESC, service LIMIT 20\n```",
    )


@query(
    "dimension_tree",
    f"""WITH {q.LOGS}, leaf AS (SELECT product, service, string_agg(DISTINCT environment, ',' ORDER BY environment)
        AS envs FROM logs GROUP BY ALL)
        SELECT product, string_agg(service || '[' || envs || ']', ';' ORDER BY service) AS services FROM leaf
        GROUP BY product""",
)
def dimension_tree(spark, sf):
    tree = src.dimension_tree(views.logs(spark, sf))
    text = F.transform(
        "services",
        lambda s: F.concat(s["service"], F.lit("["), F.array_join(s["environments"], ","), F.lit("]")),
    )
    return tree.select("product", F.array_join(text, ";").alias("services"))


@query(
    "category_summary",
    f"""WITH {q.ENRICHED} SELECT 'category' AS kind, category AS name, count(*) AS count FROM enriched GROUP BY category
        UNION ALL SELECT 'severity', severity, count(*) FROM enriched GROUP BY severity""",
)
def category_summary(spark, sf):
    return src.category_summary(en.enrich(views.logs(spark, sf)))


@query("profile_column", f"WITH {q.LOGS} SELECT DISTINCT CAST(status_code AS VARCHAR) AS value FROM logs")
def profile_column(spark, sf):
    return src.profile_column(views.logs(spark, sf), "column_name='status_code'")


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"
        for t in ["events", "orders", "documents", "pages", "conversations", "labels"]
    ),
)
def table_counts(spark, sf):
    names = ["events", "orders", "documents", "pages", "conversations", "labels"]
    return tables.table_counts({t: views.table(spark, sf, t) for t in names})


@query("enrich_category", f"WITH {q.ENRICHED} SELECT log_id, category, category_reason FROM enriched")
def enrich_category(spark, sf):
    return en.with_category(views.logs(spark, sf)).select("log_id", "category", "category_reason")


_TEXT_HAY = "concat_ws(' ', " + ", ".join(q.lower_strip(c) for c in ("source", "lang", "''", "text")) + ")"


@query("enrich_category_texts", f"SELECT doc_id, {q._category(_TEXT_HAY, True)} AS category_reason FROM documents")
def enrich_category_texts(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("service"), F.col("lang").alias("product"),
        F.lit("").alias("environment"), F.col("text").alias("message"), F.lit(None).cast("string").alias("metadata"),
    )
    return en.with_category(docs).select("doc_id", "category_reason")


@query(
    "normalize_severity",
    f"WITH {q.ENRICHED} SELECT level, status_code, severity, count(*) AS rows FROM enriched GROUP BY ALL",
)
def normalize_severity(spark, sf):
    severity = en.normalize_severity(F.col("level"), F.col("status_code"))
    rows = views.logs(spark, sf).withColumn("severity", severity)
    return rows.groupBy("level", "status_code", "severity").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "enrich_logs",
    f"""WITH {q.ENRICHED} SELECT log_id, category, severity, origin, concat(category, ',', severity) AS tags
        FROM enriched""",
)
def enrich_logs(spark, sf):
    rows = en.enrich(views.logs(spark, sf))
    return rows.select("log_id", "category", "severity", "origin", F.array_join("tags", ",").alias("tags"))


@query(
    "message_template",
    f"""WITH {q.LOGS}, texts AS (
          SELECT 'doc' || doc_id AS id, text FROM documents
          UNION ALL SELECT 'page' || page_id, url FROM pages
          UNION ALL SELECT 'log' || log_id, message FROM logs)
        SELECT id, {q.template('text')} AS message_template FROM texts""",
)
def message_template(spark, sf):
    return _texts(spark, sf).select("id", tx.message_template(F.col("text")).alias("message_template"))


def _texts(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("id"), "text")
    pages = views.table(spark, sf, "pages").select(F.concat(F.lit("page"), "page_id").alias("id"), F.col("url").alias("text"))
    logs = views.logs(spark, sf).select(F.concat(F.lit("log"), "log_id").alias("id"), F.col("message").alias("text"))
    return docs.unionByName(pages).unionByName(logs)


@query(
    "template_mask",
    f"""WITH {q.LOGS}, texts AS (
          SELECT 'doc' || doc_id AS id, text FROM documents
          UNION ALL SELECT 'page' || page_id, url FROM pages
          UNION ALL SELECT 'log' || log_id, message FROM logs),
        masked AS (SELECT id, {q.mask('text')} AS masked FROM texts),
        split AS (SELECT id, masked, CASE WHEN masked = '' THEN ['<*>'] ELSE string_split(masked, ' ') END AS toks
                  FROM masked)
        SELECT id, md5(masked) AS masked_md5, len(toks) AS n_tokens,
               coalesce(list_filter(toks, lambda t: t <> '<*>')[1], '<no-prefix>') AS prefix FROM split""",
)
def template_mask(spark, sf):
    rows = _texts(spark, sf).withColumn("masked", tx.masked(F.col("text")))
    toks = rows.withColumn("toks", tx.tokens(F.col("masked")))
    return toks.select(
        "id", F.md5("masked").alias("masked_md5"), F.size("toks").alias("n_tokens"),
        tx.prefix_token(F.col("toks")).alias("prefix"),
    )


@query("fingerprint", f"WITH {q.FINGERPRINTED} SELECT log_id, message_template, fingerprint FROM fp")
def fingerprint(spark, sf):
    rows = en.enrich_with_fingerprint(views.logs(spark, sf))
    return rows.select("log_id", "message_template", "fingerprint")


@query(
    "fingerprint_v0",
    f"""WITH {q.ENRICHED}, n AS (SELECT log_id, service, category, {q.legacy('message')} AS normalized FROM enriched)
        SELECT log_id, normalized, substr(sha256(service || '|' || category || '|' || normalized), 1, 16)
               AS fingerprint FROM n""",
)
def fingerprint_v0(spark, sf):
    rows = en.enrich(views.logs(spark, sf)).withColumn("normalized", tx.legacy_message(F.col("message")))
    fp = tx.legacy_fingerprint(F.col("normalized"), F.col("service"), F.col("category"))
    return rows.select("log_id", "normalized", fp.alias("fingerprint"))


@query(
    "parse_timestamps",
    f"""WITH {q.LOGS}, variants AS (SELECT log_id, unnest([
          strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ'), strftime(timestamp, '%Y-%m-%d %H:%M:%S'),
          strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00'), 'not a time']) AS raw FROM logs)
        SELECT log_id, raw, strftime(try_cast(replace(replace(raw, 'Z', ''), '+00:00', '') AS TIMESTAMP),
               '%Y-%m-%d %H:%M:%S') AS parsed FROM variants""",
)
def parse_timestamps(spark, sf):
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    plain = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    raw = F.array(F.concat(iso, F.lit("Z")), plain, F.concat(iso, F.lit("+00:00")), F.lit("not a time"))
    rows = views.logs(spark, sf).select("log_id", F.explode(raw).alias("raw"))
    return rows.select("log_id", "raw", ts_text(parse_timestamp(F.col("raw")), "parsed"))


_MINUTE_ISO = "strftime(date_trunc('minute', timestamp), '%Y-%m-%dT%H:%M:%S+00:00')"
_DIMS = "service || '|' || environment || '|' || category || '|' || severity || '|' || fingerprint"


@query(
    "signal_ids",
    f"""WITH {q.FINGERPRINTED} SELECT log_id, 'sig_' || sha1({_MINUTE_ISO} || '|' || {_DIMS}) AS signal_id,
        'anom_' || sha1('volume_spike|' || {_MINUTE_ISO} || '|' || {_DIMS}) AS anomaly_id FROM fp""",
)
def signal_ids(spark, sf):
    rows = en.with_dimensions(en.enrich_with_fingerprint(views.logs(spark, sf)))
    minute = F.date_trunc("minute", "timestamp")
    dims = [F.col(c) for c in sg.SIGNAL_DIMS]
    return rows.select(
        "log_id", signal_id(minute, *dims).alias("signal_id"),
        anomaly_id(F.lit("volume_spike"), minute, *dims).alias("anomaly_id"),
    )


@query(
    "evidence_logs",
    f"""WITH {q.ENRICHED} SELECT service, count(*) AS rows FROM enriched
        WHERE severity IN ('warning', 'error', 'critical')
           OR lower(level) IN ('warn', 'warning', 'error', 'err', 'critical', 'fatal') OR status_code >= 500
        GROUP BY service""",
)
def evidence_logs(spark, sf):
    rows = en.enrich(views.logs(spark, sf))
    hit = en.is_evidence(F.col("severity"), F.col("level"), F.col("status_code"))
    return rows.where(hit).groupBy("service").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "calendar_parts",
    f"""WITH {q.LOGS} SELECT hour(timestamp) AS hour_of_day, (isodow(timestamp) - 1) AS day_of_week,
        count(*) AS rows FROM logs GROUP BY ALL""",
)
def calendar_parts(spark, sf):
    return (
        views.logs(spark, sf)
        .groupBy(F.hour("timestamp").alias("hour_of_day"), F.weekday("timestamp").alias("day_of_week"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "fingerprint_catalog",
    f"""WITH {q.FINGERPRINTED} SELECT fingerprint, arg_min(service, (fp.timestamp, log_id)) AS service,
        arg_min(category, (fp.timestamp, log_id)) AS category, min(message_template) AS message_template,
        arg_min(message, (fp.timestamp, log_id)) AS example_message, {q.ts('min(fp.timestamp)', 'first_seen')},
        {q.ts('max(fp.timestamp)', 'last_seen')}, count(*) AS occurrence_count FROM fp GROUP BY fingerprint""",
)
def fingerprint_catalog(spark, sf):
    rows = sg.observations(en.enrich_with_fingerprint(views.logs(spark, sf)))
    return sg.roll_up_observations(rows).select(
        "fingerprint", "service", "category", "message_template", "example_message",
        ts_text("first_seen"), ts_text("last_seen"), "occurrence_count",
    )


_SPLIT = "2024-01-16 00:00:00"


@query(
    "catalog_merge",
    f"""WITH {q.FINGERPRINTED}, late AS (SELECT DISTINCT fingerprint FROM fp WHERE fp.timestamp >= TIMESTAMP '{_SPLIT}')
        SELECT fingerprint, arg_min(message, (fp.timestamp, log_id)) AS example_message,
        {q.ts('min(fp.timestamp)', 'first_seen')}, {q.ts('max(fp.timestamp)', 'last_seen')},
        count(*) AS occurrence_count,
        CASE WHEN min(fp.timestamp) < TIMESTAMP '{_SPLIT}' THEN '{_SPLIT}' ELSE '2024-02-01 00:00:00' END AS created_at
        FROM fp SEMI JOIN late USING (fingerprint) GROUP BY fingerprint""",
)
def catalog_merge(spark, sf):
    rows = sg.observations(en.enrich_with_fingerprint(views.logs(spark, sf)))
    cut = ref_column(_SPLIT)
    first = sg.roll_up_observations(rows.where(F.col("observed_at") < cut))
    stored = first.withColumn("created_at", cut)
    batch = sg.roll_up_observations(rows.where(F.col("observed_at") >= cut))
    merged = sg.merge_catalog(stored, batch, ref_column("2024-02-01 00:00:00"))
    return merged.select(
        "fingerprint", "example_message", ts_text("first_seen"), ts_text("last_seen"), "occurrence_count",
        ts_text("created_at"),
    )


@query(
    "fingerprint_cards",
    f"""WITH {q.FINGERPRINTED}, wanted AS (SELECT DISTINCT fingerprint FROM fp WHERE severity = 'critical')
        SELECT fingerprint, arg_max(message, log_id) AS message, max(log_id) AS version
        FROM fp SEMI JOIN wanted USING (fingerprint) GROUP BY fingerprint""",
)
def fingerprint_cards(spark, sf):
    rows = en.enrich_with_fingerprint(views.logs(spark, sf))
    catalog = rows.select("fingerprint", "message", F.col("log_id").alias("version"))
    return sg.fingerprint_cards(catalog, rows.where("severity = 'critical'"))


@query(
    "bounded_minutes",
    f"""WITH {q.LOGS}, c AS (SELECT date_trunc('minute', timestamp) AS m, count(*) AS rows FROM logs GROUP BY ALL)
        SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS minute_bucket, rows FROM c
        WHERE m < (SELECT coalesce(min(m), TIMESTAMP '9999-01-01') FROM c WHERE rows > 3)""",
)
def bounded_minutes(spark, sf):
    kept = sg.bounded_minutes(views.logs(spark, sf), max_rows=3)
    return kept.select(ts_text("minute_bucket"), "rows")


@query(
    "evidence_json",
    f"""WITH {q.ENRICHED} SELECT log_id, '{{{{"service":"' || service || '","status_code":' || status_code
        || ',"minute":"' || {_MINUTE_ISO} || '"}}}}' AS evidence FROM enriched""".replace("{{", "{").replace("}}", "}"),
)
def evidence_json(spark, sf):
    payload = F.to_json(
        F.struct("service", "status_code", iso_utc(F.date_trunc("minute", "timestamp")).alias("minute"))
    )
    return views.logs(spark, sf).select("log_id", payload.alias("evidence"))
