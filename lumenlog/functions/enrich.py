"""Category, severity, origin and tags of a log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.ids import fixed_map
from lumenlog.functions.text import fingerprint, message_template, safe_lower

# Categories, their keywords in order of precedence, and the level mapping.
CATEGORIES = [
    "backend", "frontend", "database", "network", "infrastructure", "os_system", "unknown",
]
METADATA_KEYS = ["category", "layer", "component"]
CATEGORY_KEYWORDS = {
    "database": [
        "db", "database", "postgres", "mysql", "clickhouse", "mongo", "redis", "sql", "query",
        "replica", "transaction",
    ],
    "network": [
        "timeout", "connection refused", "network", "dns", "socket", "unreachable", "handshake",
    ],
    "infrastructure": [
        "k8s", "kubernetes", "helm", "pod", "node", "ingress", "nginx", "docker", "container",
        "terraform", "ansible", "load balancer",
    ],
    "os_system": [
        "kernel", "systemd", "dmesg", "filesystem", "disk", "memory", "cpu", "oom", "swap",
    ],
    "frontend": [
        "frontend", "browser", "ui", "react", "vite", "jsx", "webpack", "css", "javascript",
    ],
    "backend": [
        "backend", "api", "server", "handler", "controller", "service", "worker", "celery",
        "fastapi",
    ],
}
LEVELS = {
    "trace": "debug",
    "debug": "debug",
    "info": "info",
    "notice": "info",
    "warn": "warning",
    "warning": "warning",
    "error": "error",
    "err": "error",
    "fatal": "critical",
    "critical": "critical",
}
SEVERITIES = ["debug", "info", "warning", "error", "critical"]
ERROR_SEVERITIES = ["error", "critical"]
EVIDENCE_SEVERITIES = ["warning", "error", "critical"]
EVIDENCE_LEVELS = ["warn", "warning", "error", "err", "critical", "fatal"]


def _first_keyword(haystack: Column) -> Column:
    chain = None
    for words in CATEGORY_KEYWORDS.values():
        for word in words:
            hit = F.contains(haystack, F.lit(word))
            chain = F.when(hit, word) if chain is None else chain.when(hit, word)
    return chain


def _metadata_category(value: Column) -> Column:
    chain = None
    for name in CATEGORIES:
        hit = value.startswith(name)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def with_category(logs: DataFrame) -> DataFrame:
    """Add ``category`` and ``category_reason``.

    Metadata wins; otherwise the first keyword found anywhere in service, product,
    environment and message decides. Each stage is one projection, so the haystack and the
    parsed metadata are evaluated once per row.
    """
    meta = F.from_json("metadata", ", ".join(f"{k} STRING" for k in METADATA_KEYS))
    parsed = logs.withColumns(
        {
            "_meta": meta,
            "_hay": F.concat_ws(
                " ", *[safe_lower(F.col(c)) for c in ("service", "product", "environment", "message")]
            ),
        }
    )
    named = parsed.withColumns(
        {f"_m_{k}": _metadata_category(safe_lower(F.col(f"_meta.{k}"))) for k in METADATA_KEYS}
    )
    meta_hit = F.coalesce(*[F.col(f"_m_{k}") for k in METADATA_KEYS])
    meta_key = F.coalesce(*[F.when(F.col(f"_m_{k}").isNotNull(), k) for k in METADATA_KEYS])
    keyed = named.withColumns(
        {
            "_meta_category": meta_hit,
            "_meta_key": meta_key,
            "_word": F.when(meta_hit.isNull(), _first_keyword(F.col("_hay"))),
        }
    )
    owner = {w: name for name, words in CATEGORY_KEYWORDS.items() for w in words}
    out = keyed.withColumns(
        {
            "category": F.coalesce("_meta_category", fixed_map(owner)[F.col("_word")], F.lit("unknown")),
            "category_reason": F.coalesce(
                F.concat(F.lit("from_metadata:"), F.col("_meta_key")),
                F.concat(F.lit("keyword:"), F.col("_word")),
                F.lit("default:unknown"),
            ),
        }
    )
    return out.drop(
        "_meta", "_hay", "_meta_category", "_meta_key", "_word", *[f"_m_{k}" for k in METADATA_KEYS]
    )


def normalize_severity(level: Column, status_code: Column) -> Column:
    mapped = fixed_map(LEVELS)[safe_lower(level)]
    raised = (status_code >= 400) & (
        mapped.isNull() | mapped.isin("info", "debug", "warning")
    )
    return (
        F.when(status_code >= 500, "critical")
        .when(raised, "error")
        .otherwise(F.coalesce(mapped, F.lit("info")))
    )


def origin(product: Column, service: Column, environment: Column) -> Column:
    left = F.concat_ws("/", F.nullif(product, F.lit("")), F.nullif(service, F.lit("")))
    env = F.coalesce(environment, F.lit(""))
    return (
        F.when((left != "") & (env != ""), F.concat(left, F.lit("@"), env))
        .when(left != "", left)
        .otherwise(env)
    )


def enrich(logs: DataFrame) -> DataFrame:
    """Add category, category_reason, severity, origin and tags."""
    return (
        with_category(logs)
        .withColumns(
            {
                "severity": normalize_severity(F.col("level"), F.col("status_code")),
                "origin": origin(F.col("product"), F.col("service"), F.col("environment")),
            }
        )
        .withColumn("tags", F.array("category", "severity"))
    )


def enrich_with_fingerprint(logs: DataFrame) -> DataFrame:
    """:func:`enrich` plus ``message_template`` and ``fingerprint``."""
    return (
        enrich(logs)
        .withColumn("message_template", message_template(F.col("message")))
        .withColumn(
            "fingerprint",
            fingerprint(F.col("message_template"), F.col("service"), F.col("category")),
        )
    )


def with_dimensions(enriched: DataFrame) -> DataFrame:
    """Blank service, environment, category and severity get their default names."""
    default = {"service": "unknown", "environment": "unknown", "category": "unknown", "severity": "info"}
    return enriched.withColumns(
        {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in default.items()}
    )


def is_error(severity: Column) -> Column:
    return severity.isin(*ERROR_SEVERITIES)


def is_evidence(severity: Column, level: Column, status_code: Column) -> Column:
    return (
        F.coalesce(F.lower(severity).isin(*EVIDENCE_SEVERITIES), F.lit(False))
        | F.coalesce(F.lower(level).isin(*EVIDENCE_LEVELS), F.lit(False))
        | F.coalesce(status_code >= 500, F.lit(False))
    )
