"""SQL building blocks for the result check, written independently of the DataFrame code."""

from __future__ import annotations

from lumenlog.functions import enrich as e
from lumenlog.plans import views


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lower_strip(x: str) -> str:
    return strip(f"lower(coalesce({x}, ''))")


def _regex(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', '{replacement}', 'g')"
    return x


UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
ANY_UUID = r"\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b"
WORD = r"\p{L}\p{N}_"


def template(x: str) -> str:
    rules = [
        (UUID, "<uuid>"),
        (r"\b0x[0-9a-f]+\b", "<hex>"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
        (rf"(^|[^{WORD}])\d+", r"\1<num>"),
        (r"\s+", " "),
    ]
    return _regex(lower_strip(x), rules)


def legacy(x: str) -> str:
    rules = [
        (ANY_UUID, "<uuid>"),
        (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b", "<ip>"),
        ("'[^']*'|\"[^\"]*\"", "<str>"),
        (rf"(^|[^{WORD}])\d+($|[^{WORD}])", r"\1<n>\2"),
        (rf"(^|[^{WORD}])\d+($|[^{WORD}])", r"\1<n>\2"),
        (r"\s+", " "),
    ]
    return strip(_regex(f"lower({x})", rules))


def mask(x: str) -> str:
    """Units and numbers are replaced twice: a match eats the border of its neighbour."""
    unit = (
        r"(?:ms|us|ns|μs|kib|mib|gib|tib|kb|mb|gb|tb|bps|rps|qps|tps|eps|[smhd]|%)"
    )
    with_unit = (rf"(^|[^{WORD}])\d+(?:\.\d+)?{unit}($|[^{WORD}])", r"\1<*>\2")
    bare = (rf"(^|[^{WORD}])\d+(?:\.\d+)?($|[^{WORD}])", r"\1<*>\2")
    rules = [
        (ANY_UUID, "<*>"),
        (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b", "<*>"),
        (r"\b0x[0-9a-f]+\b", "<*>"),
        ("'[^']*'|\"[^\"]*\"", "<*>"),
        with_unit, with_unit, bare, bare,
        (r"\s+", " "),
    ]
    return strip(_regex(lower_strip(x), rules))


def _category(hay: str, as_reason: bool) -> str:
    whens = [
        f"WHEN contains({hay}, '{w}') THEN '{'keyword:' + w if as_reason else name}'"
        for name, words in e.CATEGORY_KEYWORDS.items()
        for w in words
    ]
    last = "default:unknown" if as_reason else "unknown"
    return f"CASE {' '.join(whens)} ELSE '{last}' END"


def _meta(key: str) -> str:
    return f"CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{key}') END"


def _meta_category(key: str) -> str:
    value = lower_strip(f"m_{key}")
    whens = " ".join(f"WHEN starts_with({value}, '{c}') THEN '{c}'" for c in e.CATEGORIES)
    return f"CASE {whens} END"


def _level(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in e.LEVELS.items())
    return f"CASE {lower_strip(x)} {whens} END"


LOGS = f"logs AS ({views.sql_logs()})"
INCIDENTS = f"incidents AS (SELECT *, epoch_us(updated_at) AS version FROM ({views.sql_incidents()}) z)"

_HAY = "concat_ws(' ', " + ", ".join(
    lower_strip(c) for c in ("service", "product", "environment", "message")
) + ")"

ENRICHED = f"""{LOGS},
hays AS (SELECT *, {_HAY} AS hay, {_meta('category')} AS m_category, {_meta('layer')} AS m_layer,
                {_meta('component')} AS m_component, {_level('level')} AS mapped FROM logs),
named AS (SELECT *, {_meta_category('category')} AS c1, {_meta_category('layer')} AS c2,
                 {_meta_category('component')} AS c3 FROM hays),
enriched AS (SELECT * EXCLUDE (hay, m_category, m_layer, m_component, mapped, c1, c2, c3),
  coalesce(c1, c2, c3, {_category('hay', False)}) AS category,
  CASE WHEN c1 IS NOT NULL THEN 'from_metadata:category' WHEN c2 IS NOT NULL THEN 'from_metadata:layer'
       WHEN c3 IS NOT NULL THEN 'from_metadata:component' ELSE {_category('hay', True)} END AS category_reason,
  CASE WHEN status_code >= 500 THEN 'critical'
       WHEN status_code >= 400 AND (mapped IS NULL OR mapped IN ('info', 'debug', 'warning')) THEN 'error'
       ELSE coalesce(mapped, 'info') END AS severity,
  concat(product, '/', service, '@', environment) AS origin
  FROM named)"""

FINGERPRINTED = f"""{ENRICHED},
templated AS (SELECT *, {template('message')} AS message_template FROM enriched),
fp AS (SELECT *, sha1(concat_ws('|', {lower_strip('service')}, {lower_strip('category')}, message_template))
              AS fingerprint FROM templated)"""


def ts(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name or x}"


def signals(bucket: str) -> str:
    return f"""{FINGERPRINTED},
signals AS (SELECT service, environment, category, severity, fingerprint,
                   date_trunc('{bucket}', timestamp) AS minute_bucket, count(*) AS count
            FROM fp GROUP BY ALL)"""
