"""Exact values of the text, severity and similarity expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import enrich as en
from lumenlog.functions import text as tx
from lumenlog.functions.ids import parse_timestamp
from lumenlog.operators import incidents as inc
from lumenlog.operators import similar as sim


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_message_template(make):
    rows = [
        ("Read failed at 0xDEADBEEF from 10.0.0.7 after 3 retries", "read failed at <hex> from <ip> after <num> retries"),
        ("Query timeout for shard 42", "query timeout for shard <num>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 gone", "id <uuid> gone"),
        ("id 123e4567-e89b-72d3-a456-426614174000 gone", "id <num>e4567-e89b-<num>d3-a456-<num> gone"),
        ("  A\t\n B  ", "a b"),
        ("é12 12é x9 9", "é12 <num>é x9 <num>"),
        (None, ""),
        ("   ", ""),
    ]
    df = make([(m,) for m, _ in rows], "m string")
    assert [r[0] for r in values(df, tx.message_template(F.col("m")))] == [t for _, t in rows]


def test_texts_stay_whole_without_a_length(make):
    long = "ab " * 600
    df = make([(long + "x",), (long + "y",)], "m string")
    for normal in (tx.message_template, tx.legacy_message):
        text = normal(F.col("m"))
        assert [r[0] for r in values(df, text)] == [long + "x", long + "y"]
        prints = values(df, tx.fingerprint(text, F.lit("s"), F.lit("c")))
        assert prints[0][0] != prints[1][0]
        assert {r[0] for r in values(df, normal(F.col("m"), 120))} == {long[:120]}


def test_fingerprint(make):
    df = make([(" API ", None, "boom")], "s string, c string, t string")
    want = hashlib.sha1(b"api|unknown|boom").hexdigest()
    assert values(df, tx.fingerprint(F.col("t"), F.col("s"), F.col("c")))[0][0] == want


def test_legacy_message(make):
    df = make([("Connection to 10.0.0.1:5432 refused after 3 retries 'abc'",)], "m string")
    assert values(df, tx.legacy_message(F.col("m"))) == [("connection to <ip> refused after <n> retries <str>",)]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("took 100ms", "took <*>"), ("retry after 30s", "retry after <*>"), ("allocated 500MB", "allocated <*>"),
        ("disk 75% full", "disk <*> full"), ("latency 250us", "latency <*>"), ("id=12345x", "id=12345x"),
        ("conn 10.0.0.1:80 \"x y\" 0xff 1.5", "conn <*> <*> <*> <*>"),
    ],
)
def test_mask(make, raw, want):
    assert values(make([(raw,)], "m string"), tx.masked(F.col("m"))) == [(want,)]


def test_tokens(make):
    df = make([("",), ("<*> a b",)], "m string").withColumn("t", tx.tokens(F.col("m")))
    assert values(df, "t", tx.prefix_token(F.col("t"))) == [(["<*>"], "<no-prefix>"), (["<*>", "a", "b"], "a")]


def test_severity(make):
    rows = [("WARN", None), (None, 503), ("info", 404), ("fatal", 200), ("error", 404), (" Err ", None), ("x", None)]
    df = make(rows, "level string, code int")
    got = values(df, en.normalize_severity(F.col("level"), F.col("code")))
    assert [g[0] for g in got] == ["warning", "critical", "error", "critical", "error", "error", "info"]


def test_category(make):
    rows = [
        ("web", "shop", "prod", "Query timeout for shard 42", None, "database", "keyword:query"),
        ("web", "shop", "prod", "build done", None, "frontend", "keyword:ui"),
        ("web", "shop", "prod", "hello", '{"component": " Backend-v2 "}', "backend", "from_metadata:component"),
        ("web", "shop", "prod", "dns", '{"layer": "other"}', "network", "keyword:dns"),
        ("web", "shop", "prod", "hello", "{bad", "unknown", "default:unknown"),
    ]
    df = make([r[:5] for r in rows], "service string, product string, environment string, message string, metadata string")
    got = values(en.with_category(df), "category", "category_reason")
    assert got == [r[5:] for r in rows]


def test_origin(make):
    df = make([("p", "s", "e"), ("", "s", None), ("", "", "e"), (None, None, None)], "p string, s string, e string")
    got = values(df, en.origin(F.col("p"), F.col("s"), F.col("e")))
    assert [g[0] for g in got] == ["p/s@e", "s", "e", ""]


def test_parse_timestamp(make):
    df = make([("2024-01-01T10:00:00Z",), ("2024-01-01 10:00:00",), ("2024-01-01T12:00:00+02:00",), ("no",)], "t string")
    got = values(df, F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm"))
    assert [g[0] for g in got] == ["2024-01-01 10:00"] * 3 + [None]


def test_similarity_parts(make):
    df = make([("aaaa", "aaab", "critical", "debug")], "a string, b string, s string, t string")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        sim.prefix_score(a, b), sim.severity_closeness(F.col("s"), F.col("t")), sim.severity_closeness(F.col("s"), F.col("s")),
        sim.exact(a, F.upper(a)), sim.severity_closeness(F.lit("odd"), F.col("s")), sim.prefix_score(a, F.lit(None)),
    ).first()
    assert list(row) == [3 / 16, 0.0, 1.0, 1.0, 0.0, 0.0]


def test_title_tokens(make):
    df = make([("Api:db error ANOMALY at x-1 Ошибка api",)], "t string")
    assert values(df, sim.title_tokens(F.col("t"))) == [(["api", "x-1", "ошибка"],)]


def test_impact(make):
    df = make([(3, "error", "prod"), (0, None, "qa"), (2, "CRITICAL", None)], "n int, s string, e string")
    got = values(df, inc.impact_score(F.col("n"), F.col("s"), F.col("e")))
    assert [round(g[0], 6) for g in got] == [2.1, 0.04, 0.8]


def test_patch_context_keeps_unknown_fields(make):
    df = make([('{"a": 1, "b": {"c": [1, 2]}}', "x"), ("bad", "y")], "c string, n string")
    patched = inc.patch_context(F.col("c"), F.struct(F.col("n").alias("a")))
    got = values(df, F.get_json_object(patched, "$.a"), F.get_json_object(patched, "$.b.c[1]"))
    assert got == [("x", "2"), ("y", None)]
