"""Run registered queries on Spark and in DuckDB and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), sorted(columns)


def compare(df, con, sql):
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def main(sf_dir, names):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from lumenlog.session import get_session

    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false",
                                              "spark.driver.memory": "8g",
                                              "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = names or list(queries)
    failed = []
    for name in names:
        con = connect(sf_dir)
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                out = compare(df, con, oracles[name])
                n = ""
            else:
                out, n = None, f" rows={df.count()} (no SQL)"
        except Exception as exc:  # report and go on
            out, n = f"{type(exc).__name__}: {str(exc)[:700]}", ""
        print(f"{'FAIL' if out else 'ok  '} {name} {time.time() - t0:.1f}s{n} {out or ''}", flush=True)
        if out:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
