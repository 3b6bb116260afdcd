"""Streaming jobs against their batch form, across restarts and late rows."""

from datetime import timedelta

from pyspark.sql import functions as F

from lumenlog.functions.enrich import enrich_with_fingerprint
from lumenlog.operators import drain as dr
from lumenlog.operators import incidents as inc
from lumenlog.operators import signals as sg
from lumenlog.schemas import FINGERPRINT_CATALOG, LOG_SIGNALS
from lumenlog.streaming import jobs

LOG = (
    "timestamp timestamp, product string, service string, environment string, level string, status_code int, "
    "trace_id string, message string, metadata string, log_id bigint"
)


def _rows(first, n, step=20, message="timeout after {}"):
    out = []
    for i in range(first, first + n):
        t = i * step
        out.append((f"2024-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}", "p", f"s{i % 2}", "prod", "error", 200,
                    f"t{i}", message.format(i), None, i))
    return out


def _stream(spark, make, path, rows):
    make(rows, LOG).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _signals(df):
    cols = [*sg.SIGNAL_DIMS, "minute_bucket", "count"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_signals_across_restarts_and_late_rows(spark, make, tmp_path):
    src, base = str(tmp_path / "logs"), str(tmp_path / "out")
    parts = [_rows(0, 30), _rows(30, 30)]
    for part in parts:
        signals = jobs.windowed_signals(_stream(spark, make, src, part))
        jobs.run_available(signals, f"{base}/cp", batch=jobs.signal_sink(base))
    # Far behind the watermark: never counted.
    late = jobs.windowed_signals(_stream(spark, make, src, _rows(0, 5)))
    jobs.run_available(late, f"{base}/cp", batch=jobs.signal_sink(base))
    got = jobs.read_table(spark, base, "log_signals_1m", LOG_SIGNALS)
    batch = sg.signals(enrich_with_fingerprint(make(parts[0] + parts[1], LOG)))
    closed = batch.where(F.col("minute_bucket") + F.expr("INTERVAL 1 MINUTE") <= F.lit("2024-01-01 00:17:40").cast("timestamp"))
    assert _signals(got) == _signals(closed)


def test_repeated_batch_leaves_the_same_rows(spark, make, tmp_path):
    base = str(tmp_path / "out")
    rows = sg.signals(enrich_with_fingerprint(make(_rows(0, 30), LOG)))
    sink = jobs.signal_sink(base)
    sink(rows, 0)
    sink(rows, 0)
    assert _signals(jobs.read_table(spark, base, "log_signals_1m", LOG_SIGNALS)) == _signals(rows)


def test_catalog_grows_over_batches(spark, make, tmp_path):
    base = str(tmp_path / "out")
    sink = jobs.catalog_sink(base, every=2)
    sink(make(_rows(0, 10), LOG), 0)
    sink(make(_rows(10, 10), LOG), 1)
    sink(make(_rows(10, 10), LOG), 1)
    rows = jobs.catalog_state(spark, base)
    assert sorted((r["occurrence_count"], r["example_message"]) for r in rows.collect()) == [(10, "timeout after 0"), (10, "timeout after 1")]


def test_catalog_reads_few_batches(spark, make, tmp_path):
    base = str(tmp_path / "out")
    sink = jobs.catalog_sink(base, every=3)
    for k in range(7):
        sink(make(_rows(k, 1, message=f"kind {'abcdefgh'[k]} of {{}}") + _rows(0, 2), LOG), k)
    want = sorted((r.fingerprint, r.occurrence_count) for r in jobs.catalog_state(spark, base).collect())
    assert sorted(n for _, n in want) == [1] * 7 + [7, 7]
    # the state stands on the gathered table of batch 5 and on batch 6: what was written before isn't read
    none = spark.createDataFrame([], FINGERPRINT_CATALOG).withColumn("bucket", F.lit(0))
    for table, batches in (("fingerprint_catalog", range(6)), ("fingerprint_catalog_base", [2])):
        for k in batches:
            none.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/{table}/batch={k}")
    assert sorted((r.fingerprint, r.occurrence_count) for r in jobs.catalog_state(spark, base).collect()) == want


def test_backlog_comes_in_bounded_batches_from_the_first_start(spark, make, tmp_path):
    src, base = str(tmp_path / "logs"), str(tmp_path / "out")
    logs = make(_rows(0, 200), LOG)  # 4000 seconds
    for k in range(8):
        logs.where(f"log_id div 25 = {k}").coalesce(1).write.mode("append").parquet(src)
    now = logs.agg(F.max("timestamp")).first()[0]

    def run(now):
        start = jobs.first_start(spark, f"{base}/cp", now, timedelta(seconds=2000))
        source = jobs.log_files(spark, src, logs.schema, start=start, max_files=2)
        return start, jobs.run_available(source, f"{base}/cp", batch=jobs.catalog_sink(base))

    start, batches = run(now)
    assert len(batches) == 4  # eight files, two at a time
    total = jobs.catalog_state(spark, base).agg(F.sum("occurrence_count")).first()[0]
    assert total == logs.where(F.col("timestamp") >= F.lit(start)).count() == 101
    make(_rows(200, 10), LOG).coalesce(1).write.mode("append").parquet(src)
    again, batches = run(now + timedelta(days=9))  # a later run keeps the first start
    assert again == start and len(batches) == 1
    assert jobs.catalog_state(spark, base).agg(F.sum("occurrence_count")).first()[0] == 111


CANDIDATE = (
    "fingerprint string, service string, environment string, category string, candidate_id string, "
    "start_time timestamp, end_time timestamp, signal_count bigint, anomaly_score double"
)


def _clock(m):
    return f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"


def test_incident_lifecycle_equals_sessions(spark, make, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    times = [0, 10, 25, 90, 100, 200]
    rows = [("f", "s", "e", "c", f"c{m}", _clock(m), _clock(m), 2, float(m)) for m in times] + [("g", "s", "e", None, "d", _clock(95), _clock(95), 1, 1.0)]
    src, out = str(tmp_path / "c"), str(tmp_path / "o")
    df = make(rows, CANDIDATE)
    for ids in (["c0", "c10"], ["c25", "c90", "c100", "d"], ["c200"]):
        df.where(F.col("candidate_id").isin(ids)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        jobs.run_available(jobs.incident_lifecycle(stream), str(tmp_path / "cp"), path=out)
    snapshots = spark.read.schema(jobs.SESSION_SCHEMA).parquet(out)
    names = ["fingerprint", "session_start", "session_end", "candidates", "signal_count", "max_score"]
    got = {tuple(r) for r in jobs.latest_snapshots(snapshots).select(*names).collect()}
    assert got == {tuple(r) for r in inc.incident_sessions(df).select(*names).collect()}
    first = sorted((r.version, r.candidates, r.status) for r in snapshots.where("fingerprint = 'f'").collect() if r.session_start.hour == 0)
    assert first == [(1, 2, "open"), (2, 3, "closed")]  # seen while open
    states = {(r.fingerprint, r.session_start.hour, r.session_start.minute): r.status for r in jobs.latest_snapshots(snapshots).collect()}
    assert states == {("f", 0, 0): "closed", ("f", 1, 30): "closed", ("f", 3, 20): "open", ("g", 1, 35): "closed"}


def test_incident_lifecycle_follows_requests(spark, make, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    key = ("f", "s", "e", "c")
    parts = [
        ([(*key, "c0", _clock(0), _clock(0), 2, 1.0)], []),
        ([], [(*key, "r1", "acknowledged", _clock(5)), (*key, "r2", "reopened", _clock(6)), (*key, "r3", "resolved", _clock(7))]),
        ([(*key, "c60", _clock(60), _clock(60), 3, 4.0)], []),  # within the time of reopening
        ([(*key, "c70", _clock(70), _clock(70), 1, 2.0)], [(*key, "r4", "resolved", _clock(71))]),
        ([(*key, "c900", _clock(900), _clock(900), 5, 3.0)], []),  # long after
    ]
    requests = "fingerprint string, service string, environment string, category string, request_id string, to_status string, requested_at timestamp"
    src, asked, out = str(tmp_path / "c"), str(tmp_path / "r"), str(tmp_path / "o")
    make([], CANDIDATE).write.parquet(src)
    make([], requests).write.parquet(asked)
    seen = []
    for found, moves in parts:
        make(found, CANDIDATE).coalesce(1).write.mode("append").parquet(src)
        make(moves, requests).coalesce(1).write.mode("append").parquet(asked)
        streams = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (src, asked)]
        jobs.run_available(jobs.incident_lifecycle(*streams, delay="2 days"), str(tmp_path / "cp"), path=out)
        latest = jobs.latest_snapshots(spark.read.schema(jobs.SESSION_SCHEMA).parquet(out))
        seen.append(sorted((r.session_start.hour, r.status, r.candidates, r.signal_count) for r in latest.collect()))
    assert seen == [
        [(0, "open", 1, 2)], [(0, "resolved", 1, 2)], [(0, "reopened", 2, 5)], [(0, "resolved", 3, 6)],
        [(0, "resolved", 3, 6), (15, "open", 1, 5)],
    ]


def test_streaming_templates_equal_batch(spark, make, tmp_path):
    src, out = str(tmp_path / "logs"), str(tmp_path / "out")
    first, second, third = (_rows(0, 40, message="job {} moved x"), _rows(40, 40, message="job done quickly {}"), _rows(80, 40, message="job {} x y"))
    for part in (first, second, third):
        stream = _stream(spark, make, src, part)
        jobs.run_available(stream, str(tmp_path / "cp"), batch=jobs.template_sink(out))
    rows = spark.read.parquet(f"{out}/template_rows")
    got = {r["log_id"]: (r["leaf"], r["ordinal"], r["template_at"]) for r in rows.collect()}
    whole, changes = dr.mined(make(first + second + third, LOG))
    want = {r["log_id"]: (r["leaf"], r["ordinal"], r["template_at"]) for r in whole.collect()}
    assert got == want and rows.count() == len(want)
    last = spark.read.parquet(f"{out}/templates").where("batch = 2").collect()
    assert {(r.leaf, r.ordinal, tuple(r.template)) for r in last} == {
        (r.leaf, r.ordinal, tuple(r.template)) for r in dr.current_templates(changes).collect()
    }
    # a batch that runs again leaves the same rows; a late row meets the templates of its batch
    jobs.template_sink(out)(make(third, LOG), 2)
    again = spark.read.parquet(f"{out}/template_rows")
    assert {r["log_id"]: (r["leaf"], r["ordinal"], r["template_at"]) for r in again.collect()} == want
    jobs.template_sink(out)(make([(*_rows(0, 1, message="job 7 x y")[0][:-1], 999)], LOG), 3)
    late = spark.read.parquet(f"{out}/template_rows").where("log_id = 999").first()
    assert late.template_at in {" ".join(r.template) for r in last}
