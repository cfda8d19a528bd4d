"""Streaming operators on small replayed tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftlake import session
from driftlake.functions.nodes import TRAFFIC_KEYS, traffic_nodes
from driftlake.operators import diff as D
from driftlake.operators import infer as I
from driftlake.operators import metrics as M
from driftlake.operators import stats as S
from driftlake.schemas import TABLES
from driftlake.sources.tables import check_words, read_table
from driftlake.streaming import alerts, inference
from driftlake.streaming import dedup as SD
from driftlake.streaming.replay import as_stream, plain_times, run_to_table

T0 = datetime(2024, 1, 1)


def test_sustained_alerts(spark):
    hits = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    rows = [("a", T0 + timedelta(minutes=m), bool(h)) for m, h in enumerate(hits)]
    rows += [("b", T0 + timedelta(minutes=m), True) for m in range(9)]
    series = spark.createDataFrame(rows, "k string, t timestamp_ntz, hit boolean")
    raised = run_to_table(alerts.sustained_stream(as_stream(series, "t", 3), ["k"], "t", "hit", 120), "held")
    got = {(r["k"], r["started_at"], r["raised_at"]) for r in plain_times(raised).collect()}
    minute = lambda m: T0 + timedelta(minutes=m)
    assert got == {("a", minute(3), minute(5)), ("b", minute(0), minute(2))}


def test_throttle_equals_batch(spark):
    rows = [(n, "s", T0 + timedelta(minutes=25 * (n // 2)), ("P1", "P2")[n % 2]) for n in range(40)]
    table = spark.createDataFrame(rows, "id long, service_id string, at timestamp_ntz, alert_severity string")
    routes = M.route_table(spark)
    batch = {r["id"] for r in M.throttle_alerts(table, routes, ["service_id"], "at", "id").collect()}
    routed = M.route_alerts(table, routes)
    stream = alerts.throttle_stream(as_stream(routed, "at"), ["service_id"], "at", "id")
    assert {r["id"] for r in run_to_table(stream, "throttled").collect()} == batch


def test_windowed_contracts(spark, tmp_path):
    rows = [("s", "e", "GET", '{"a":%d}' % i, T0 + timedelta(minutes=i)) for i in range(60)]
    table = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string, sampled_at timestamp_ntz")
    out = str(tmp_path / "out")
    inference.infer_windows(as_stream(table, "sampled_at"), out, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["window_start"].minute: (r["path"], r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got == {m: ("a", 10, 10) for m in (0, 10, 20, 30)}


def test_drift_and_rejects(spark, tmp_path):
    rows = [("s", "e", "GET", b, T0 + timedelta(minutes=i)) for i, b in enumerate(['{"a":1}', "{bad", '{"a":"x"}', "[1]"])]
    table = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string, sampled_at timestamp_ntz")
    baseline = I.schema_nodes(S.path_stats(traffic_nodes(table.limit(1))))
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    job = inference.detect_drift(as_stream(table, "sampled_at", 2), baseline, out, bad, str(tmp_path / "c"), trigger={"availableNow": True})
    job.awaitTermination()
    assert [r["severity"] for r in spark.read.parquet(out).collect()] == ["BREAKING"]
    assert sorted(r["body"] for r in spark.read.parquet(bad).collect()) == ["[1]", "{bad"]


def test_suggested_enums_take_part_in_the_diff(spark):
    def nodes(values):
        rows = [("s", "e", "GET", '{"c":"%s"}' % v) for v in values * 60]
        df = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string")
        return I.schema_nodes(S.path_stats(traffic_nodes(df), values=True))

    old, new = nodes(["x", "y"]), nodes(["x", "z"])
    assert D.schema_diff(old, new, TRAFFIC_KEYS).count() == 0
    found = D.schema_diff(I.use_suggested_enums(old), I.use_suggested_enums(new), TRAFFIC_KEYS).collect()
    assert [r["description"] for r in found] == ["Enum values removed: c"]


def test_stub_document(spark):
    df = spark.createDataFrame([("s", "e", "GET", "{bad")], "service_id string, endpoint string, method string, body string")
    found = I.schema_nodes(S.path_stats(traffic_nodes(df)))
    rows = I.schema_documents(found, expected=df).collect()
    assert len(rows) == 1 and '"type": "object"' in rows[0]["schema_json"] and "properties" not in rows[0]["schema_json"]


def test_table_checks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "manual", "active"), ("b", "guess", "active"), ("c", "inferred", "gone")], "id string, source string, status string")
    good, bad = check_words(rows, "contracts")
    assert [r["id"] for r in good.collect()] == ["a"] and sorted(r["id"] for r in bad.collect()) == ["b", "c"]
    path = str(tmp_path / "contracts")
    rows.write.json(path)
    assert read_table(spark, "contracts", path, "json").columns == TABLES["contracts"].names


def test_batch_of_empty_objects_is_drift(spark, tmp_path):
    rows = [("s", "e", "GET", b, T0 + timedelta(minutes=i)) for i, b in enumerate(['{"a":1}', '{"a":2}', "{}", "{}"])]
    table = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string, sampled_at timestamp_ntz")
    baseline = I.schema_nodes(S.path_stats(traffic_nodes(table.limit(1))), with_root=True)
    out = str(tmp_path / "out")
    job = inference.detect_drift(as_stream(table, "sampled_at", 2), baseline, out, str(tmp_path / "bad"), str(tmp_path / "c"), trigger={"availableNow": True})
    job.awaitTermination()
    assert [(r["path"], r["severity"]) for r in spark.read.parquet(out).collect()] == [("a", "BREAKING")]


def test_proto_drift_of_empty_objects(spark, monkeypatch):
    from driftlake.plans import proto

    rows = [("s", "e", "GET", "{}"), ("t", "e", "GET", "[1]")]
    table = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string")
    monkeypatch.setattr(proto, "samples", lambda *_: table)
    monkeypatch.setattr(proto, "nodes", lambda *_, **options: traffic_nodes(table, **options))
    found = proto.proto_drift(spark, "").collect()
    assert {r["service_id"] for r in found} == {"s"} and len(found) == 11
    monkeypatch.setattr(proto, "TRAFFIC_PROTO", "message Order { }")
    monkeypatch.setattr(proto, "nodes", lambda *_, **options: traffic_nodes(table.withColumn("body", F.lit('{"n":1}')), **options))
    assert {(r["path"], r["severity"]) for r in proto.proto_drift(spark, "").collect()} == {("n", "BREAKING")}


def test_dedup_calls_the_state_once_for_many_keys(spark, monkeypatch):
    rows = [(i, T0 + timedelta(seconds=7 * i), f"k{i % 3}" if i % 2 else f"own{i}" if i % 4 else None) for i in range(1200)]
    table = spark.createDataFrame(rows, "sample_id bigint, sampled_at timestamp_ntz, content_hash string")
    stream = SD.dedup_stream(as_stream(table, "sampled_at", 3), buckets=4)
    assert "dedup_bucket" in stream._jdf.queryExecution().analyzed().toString()
    got = plain_times(run_to_table(stream, "many")).collect()
    free, want = {}, set()
    for i, t, k in rows:
        if t >= free.get(k, t):
            want.add(i)
            free[k] = t + timedelta(seconds=300)
    assert sorted(r.sample_id for r in got) == sorted(want) and got[0].asDict().keys() == set(table.columns)


def test_a_drift_batch_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    rows = [("s", "e", "GET", '{"a":1}' if i % 50 else "[1]", T0 + timedelta(minutes=i)) for i in range(400)]
    table = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string, sampled_at timestamp_ntz")
    tasks = []

    def deal(batch):
        out = session.spread(batch, 10)
        tasks.append((batch.count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(inference, "spread", deal)
    baseline = I.schema_nodes(S.path_stats(traffic_nodes(table.filter("body = '{\"a\":1}'").withColumn("body", F.lit('{"a":"x"}')).limit(1))))
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    inference.detect_drift(as_stream(table, "sampled_at", 2), baseline, out, bad, str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
    assert sum(n for n, _ in tasks) == 400 and all(k >= n / 10 for n, k in tasks)
    assert [r["severity"] for r in spark.read.parquet(out).collect()] == ["BREAKING"] * len([n for n, _ in tasks if n])
    assert spark.read.parquet(bad).count() == 8
