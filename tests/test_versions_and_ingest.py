"""Versioned tables, the ingestion stream, live rates and sketches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftlake.operators import metrics as M
from driftlake.sources.snapshots import Conflict, SnapshotTable
from driftlake.streaming import ingest as G

T0 = datetime(2024, 1, 1)


def test_two_writers_from_one_version(spark, tmp_path):
    table, other = (SnapshotTable(spark, str(tmp_path / "t")) for _ in range(2))
    with pytest.raises(LookupError):
        table.read()
    assert table.commit(spark.range(3), 0) == 1
    whole = other.read()
    assert other.commit(spark.range(5), 1) == 2
    with pytest.raises(Conflict):
        table.commit(spark.range(9), 1)
    # a reader that began before the commit still sees its version; others see the new one
    assert whole.count() == 3 and table.read().count() == 5 and table.read(1).count() == 3
    assert table.commit(spark.range(1), 2, append=True) == 3 and table.read().count() == 6


def test_the_manifest_is_never_replaced(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.commit(spark.range(3), 0)
    with pytest.raises(Conflict):
        table._place({"folders": [], "schema": "id bigint"}, 1)
    assert table.read().count() == 3 and table.versions() == [1]


def test_a_change_is_applied_to_what_came_first(spark, tmp_path):
    table, other = (SnapshotTable(spark, str(tmp_path / "t")) for _ in range(2))
    table.commit(spark.range(3), 0)
    calls = []

    def change(rows):
        if not calls:
            other.commit(spark.range(10), 1)
        calls.append(rows.count())
        return rows.filter("id % 2 = 0")

    assert table.update(change) == 3 and calls == [3, 10] and table.read().count() == 5


def samples(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, service_id string, endpoint string, method string, body string, sampled_at timestamp")


def test_ingest_after_a_crash_and_a_restart(spark, tmp_path, monkeypatch):
    source, out, rejects, checkpoint = (str(tmp_path / n) for n in ("source", "out", "rejects", "checkpoint"))
    rows = [(i, "s" if i % 4 else None, "/e", "GET", '{"a":%d}' % (i % 2), T0 + timedelta(minutes=i)) for i in range(20)]

    def run():
        stream = spark.readStream.schema(samples(spark, []).schema).parquet(source)
        G.ingest(stream, out, rejects, checkpoint, trigger={"availableNow": True}).awaitTermination()

    samples(spark, rows[:10]).coalesce(1).write.mode("append").parquet(source)
    run()
    samples(spark, rows[10:]).coalesce(1).write.mode("append").parquet(source)
    real = G._stored
    monkeypatch.setattr(G, "_stored", lambda *a: real(*a).withColumn("service_id", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(G, "_stored", real)
    run()
    # per body, the first valid sample and then the next at least five minutes later
    want, last = set(), {}
    for i, service, _, _, body, t in rows:
        if service and (body not in last or t - last[body] >= timedelta(minutes=5)):
            want.add(i)
            last[body] = t
    stored = spark.read.parquet(out)
    assert sorted(r.sample_id for r in stored.collect()) == sorted(want)
    assert sorted(r.sample_id for r in spark.read.parquet(rejects).collect()) == [i for i in range(20) if i % 4 == 0]


def test_sketches_are_within_their_bound_and_merge(spark):
    rows = spark.range(5000).selectExpr("timestamp_seconds(1704067200 + id % 900) AS sampled_at", "'e' AS endpoint", "CAST(pow(id, 2) AS BIGINT) AS duration_ms")
    panes = M.latency_panes(rows)
    got = {r.window_start: r for r in M.sketch_quantiles(panes).collect()}
    parts = M.latency_panes(rows.where("duration_ms % 2 = 0")).unionByName(M.latency_panes(rows.where("duration_ms % 2 = 1")))
    assert {r.window_start: r for r in M.sketch_quantiles(parts).collect()} == got
    values = rows.withColumn("w", F.explode(F.array(F.window("sampled_at", "5 minutes", "1 minute").start))).groupBy("w").agg(F.sort_array(F.collect_list("duration_ms")).alias("v"))
    for r in values.collect():
        for p in (50, 95, 99):
            exact, told = r.v[len(r.v) * p // 100], got[r.w][f"p{p}"]
            assert exact * (1 - 2 ** (1 - M.SKETCH_BITS)) <= told <= exact
    odd = spark.createDataFrame([(T0, "e", None), (T0, None, -5), (T0, None, 2**62)], "sampled_at timestamp, endpoint string, duration_ms long")
    assert [(r.endpoint, r.n, r.p50) for r in M.sketch_quantiles(M.latency_panes(odd), slide="5 minutes").collect()] == [(None, 2, 2**62)]
