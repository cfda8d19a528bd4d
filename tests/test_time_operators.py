"""As-of joins, anchored periods, sampling: against brute force on random data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftlake.operators import metrics as M
from driftlake.operators import sampling as A
from driftlake.operators.anchors import anchor_points
from driftlake.operators.asof import asof_join
from driftlake.operators.correlate import correlate
from driftlake.operators.dedup import dedup, with_hash

T0 = datetime(2024, 1, 1)
SEC = 1_000_000


def brute_anchors(times, period):
    kept = []
    for t in sorted(set(times)):
        if not kept or t >= kept[-1] + period:
            kept.append(t)
    return kept


def test_dedup_golden(spark):
    rows = [(i, "h", T0 + timedelta(seconds=s)) for i, s in enumerate((0, 100, 250, 301, 500, 602))]
    df = spark.createDataFrame(rows, "sample_id long, content_hash string, sampled_at timestamp_ntz")
    assert sorted(r["sample_id"] for r in dedup(df).collect()) == [0, 3, 5]


@pytest.mark.parametrize("seed, fold_limit, leaf_rows", [(1, 10_000, 1000), (2, 50, 20), (3, 0, 5), (4, 0, 1)])
def test_anchors_against_brute_force(spark, seed, fold_limit, leaf_rows):
    rnd = random.Random(seed)
    data = {}
    for key, (n, span) in {"a": (900, 20_000), "b": (300, 500_000), "c": (5, 3000), "d": (400, 2000), "e": (1, 1)}.items():
        start = rnd.randrange(-50_000, 50_000)
        data[key] = {start + rnd.randrange(span) for _ in range(n)}
    data["f"] = set(range(-700, 700, 7))  # never merges
    period = {k: 100 if k != "b" else 370 for k in data}
    rows = [(k, t * SEC, period[k] * SEC) for k, times in data.items() for t in times]
    points = spark.createDataFrame(rows, "k string, t long, period long")
    got = {}
    for r in anchor_points(points, ["k"], fold_limit, leaf_rows).collect():
        got.setdefault(r["k"], []).append(r["t"] // SEC)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_anchors(v, period[k]) for k, v in data.items()}


def test_hash_on_normalized(spark):
    rows = [(0, '{"ts":1,"a":2}', T0), (1, '{"ts":9,"a":2}', T0 + timedelta(seconds=5))]
    df = spark.createDataFrame(rows, "sample_id long, body string, sampled_at timestamp_ntz")
    assert dedup(with_hash(df)).count() == 2
    assert dedup(with_hash(df, hash_on="normalized")).count() == 1


def test_equal_times_keep_the_smallest_id(spark):
    df = spark.createDataFrame([(i, "h", T0) for i in (3, 1, 2)], "sample_id long, content_hash string, sampled_at timestamp_ntz")
    assert [r["sample_id"] for r in dedup(df).collect()] == [1]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("allow_equal", [False, True])
def test_asof_against_brute_force(spark, direction, allow_equal):
    rnd = random.Random(7)
    left = [(i, rnd.choice("xyz"), rnd.randrange(2000)) for i in range(300)]
    right = [(i, rnd.choice("xyw"), rnd.randrange(2000)) for i in range(120)]

    def frame(rows, name, id_name):
        return spark.createDataFrame([(i, k, T0 + timedelta(seconds=s)) for i, k, s in rows], f"{id_name} long, k string, {name} timestamp_ntz")

    found = asof_join(frame(left, "lt", "lid"), frame(right, "rt", "rid"), ["k"], "lt", "rt", "rid", direction, allow_equal, 45)
    got = {r["lid"]: r["match"]["rid"] if r["match"] else None for r in found.collect()}
    want = {}
    for i, k, s in left:
        back = direction == "backward"
        ok = [
            (-t if back else t, r) for r, key, t in right
            if key == k and ((t < s if back else t > s) or (allow_equal and t == s))
        ]
        want[i] = min(ok)[1] if ok else None
    assert got == want


def test_correlation_golden(spark):
    noon = datetime(2024, 1, 1, 12)
    v = spark.createDataFrame([("v", "s", noon)], "violation_id string, service_id string, detected_at timestamp_ntz")
    d = spark.createDataFrame(
        [(f"d{m}", "s", noon - timedelta(minutes=m)) for m in (30, 29, 1, 0)],
        "deployment_id string, service_id string, deployed_at timestamp_ntz",
    )
    assert correlate(v, d, "first").first()["deployment_id"] == "d29"
    assert correlate(v, d, "nearest").first()["deployment_id"] == "d1"
    assert correlate(v, d.filter("deployment_id in ('d30', 'd0')")).count() == 0


def test_rate_limit_exact(spark):
    seconds = [0, 1, 59, 60, 61, 119, 121, 130, 300]
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)], "sample_id long, sampled_at timestamp_ntz")
    for fold_limit in (10_000, 0):
        kept = A.rate_limit_exact(df, cap=2, seconds=60, fold_limit=fold_limit)
        assert sorted(r["sample_id"] for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]


def test_nearest_ranks(spark):
    rnd = random.Random(3)
    values = [(k, rnd.randrange(500)) for k in "ab" for _ in range(137)]
    df = spark.createDataFrame(values, "k string, v long")
    got = {r["k"]: (r["p50"], r["p95"], r["p99"]) for r in M.nearest_ranks(df, ["k"], "v", (50, 95, 99), bucket=16).collect()}
    for k in "ab":
        ordered = sorted(v for key, v in values if key == k)
        assert got[k] == tuple(ordered[137 * p // 100] for p in (50, 95, 99))


def test_sustained_alerts(spark):
    minutes = [(0, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (7, 0), (8, 1)]
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=m), v) for m, v in minutes], "k string, t timestamp_ntz, v int")
    got = M.sustained_alerts(df, ["k"], "t", F.col("v") > 0, 120).collect()
    assert [(r["started_at"], r["held_seconds"]) for r in got] == [(T0 + timedelta(minutes=3), 180)]


def test_throttle_by_severity(spark):
    rows = [(i, "s", T0 + timedelta(minutes=30 * i), p) for p in ("P1", "P2") for i in range(10)]
    df = spark.createDataFrame(
        [(n, s, t, p) for n, (_, s, t, p) in enumerate(rows)], "id long, service_id string, at timestamp_ntz, alert_severity string"
    )
    sent = M.throttle_alerts(df, M.route_table(spark), ["service_id"], "at", "id").collect()
    count = {p: sum(r["alert_severity"] == p for r in sent) for p in ("P1", "P2")}
    assert count == {"P1": 5, "P2": 2}
    assert {r["receiver"] for r in sent} == {"slack-critical", "slack-warning"}
