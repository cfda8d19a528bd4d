from datetime import datetime, timedelta

import pandas as pd

from driftlake.operators.correlate import correlate
from driftlake.streaming.correlate import _First, correlate_stream
from driftlake.streaming.replay import as_stream, plain_times, run_to_table

START = datetime(2026, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_first_deployment_in_the_window(spark):
    width = 1800
    # a dense service, ties, window ends exactly met, an empty bucket between, rows that repeat and null columns
    v = [(f"v{i}", "dense" if i % 3 else "thin", i * 37 % 9000, None if i % 5 else "BREAKING") for i in range(240)]
    v += [v[4], ("edge", "thin", 5000 + width, "WARNING"), ("lone", "other", 50, "WARNING"), ("none", None, 60, "WARNING"), ("end", "thin", 20000, "WARNING")]
    d = [(f"d{i:03}", "dense", i * 11 % 8000, f"s{i}") for i in range(300)]
    d += [("d1", "thin", 5000, "a"), ("d2", "thin", 200, None), ("d0", "thin", 200, "b"), ("d3", "thin", 8100, "c"), ("d4", None, 10, "x"), ("d9", "thin", 20000, "y")]
    violations = spark.createDataFrame([(i, s, at(t), x) for i, s, t, x in v], "violation_id string, service_id string, detected_at timestamp_ntz, severity string")
    deployments = spark.createDataFrame([(i, s, at(t), x) for i, s, t, x in d], "deployment_id string, service_id string, deployed_at timestamp_ntz, version_sha string")
    got = run_to_table(correlate_stream(as_stream(violations, "detected_at"), as_stream(deployments, "deployed_at")), "linked")
    columns = ["violation_id", "severity", "service_id", "detected_at", "deployed_at", "deployment_id", "version_sha"]
    rows = sorted(map(tuple, plain_times(got).select(columns).collect()), key=str)
    # both streams end at 20,000 s, and the watermark ten minutes before
    want = correlate(violations, deployments).filter("violation_id <> 'end'").select(columns).distinct().collect()
    assert rows == sorted(map(tuple, want), key=str)
    brute = set()
    for i, s, t, _ in v:
        inside = [(x, n) for n, service, x, _ in d if s is not None and service == s and t - width < x < t]
        if inside and i != "end":
            brute.add((i, min(inside)[1]))
    assert {(r[0], r[5]) for r in rows} == brute and len(rows) == len(brute)


class _Store:
    """A state store and timers that count the calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def __getattr__(self, name):
        # any kind of state is this store
        if not name.startswith("get"):
            raise AttributeError(name)
        return lambda *_: self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def updateValue(self, key, value):
        self.calls += 1

    def iterator(self):
        return iter(())

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.calls += 1
        self.timers.append(timer)


class _Watermark:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis


def test_calls_to_the_state_store_do_not_grow_with_the_rows():
    width, n = 1_800_000_000, 2000
    store, first = _Store(), _First(width)
    first.init(store)
    rows = pd.DataFrame({"service": "s", "bucket": 5, "t": [6 * width + i for i in range(1, n + 1)], "v": [str(i) for i in range(n)], "deployment_id": None, "version_sha": None})
    own = pd.DataFrame({"service": ["s"] * 2, "bucket": [5] * 2, "t": [5 * width + 10, 5 * width + 20], "v": None, "deployment_id": ["b", "a"], "version_sha": None})
    assert list(first.handleInputRows((0, 5), iter([rows, own]), _Watermark(0))) == []
    assert store.calls < 10 and store.timers == [(6 * width + 1) // 1000]
    out = pd.concat(first.handleExpiredTimer((0, 5), _Watermark(8 * width), None))
    # the window of a violation is open at both ends
    assert out["deployment_id"].tolist() == ["b"] * 9 + ["a"] * 10 and store.value is None and not store.timers
