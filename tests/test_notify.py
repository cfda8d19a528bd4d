"""Notification groups against a flush-by-flush simulation, in batch and by timers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from driftlake.operators import notify as N
from driftlake.streaming import alerts as A
from driftlake.streaming.replay import as_stream, plain_times, run_to_table

T0 = datetime(2024, 1, 1)


def simulate(times, repeat, wait, interval, firing):
    """Every flush of every group, one after the other."""
    out, left = [], sorted(times)
    while left:
        flush, sent, last = left[0] + wait, None, None
        while True:
            fresh = [t for t in left if t <= flush]
            left = left[len(fresh):]
            last = fresh[-1] if fresh else last
            if fresh or (last + firing > flush and flush - sent >= repeat):
                out.append((flush, len(fresh)))
                sent = flush
            elif last + firing <= flush:
                break
            flush += interval
    return out


@pytest.mark.parametrize("seed", range(30))
def test_chain_and_timers(seed):
    rng = random.Random(seed)
    wait, interval, firing, repeat = rng.choice([(30, 300, 7200, 3600), (3, 10, 40, 25), (0, 7, 1, 100), (5, 5, 60, 12)])
    times = sorted(rng.randrange(rng.choice((200, 3000, 90_000))) for _ in range(rng.randrange(1, 60)))
    want = simulate(times, repeat, wait, interval, firing)
    seconds, counts = np.unique(times, return_counts=True)
    # stretches between long pauses stand for themselves
    cuts = np.flatnonzero(np.diff(seconds) > firing + 2 * interval) + 1
    got = [x for part in np.split(np.arange(len(seconds)), cuts) for x in N._chain(seconds[part], counts[part], repeat, wait, interval, firing)]
    assert got == want
    group = A._Groups(["k", "alert_severity"], "t", {}, repeat, wait, interval, firing)
    group.repeat = repeat
    pairs, state, sent, now = {}, None, [], 0
    late = sorted(times, key=lambda t: t + rng.randrange(20))  # out of order within the watermark
    end = max(times) + 10 * (firing + repeat + interval)
    while now < end:
        now += rng.randrange(1, 2000)
        arrived = [t for t in late if t < now + 20]
        late = [t for t in late if t >= now + 20]
        for t in arrived:
            pairs[t] = pairs.get(t, 0) + 1
        out, gone, state, wake = group.advance(dict(pairs), state, now)
        for t in gone:
            del pairs[t]
        sent += out
        assert wake is None or wake >= now
    assert sent == want and state is None and not pairs


def test_batch_query_with_null_and_busy_groups(spark):
    rows = [("a", "P1", T0 + timedelta(seconds=s), 3600) for s in [0, 0, 0, 31, 400, 90_000, 90_010]]
    rows += [(None, "P2", T0 + timedelta(seconds=5 * i), 14400) for i in range(400)]
    table = spark.createDataFrame(rows, "k string, alert_severity string, at timestamp_ntz, repeat_seconds long")
    got = N.notifications(table, ["k", "alert_severity"], "at").collect()
    base = int(T0.timestamp()) if T0.tzinfo else 1704067200
    for key, repeat in (("a", 3600), (None, 14400)):
        want = simulate([int((r[2] - T0).total_seconds()) + base for r in rows if r[0] == key], repeat, 30, 300, 7200)
        assert sorted((int((r["notified_at"] - T0).total_seconds()) + base, r["n_new"]) for r in got if r["k"] == key) == want
    assert N.notifications(table.where("false"), ["k", "alert_severity"], "at").count() == 0


def test_a_timer_raises_without_a_new_evaluation(spark):
    rows = [("a", T0, True), ("b", T0, True), ("b", T0 + timedelta(minutes=1), False), ("z", T0 + timedelta(hours=3), False)]
    series = spark.createDataFrame(rows, "k string, t timestamp_ntz, hit boolean")
    told = plain_times(run_to_table(A.sustained_stream(as_stream(series, "t", 2), ["k"], "t", "hit", 120), "timer")).collect()
    assert [(r["k"], r["started_at"], r["last_at"], r["raised_at"]) for r in told] == [("a", T0, T0, T0 + timedelta(minutes=2))]
