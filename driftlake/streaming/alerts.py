"""Alerts on a stream: a condition that stays true for some time, grouped and throttled notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from driftlake.operators.metrics import DEFAULT_ROUTE, ROUTES
from driftlake.operators.notify import FIRING, GROUP_INTERVAL, GROUP_WAIT
from driftlake.streaming.dedup import WATERMARK, dedup_stream
from driftlake.streaming.ordered import OrderedProcessor


class _Held(OrderedProcessor):
    """State per key: since when the condition holds, when it was last seen to hold, whether the alert has been raised."""

    columns = ["started_at", "last_at", "raised_at"]

    def __init__(self, key_names: list[str], time: str, hit: str, hold: int):
        super().__init__(key_names, time, hit)
        self.hold = hold

    def advance(self, pairs, state, now):
        since, last, raised = state or (None, None, 0)
        out, gone = [], sorted(t for t in pairs if t < now)
        for t in gone:
            if since is not None and not raised and t > since + self.hold:
                # time had passed the hold before this evaluation came
                out.append((since, last, since + self.hold))
                raised = 1
            if not pairs[t]:
                since, last, raised = None, None, 0
                continue
            since, last = t if since is None else since, t
            if raised or t - since >= self.hold:
                out.append((since, t, since + self.hold))
                raised = 1
        if since is not None and not raised and now > since + self.hold:
            out.append((since, last, since + self.hold))
            raised = 1
        ahead = [t for t in pairs if t >= now] + ([since + self.hold] if since is not None and not raised else [])
        return out, gone, None if since is None else (since, last, raised), min(ahead, default=None)


def sustained_stream(series: DataFrame, keys: Sequence[str], time: str, hit: str, hold_seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """Alerts on a condition column ``hit`` that stays true for ``hold_seconds`` per key.

    ``series`` holds one row per key and evaluation (a windowed metric); evaluations count in event-time order, to the
    second, once the watermark has passed them. A row (started_at, last_at, raised_at) is given when the alert is raised,
    which a timer does if no evaluation comes before, and for every evaluation that prolongs it.
    """
    keys = list(keys)
    columns = [f"{f.name} {f.dataType.simpleString()}" for k in keys for f in series.schema if f.name == k]
    return series.withWatermark(time, watermark).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Held(keys, time, hit, hold_seconds),
        outputStructType=", ".join([*columns, "started_at timestamp", "last_at timestamp", "raised_at timestamp"]), outputMode="Append", timeMode="EventTime",
    )


class _Groups(OrderedProcessor):
    """State per group: time of the next flush, of the last notification, and of the newest alert that was flushed."""

    columns = ["notified_at", "n_new"]

    def __init__(self, key_names: list[str], time: str, repeats: dict[str, int], default: int, wait: int, interval: int, firing: int):
        super().__init__(key_names, time, None)
        self.repeats, self.default, self.wait, self.interval, self.firing = repeats, default, wait, interval, firing
        self.level = key_names.index("alert_severity")

    def _run(self, key, timerValues):
        self.repeat = self.repeats.get(key[self.level], self.default)
        return super()._run(key, timerValues)

    def advance(self, pairs, state, now):
        flush, sent, last = state or (None, None, None)
        out, gone = [], []
        while True:
            if flush is None or sent is None:
                # a closed group opens at its earliest alert, which a late one within the watermark may still move
                if not pairs:
                    return out, gone, None, None
                flush, sent = min(pairs) + self.wait, None
            if flush >= now:
                return out, gone, (flush, sent, last), flush
            fresh = [t for t in pairs if t <= flush]
            new = sum(pairs.pop(t) for t in fresh)
            gone += fresh
            last = max(fresh, default=last)
            if new or (last + self.firing > flush and flush - sent >= self.repeat):
                out.append((flush, new))
                sent = flush
            elif last + self.firing <= flush:
                flush = sent = last = None
                continue
            flush += self.interval


def notification_stream(
    alerts: DataFrame, keys: Sequence[str], time: str, repeats: dict[str, int] | None = None, default: int = DEFAULT_ROUTE[1],
    wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL, firing: int = FIRING, watermark: str = WATERMARK,
) -> DataFrame:
    """The notifications of :func:`notify.notifications` on a stream: timers flush groups, also when no alert comes.

    ``keys`` has ``alert_severity`` among them; ``repeats`` gives the repeat interval per severity.
    """
    keys = list(keys)
    repeats = {s: r for s, _, r in ROUTES} if repeats is None else repeats
    columns = [f"{f.name} {f.dataType.simpleString()}" for k in keys for f in alerts.schema if f.name == k]
    return alerts.select(*keys, time).withWatermark(time, watermark).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Groups(keys, time, repeats, default, wait, interval, firing),
        outputStructType=", ".join([*columns, "notified_at timestamp", "n_new bigint"]), outputMode="Append", timeMode="EventTime",
    )


def throttle_stream(
    alerts: DataFrame, keys: Sequence[str], time: str, row_id: str, watermark: str = WATERMARK
) -> DataFrame:
    """Alerts routed by :func:`metrics.route_alerts`, none within the repeat interval of the last sent one."""
    return dedup_stream(alerts, [*keys, "alert_severity"], time, row_id, None, watermark, period_column="repeat_seconds")
