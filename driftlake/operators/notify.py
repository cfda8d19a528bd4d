"""Notification groups: alerts of one group are sent together, after a wait, then in intervals.

A group opens at its first alert and is flushed ``wait`` seconds later, then every ``interval`` seconds. A flush sends a
notification if alerts have come since the last one, or if an alert still fires (``firing`` seconds after it came) and the
repeat interval of the route has passed since the last notification. A flush that finds neither new nor firing alerts
closes the group; the next alert opens it anew. Times are whole seconds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Wait before the first notification of a group, and interval between further ones, in seconds.
GROUP_WAIT, GROUP_INTERVAL = 30, 300
#: Seconds an alert fires after it came.
FIRING = 7200


def next_notification(flush: int, last: int, upcoming: int | None, repeat: int, wait: int, interval: int, firing: int) -> int | None:
    """When the notification after the one at ``flush`` is sent; ``last`` is the newest alert by then, ``upcoming`` the next."""
    closing = max(1, -(-(last + firing - flush) // interval))
    fresh = -(-(upcoming - flush) // interval) if upcoming is not None else None
    again = max(1, -(-repeat // interval))
    steps = [s for s, ok in ((fresh, fresh is not None and fresh <= closing), (again, again < closing)) if ok]
    if steps:
        return flush + interval * min(steps)
    return None if upcoming is None else upcoming + wait


def _chain(times: np.ndarray, counts: np.ndarray, repeat: int, wait: int, interval: int, firing: int) -> Iterator[tuple[int, int]]:
    """(second, new alerts) of the notifications of one stretch of sorted alert times."""
    total = np.concatenate([[0], np.cumsum(counts)])
    flush, sent = int(times[0]) + wait, 0
    while flush is not None:
        at = int(np.searchsorted(times, flush, "right"))
        yield flush, int(total[at] - total[sent])
        sent = at
        flush = next_notification(flush, int(times[at - 1]), int(times[at]) if at < len(times) else None, repeat, wait, interval, firing)


def notifications(
    alerts: DataFrame, keys: Sequence[str], time: str, repeat: str = "repeat_seconds", wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL, firing: int = FIRING
) -> DataFrame:
    """One row per notification: keys, notified_at, n_new (0 for a repeated one).

    Alerts are counted per group and second before they move. A pause longer than ``firing + 2 * interval`` always closes
    a group, so the stretches between such pauses are independent and go to different tasks; a stretch holds at most one
    row per second, however many alerts came.
    """
    keys = list(keys)
    seconds = alerts.groupBy(*keys, F.unix_seconds(F.col(time).cast("timestamp")).alias("t")).agg(F.count("*").alias("n"), F.max(repeat).alias("repeat"))
    # the pause before a second is looked for inside buckets, and between the ends of the buckets of a group
    bucket = F.floor(F.col("t") / 86400)
    inside = Window.partitionBy(*keys, "bucket").orderBy("t")
    order = Window.partitionBy(*keys).orderBy("bucket")
    pause = firing + 2 * interval
    opens = F.coalesce((F.col("t") - F.lag("t").over(inside) > pause).cast("int"), F.lit(0))
    marked = seconds.withColumn("bucket", bucket).withColumn("opens", opens)
    days = marked.groupBy(*keys, "bucket").agg(F.min("t").alias("first"), F.max("t").alias("end"), F.sum("opens").alias("inner_opens"))
    days = days.withColumn("head", F.coalesce((F.col("first") - F.lag("end").over(order) > pause).cast("int"), F.lit(1)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("base", F.coalesce(F.sum(F.col("head") + F.col("inner_opens")).over(before), F.lit(0)) + F.col("head"))
    # groups may have null keys
    same = reduce(lambda x, y: x & y, [F.col(f"m.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, "bucket"]])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("opened", F.sum("opens").over(upto)).alias("m").join(days.select(*keys, "bucket", "base").alias("d"), same)
    placed = placed.select("m.*", (F.col("base") + F.col("opened")).alias("stretch"))

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        found = list(_chain(rows["t"].to_numpy(), rows["n"].to_numpy(), int(rows["repeat"].iloc[0]), wait, interval, firing))
        return pd.DataFrame([(*key[:-1], pd.Timestamp(t, unit="s"), n) for t, n in found], columns=[*keys, "notified_at", "n_new"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for k in keys for f in alerts.schema if f.name == k)
    return placed.groupBy(*keys, "stretch").applyInPandas(send, f"{kinds}, notified_at timestamp_ntz, n_new long")
