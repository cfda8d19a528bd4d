"""First-anchored periods: the chain behind dedup, rate limits and alert throttling.

Per key, the first time is an anchor; the next anchor is the first time at least one period
after the last anchor, and so on. The chain is sequential, so it is cut to stay parallel:

* a key with few distinct times is folded inside one row;
* a busy key is cut into time segments. Each segment tells, for every moment the chain may
  enter it, where the chain leaves it. Entries that leave at the same time merge, segments are
  composed level by level, the one true entry is passed down again, and each segment marks its
  own anchors. No task sees all times of a busy key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.session import materialize

FOLD_LIMIT = 10_000
LEAF_ROWS = 500_000
LEAF_PERIODS = 16
FANOUT = 16
NEVER = np.iinfo(np.int64).min


def _next(times: np.ndarray, exits: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chains that may continue from ``after`` get to; and whether they find any time."""
    at = np.searchsorted(times, after, "left")
    found = at < len(times)
    return np.where(found, exits[np.minimum(at, len(times) - 1)], NEVER), found


def _merge(entries: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep the last entry of each run of equal exits."""
    last = np.append(exits[1:] != exits[:-1], True)
    return entries[last], exits[last]


def _leaf_steps(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry-to-exit steps of one segment, from its times."""
    times = np.unique(rows["t"].to_numpy())
    period = int(rows["period"].iloc[0])
    start = int(rows["seg"].iloc[0]) * int(rows["width"].iloc[0])
    entries = times[: np.searchsorted(times, start + period, "left") + 1]
    exits = entries.copy()
    while True:
        follow, found = _next(times, times, exits + period)
        if not found.any():
            break
        exits = np.where(found, follow, exits)
        entries, exits = _merge(entries, exits)
    return _steps(rows, entries, exits)


def _steps(rows: pd.DataFrame, entries: np.ndarray, exits: np.ndarray) -> pd.DataFrame:
    head = rows.iloc[0]
    return pd.DataFrame(
        {"kid": head["kid"], "period": head["period"], "seg": head["seg"], "entry": entries, "leave": exits}
    )


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    """Steps of a parent segment from the steps of its children."""
    period = int(rows["period"].iloc[0])
    entries = exits = None
    for _, child in rows.sort_values(["child", "entry"]).groupby("child", sort=True):
        times, leave = child["entry"].to_numpy(), child["leave"].to_numpy()
        if entries is None:
            entries, exits = times, leave
            open_end = True
            continue
        follow, found = _next(times, leave, exits + period)
        exits = np.where(found, follow, exits)
        if open_end:
            # a chain that finds nothing in the earlier children enters at the first time here
            entries, exits = np.append(entries, times[0]), np.append(exits, leave[0])
            open_end = False
        entries, exits = _merge(entries, exits)
    return _steps(rows, entries, exits)


def _descend(entry: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The moment the true chain may enter each child of a segment."""
    out = []
    if len(entry) and len(rows):
        period, after = int(rows["period"].iloc[0]), int(entry["after"].iloc[0])
        for seg, child in rows.sort_values(["child", "entry"]).groupby("child", sort=True):
            out.append((rows["kid"].iloc[0], seg, after))
            at = np.searchsorted(child["entry"].to_numpy(), after, "left")
            if at < len(child):
                after = int(child["leave"].iloc[at]) + period
    return pd.DataFrame(out, columns=["kid", "seg", "after"]).astype("int64")


def _mark(entry: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The anchors inside one segment."""
    out = []
    if len(entry) and len(rows):
        period, after = int(rows["period"].iloc[0]), int(entry["after"].iloc[0])
        times = np.unique(rows["t"].to_numpy())
        at = np.searchsorted(times, after, "left")
        while at < len(times):
            out.append((rows["kid"].iloc[0], times[at]))
            at = np.searchsorted(times, times[at] + period, "left")
    return pd.DataFrame(out, columns=["kid", "t"]).astype("int64")


STEP_SCHEMA = "kid long, period long, seg long, entry long, leave long"


def _busy_anchors(points: DataFrame) -> DataFrame:
    """Anchors of busy keys; input (kid, t, period, width of a segment), output (kid, t)."""
    origin = points.agg(F.min("t")).first()[0]
    points = points.withColumn("t", F.col("t") - origin)
    leaf = points.withColumn("seg", F.floor(F.col("t") / F.col("width")))
    levels = [materialize(leaf.groupBy("kid", "seg").applyInPandas(_leaf_steps, STEP_SCHEMA), "steps")]
    while True:
        lowest, highest = levels[-1].agg(F.min("seg"), F.max("seg")).first()
        if lowest == highest:
            break
        up = levels[-1].withColumnRenamed("seg", "child").withColumn("seg", F.floor(F.col("child") / FANOUT))
        levels.append(materialize(up.groupBy("kid", "seg").applyInPandas(_compose, STEP_SCHEMA), "steps"))
    entry = levels[-1].select("kid", "seg").distinct().withColumn("after", F.lit(NEVER))
    for steps in reversed(levels[:-1]):
        down = steps.withColumnRenamed("seg", "child").withColumn("seg", F.floor(F.col("child") / FANOUT))
        entry = (
            entry.groupBy("kid", "seg").cogroup(down.groupBy("kid", "seg"))
            .applyInPandas(_descend, "kid long, seg long, after long")
        )
    marked = entry.groupBy("kid", "seg").cogroup(leaf.groupBy("kid", "seg")).applyInPandas(_mark, "kid long, t long")
    return marked.withColumn("t", F.col("t") + origin)


def anchor_points(
    points: DataFrame, keys: Sequence[str], fold_limit: int = FOLD_LIMIT, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Anchors (keys, t) of distinct points (keys, t, period); times in microseconds.

    ``period`` is in microseconds and the same for all points of a key. Keys with more than
    ``fold_limit`` points are cut into segments of about ``leaf_rows`` points.
    """
    keys = list(keys)
    counts = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("period").alias("period"), F.min("t").alias("low"), F.max("t").alias("high")
    )
    busy = counts.filter(F.col("n") > fold_limit)
    if busy.isEmpty():
        return _fold(points, keys)
    # busy keys get a short number: at most (rows / fold_limit) of them exist
    periods = F.ceil((F.col("high") - F.col("low")) / F.col("period") * leaf_rows / F.col("n"))
    width = (F.greatest(periods, F.lit(LEAF_PERIODS)) * F.col("period")).alias("width")
    numbered = materialize(busy.select(*keys, F.monotonically_increasing_id().alias("kid"), width), "busy")
    hot = points.join(numbered, keys).select("kid", "t", "period", "width")
    marked = _busy_anchors(hot).join(numbered, "kid").select(*keys, "t")
    return _fold(points.join(numbered, keys, "left_anti"), keys).unionByName(marked)


def _fold(points: DataFrame, keys: list[str]) -> DataFrame:
    """The chain of keys with few times, as a fold over a bounded sorted array."""
    chain = F.expr(
        """aggregate(array_sort(ts), CAST(array() AS ARRAY<BIGINT>),
             (kept, t) -> CASE WHEN size(kept) = 0 OR t >= element_at(kept, -1) + period
                               THEN array_append(kept, t) ELSE kept END)"""
    )
    grouped = points.groupBy(*keys).agg(F.collect_list("t").alias("ts"), F.first("period").alias("period"))
    return grouped.select(*keys, F.explode(chain).alias("t"))


def drop_repeats(
    rows: DataFrame, keys: Sequence[str], time_us: str, row_id: str, period_us, fold_limit: int = FOLD_LIMIT,
    leaf_rows: int = LEAF_ROWS, last_kept: DataFrame | None = None,
) -> DataFrame:
    """Keep the rows that open a period of their key; of rows at one time the smallest id.

    Only (keys, time, id) takes part in the chain; the wide rows are met again in a semi join
    on unique values, which has no busy key. ``last_kept`` (keys, last) continues earlier
    chains: times before the end of the last kept period cannot open a new one.
    """
    keys = list(keys)
    period = F.lit(period_us) if isinstance(period_us, int) else period_us
    points = rows.groupBy(*keys, F.col(time_us).alias("t")).agg(
        F.min(row_id).alias(row_id), F.first(period).cast("bigint").alias("period")
    )
    if last_kept is not None:
        open_again = F.col("last").isNull() | (F.col("t") >= F.col("last") + F.col("period"))
        points = points.join(last_kept.select(*keys, "last"), keys, "left").filter(open_again).drop("last")
    points = materialize(points, "points")
    kept = anchor_points(points.select(*keys, "t", "period"), keys, fold_limit, leaf_rows).join(points, [*keys, "t"])
    kept = kept.withColumnRenamed("t", time_us).select(*keys, time_us, row_id)
    return rows.join(kept, [*keys, time_us, row_id], "left_semi")
