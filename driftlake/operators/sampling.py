"""Rate-limited sampling and per-endpoint reservoirs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.scalars import from_micros, micros
from driftlake.operators.anchors import FOLD_LIMIT, anchor_points
from driftlake.operators.asof import asof_join
from driftlake.session import materialize

# The agent's budget.
CAP = 1000
WINDOW_SECONDS = 60


def _first_n(rows: DataFrame, group: Sequence, order: Sequence, cap: int) -> DataFrame:
    # the optimizer limits every partition to ``cap`` rows per group before the exchange
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rn") <= cap)


def _priority(status: str | None) -> list[Column]:
    """Errors first when a boost is wanted."""
    return [] if status is None else [(F.col(status) < 400).cast("int")]


def rate_limit(
    samples: DataFrame, time: str = "sampled_at", row_id: str = "sample_id", cap: int = CAP,
    seconds: int = WINDOW_SECONDS, agent: Sequence[str] = (), errors_first: str | None = None,
) -> DataFrame:
    """The first ``cap`` samples of each clock-aligned window (per agent, if there are several)."""
    start = F.window(time, f"{seconds} seconds").start.alias("window_start")
    windowed = samples.withColumn("window_start", start)
    return _first_n(windowed, [*agent, "window_start"], [*_priority(errors_first), time, row_id], cap)


def rate_limit_exact(
    samples: DataFrame, time: str = "sampled_at", row_id: str = "sample_id", cap: int = CAP,
    seconds: int = WINDOW_SECONDS, agent: Sequence[str] = (), fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """The first ``cap`` samples of each window, where a window starts at the first sample that
    comes ``seconds`` or more after the start of the one before.
    """
    agent = list(agent)
    if not agent:
        agent = ["agent"]
        samples = samples.withColumn("agent", F.lit("agent"))
    width = seconds * 1_000_000
    points = samples.select(*agent, micros(F.col(time)).alias("t")).distinct()
    points = materialize(points.withColumn("period", F.lit(width).cast("bigint")), "points")
    like = samples.schema[time].dataType.simpleString()
    starts = anchor_points(points, agent, fold_limit).select(
        *agent, from_micros(F.col("t"), like).alias("window_start"), F.col("t").alias("wid")
    )
    placed = asof_join(samples, starts, agent, time, "window_start", "wid", allow_equal=True, bucket_seconds=seconds)
    placed = placed.withColumn("window_start", F.col("match.window_start")).drop("match")
    return _first_n(placed, [*agent, "window_start"], [time, row_id], cap)


def reservoir(
    samples: DataFrame, order: Column, time: str = "sampled_at", per: Sequence[str] = ("endpoint",),
    size: int = CAP, seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Up to ``size`` samples per window and endpoint, chosen by a stable pseudo-random order."""
    start = F.window(time, f"{seconds} seconds").start.alias("window_start")
    windowed = samples.withColumns({"window_start": start, "pick": order})
    return _first_n(windowed, [*per, "window_start"], ["pick"], size).drop("pick")
