"""Sliding rates and quantiles on streams, from the counts of short panes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.operators.metrics import latency_panes

WATERMARK = "10 minutes"


def rate_stream(events: DataFrame, time: str, label: Sequence[str], window: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Events per second over a sliding window and label, once the watermark has passed the window.

    The state of an open window is one count per label: events are counted once, by pane, and panes are added up.
    """
    panes = events.withWatermark(time, watermark).groupBy(F.window(time, slide).alias("pane"), *label).agg(F.count("*").alias("c"))
    timed = panes.select(F.window_time("pane").alias("pane_time"), *label, "c")
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return timed.groupBy(F.window("pane_time", window, slide).alias("w"), *label).agg(F.sum("c").alias("n")).select(
        F.col("w.start").alias("window_start"), *label, "n", (F.col("n") / seconds).alias("rate")
    )


def pane_stream(samples: DataFrame, keys: Sequence[str] = ("endpoint",), time: str = "sampled_at", watermark: str = WATERMARK) -> DataFrame:
    """The sketches of :func:`latency_panes` of a stream, each once complete; any later window is merged from their table."""
    return latency_panes(samples.withWatermark(time, watermark), keys, time)
