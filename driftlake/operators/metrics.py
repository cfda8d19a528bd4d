"""Rates, quantiles, load statistics, service levels and alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.functions.scalars import micros
from driftlake.operators.anchors import FOLD_LIMIT, drop_repeats

# Receivers and repeat intervals per severity, and the service levels.
ROUTES = [("P1", "slack-critical", 3600), ("P2", "slack-warning", 4 * 3600)]
DEFAULT_ROUTE = ("slack-critical", 4 * 3600)
SLO_P95_MS = 500
SLO_FAILURES = 0.01


def error_rate(samples: DataFrame, keys: Sequence[str] = ("service_id", "endpoint")) -> DataFrame:
    errors = F.count_if(F.col("status_code") >= 400)
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), errors.alias("errors"), (errors / F.count("*")).alias("error_rate")
    )


def rate(events: DataFrame, time: str, label: Sequence[str], window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events per second over a sliding window and label.

    The events are first counted per slide, so only counts are copied into the windows they
    belong to, not the events.
    """
    step = F.window(time, slide)
    counts = events.groupBy(step.start.alias("step"), *label).agg(F.count("*").alias("c"))
    seconds = F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))
    return (
        counts.groupBy(F.window("step", window, slide).alias("w"), *label)
        .agg(F.sum("c").alias("n"))
        .select(F.col("w.start").alias("window_start"), *label, "n", (F.col("n") / seconds).alias("rate"))
    )


def latency_quantiles(
    samples: DataFrame, keys: Sequence[str] = ("endpoint",), window: str = "5 minutes", alert_p95: float | None = None
) -> DataFrame:
    """Exact p50 / p95 / p99 of the duration per window; durations are counted before the exchange."""
    quantiles = [F.percentile("duration_ms", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    out = (
        samples.groupBy(F.window("sampled_at", window).start.alias("window_start"), *keys)
        .agg(F.count("*").alias("n"), *quantiles)
    )
    return out if alert_p95 is None else out.withColumn("alert", F.col("p95") > alert_p95)


#: Leading bits of a value that a latency sketch keeps; a value is told to within one part in 2**(bits - 1).
SKETCH_BITS = 7


def sketch_bucket(value: Column, bits: int = SKETCH_BITS) -> Column:
    """The least value with the same leading bits; values below ``2**bits`` stay as they are, negative ones count as 0."""
    v = F.greatest(value.cast("bigint"), F.lit(0).cast("bigint"))
    drop = F.greatest(F.length(F.bin(v)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def latency_panes(samples: DataFrame, keys: Sequence[str] = ("endpoint",), time: str = "sampled_at", value: str = "duration_ms", pane: str = "1 minute", bits: int = SKETCH_BITS) -> DataFrame:
    """Sketches of a value per key and pane: counts by leading bits.

    Counts of equal buckets add up, so panes merge into windows of any length, days into months, and parts of a stream
    into the whole; a sketch has at most ``64 * 2**(bits - 1)`` buckets.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(F.window(time, pane).alias("w"), *keys, sketch_bucket(F.col(value), bits).alias("bucket")).agg(F.count("*").alias("c"))
    return counted.select(F.col("w.start").alias("pane"), *keys, "bucket", "c")


def sketch_quantiles(panes: DataFrame, keys: Sequence[str] = ("endpoint",), window: str = "5 minutes", slide: str = "1 minute", percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank quantiles of sliding windows, merged from panes: the value at index ``floor(n * p / 100)``, low by at most its share of ``SKETCH_BITS``."""
    merged = panes.groupBy(F.window("pane", window, slide).start.alias("window_start"), *keys, "bucket").agg(F.sum("c").alias("c"))
    # a window of a key has a bounded number of buckets
    whole = Window.partitionBy("window_start", *keys)
    upto = F.sum("c").over(whole.orderBy("bucket"))
    placed = merged.withColumns({"upto": upto, "n": F.sum("c").over(whole)})
    picked = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("bucket"))).alias(f"p{p}") for p in percents]
    return placed.groupBy("window_start", *keys).agg(F.first("n").alias("n"), *picked)


RANK_BUCKET = 4096


def value_counts(rows: DataFrame, keys: Sequence[str], value: str, **weights: Column) -> DataFrame:
    """Rows reduced to counts per (keys, value); ``weights`` are conditions counted beside all rows."""
    extra = [F.count_if(w).alias(name) for name, w in weights.items()]
    return rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"), *extra)


def values_at(
    counts: DataFrame, keys: Sequence[str], indexes: dict[str, Callable[[Column], Column]], weight: str = "c",
    extra: Sequence[Column] = (), bucket: int = RANK_BUCKET,
) -> DataFrame:
    """The values at given 0-based sorted indexes per key, without a global sort.

    ``counts`` comes from :func:`value_counts`; ``indexes`` maps an output name to a function of
    the total weight. Running counts are taken inside value buckets and then over the bucket
    totals, so no task walks all distinct values of a key. ``extra`` aggregates share the pass.
    """
    keys = list(keys)
    w = F.when(F.col("v").isNotNull(), F.col(weight)).otherwise(0)
    counts = counts.withColumns({"w": w, "b": F.coalesce(F.floor(F.col("v") / bucket), F.lit(0))})
    totals = counts.groupBy(*keys, "b").agg(F.sum("w").alias("bucket_n"))
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "b", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset"),
        F.sum("bucket_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "b").orderBy("v")
    placed = counts.withColumn("upto", F.sum("w").over(inside)).join(offsets, [*keys, "b"])
    high = F.col("offset") + F.col("upto")
    low = high - F.col("w")

    def pick(index: Column) -> Column:
        return F.max(F.when((low <= index) & (index < high), F.col("v")))

    picked = [pick(index(F.col("total"))).alias(name) for name, index in indexes.items()]
    return placed.groupBy(*keys).agg(*picked, F.first("total").alias("total"), *extra)


def _ranks(percents: Sequence[int]) -> dict[str, Callable[[Column], Column]]:
    return {f"p{p}": (lambda n, p=p: F.floor(n * p / 100)) for p in percents}


def nearest_ranks(
    rows: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], bucket: int = RANK_BUCKET
) -> DataFrame:
    """Nearest-rank percentiles: the value at index ``floor(n * p / 100)``."""
    return values_at(value_counts(rows, keys, value), keys, _ranks(percents), bucket=bucket).drop("total")


def load_stats(samples: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Request and error counts; min, integer average, nearest-rank percentiles and max of the
    latency of the successful requests. Everything is taken from one table of counts."""
    counts = value_counts(samples, keys, "duration_ms", ok=F.col("status_code") < 400)
    seen = F.when((F.col("ok") > 0) & F.col("v").isNotNull(), F.col("v"))
    timed = F.when(F.col("v").isNotNull(), F.col("ok")).otherwise(0)
    extra = [
        F.sum("c").alias("requests"), F.sum("ok").alias("successful"), (F.sum("c") - F.sum("ok")).alias("errors"),
        F.min(seen).alias("min_ms"), F.floor(F.sum(seen * F.col("ok")) / F.nullif(F.sum(timed), F.lit(0))).alias("avg_ms"),
        F.max(seen).alias("max_ms"),
    ]
    return values_at(counts, keys, _ranks((50, 95, 99)), "ok", extra).drop("total")


def slo_check(samples: DataFrame, keys: Sequence[str] = ("endpoint",), p95_ms: float = SLO_P95_MS, failures: float = SLO_FAILURES) -> DataFrame:
    """Interpolated p95 of the duration and the failure rate against their bounds."""
    counts = value_counts(samples, keys, "duration_ms", failed=F.col("status_code") >= 400)
    ends = {"lo": lambda n: F.floor((n - 1) * 0.95), "hi": lambda n: F.ceil((n - 1) * 0.95)}
    found = values_at(counts, keys, ends, extra=[(F.sum("failed") / F.sum("c")).alias("failure_rate")])
    at = (F.col("total") - 1) * 0.95
    p95 = F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))
    return found.select(*keys, p95.alias("p95_ms"), "failure_rate").select(
        "*", (F.col("p95_ms") < p95_ms).alias("latency_ok"), (F.col("failure_rate") < failures).alias("failures_ok")
    )


def kpi_cards(contracts: DataFrame, violations: DataFrame, gate_history: DataFrame) -> DataFrame:
    """Contracts, active violations, gate denials and the mean drift score, in one row.

    Each table is reduced to one partial row; the partial rows are summed, so nothing is crossed.
    """
    zero = F.lit(0).cast("bigint")
    parts = [
        contracts.agg(F.count("*").alias("contracts")),
        violations.agg(F.count_if(~F.col("resolved")).alias("active_violations")),
        gate_history.agg(
            F.count_if(F.col("decision") == "DENY").alias("gate_blocks"),
            F.sum("drift_score").alias("score_sum"), F.count("drift_score").alias("score_n"),
        ),
    ]
    names = ("contracts", "active_violations", "gate_blocks", "score_sum", "score_n")
    whole = None
    for part in parts:
        row = part.select(*[F.col(n).cast("bigint").alias(n) if n in part.columns else zero.alias(n) for n in names])
        whole = row if whole is None else whole.unionByName(row)
    mean = F.when(F.sum("score_n") > 0, F.round(F.sum("score_sum") / F.sum("score_n"), 2)).otherwise(0.0)
    return whole.agg(*[F.sum(n).alias(n) for n in names[:3]], mean.alias("drift_score"))


def drift_ranking(scores: DataFrame) -> DataFrame:
    """Highest drift score first."""
    return scores.orderBy(F.desc("drift_score"))


def sustained_alerts(series: DataFrame, keys: Sequence[str], time: str, condition: Column, hold_seconds: int) -> DataFrame:
    """Stretches of a series in which ``condition`` stayed true for at least ``hold_seconds``.

    ``series`` holds one row per key and evaluation time (a windowed metric).
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(time)
    flips = (
        series.withColumn("hit", F.coalesce(condition, F.lit(False)))
        .withColumn("new", (F.col("hit") != F.coalesce(F.lag("hit").over(order), ~F.col("hit"))).cast("int"))
        .withColumn("island", F.sum("new").over(order))
    )
    lasted = micros(F.max(time)) - micros(F.min(time))
    return (
        flips.filter("hit").groupBy(*keys, "island")
        .agg(F.min(time).alias("started_at"), F.max(time).alias("last_at"), lasted.alias("held_us"))
        .filter(F.col("held_us") >= hold_seconds * 1_000_000)
        .select(*keys, "started_at", "last_at", (F.col("held_us") / 1_000_000).cast("bigint").alias("held_seconds"))
    )


def route_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "alert_severity string, receiver string, repeat_seconds bigint")


def route_alerts(alerts: DataFrame, routes: DataFrame) -> DataFrame:
    """Receiver and repeat interval per alert severity, with the default route for the rest."""
    return alerts.join(routes, "alert_severity", "left").withColumns(
        {
            "receiver": F.coalesce("receiver", F.lit(DEFAULT_ROUTE[0])),
            "repeat_seconds": F.coalesce("repeat_seconds", F.lit(DEFAULT_ROUTE[1]).cast("bigint")),
        }
    )


def throttle_alerts(
    alerts: DataFrame, routes: DataFrame, keys: Sequence[str], time: str, row_id: str, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """The alerts that are sent: per group, none within the repeat interval of the last sent one."""
    routed = route_alerts(alerts, routes).withColumn("t_us", micros(F.col(time)))
    period = F.col("repeat_seconds") * 1_000_000
    sent = drop_repeats(routed, [*keys, "alert_severity"], "t_us", row_id, period, fold_limit)
    return sent.drop("t_us")
