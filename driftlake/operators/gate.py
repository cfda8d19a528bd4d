"""Promotion gate: policies evaluated for all requests at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.scalars import not_blank
from driftlake.operators.correlate import short_sha, status_of

ALLOW_REASON = "No blocking policies matched"
UNKNOWN = "UNKNOWN"
REQUEST = ("service_id", "version_sha", "target_env")


def severity_summary(violations: DataFrame, as_of: Column, keys: Sequence[str] = ("service_id",)) -> DataFrame:
    """Count, earliest and latest per severity; missing values count as UNKNOWN and ``as_of``."""
    detected = F.coalesce("detected_at", as_of)
    return violations.groupBy(*keys, F.coalesce("severity", F.lit(UNKNOWN)).alias("severity")).agg(
        F.count("*").alias("n"), F.min(detected).alias("earliest"), F.max(detected).alias("latest")
    )


def _window_start(as_of: Column) -> Column:
    """Start of a condition's window; no window means since the epoch."""
    start = as_of - F.make_dt_interval(secs=F.col("window_seconds"))
    return F.coalesce(start, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def matched_policies(violations: DataFrame, policies: DataFrame, as_of: Column, mode: str = "summary") -> tuple[DataFrame, DataFrame]:
    """The first matching policy per service, and the policies that match every service.

    ``summary`` counts a severity as a whole, and only if its earliest and latest violations
    both lie in the window; ``event`` counts the violations inside the window. Violations are
    reduced to one row per (service, condition) before any exchange; a condition that needs no
    violation holds for every service and is only subtracted from what the policy needs.
    """
    conditions = policies.withColumn("free", F.col("min_count") <= 0)
    needs = conditions.groupBy("ordinal", "policy", "description", "action").agg(
        F.count_if(~F.col("free")).alias("needed")
    )
    counted = conditions.filter("NOT free").select("ordinal", "condition", "severity", "min_count", "window_seconds")
    start = _window_start(as_of)
    if mode == "summary":
        groups = severity_summary(violations, as_of)
        rows = groups.join(counted, "severity").filter((F.col("earliest") > start) & (F.col("latest") < as_of))
        n = F.sum("n")
    else:
        named = violations.select(
            "service_id", F.coalesce("severity", F.lit(UNKNOWN)).alias("severity"), F.coalesce("detected_at", as_of).alias("at")
        )
        rows = named.join(counted, "severity").filter((F.col("at") > start) & (F.col("at") < as_of))
        n = F.count("*")
    held = (
        rows.groupBy("service_id", "ordinal", "condition").agg(n.alias("n"), F.first("min_count").alias("min_count"))
        .filter("n >= min_count")
        .groupBy("service_id", "ordinal").agg(F.count("*").alias("held"))
    )
    met = held.join(needs, "ordinal").filter("held = needed")
    verdict = F.struct("ordinal", "policy", "description", "action")
    return met.groupBy("service_id").agg(F.min_by(verdict, "ordinal").alias("hit")), needs.filter("needed = 0")


def gate_check(
    requests: DataFrame, violations: DataFrame, policies: DataFrame, as_of: Column, mode: str = "summary",
    honor_action: bool = False,
) -> DataFrame:
    """Decision per request (service, version, environment).

    A matching policy denies; with ``honor_action`` a policy whose action is ``warn`` lets the
    request pass with that recommendation.
    """
    hits, always = matched_policies(violations, policies, as_of, mode)
    lines = severity_summary(violations, as_of).groupBy("service_id").agg(
        # one entry per severity name of the service
        F.array_join(F.array_sort(F.collect_list(F.format_string("%s: %d violations", "severity", "n"))), "; ").alias("details")
    )
    verdict = F.struct("ordinal", "policy", "description", "action")
    standing = always.agg(F.min_by(verdict, "ordinal").alias("s")).first()["s"]
    if standing is None:
        hit = F.col("hit")
    else:
        fixed = F.struct(*[F.lit(standing[c]).alias(c) for c in ("ordinal", "policy", "description", "action")])
        hit = F.least(F.coalesce("hit", fixed), fixed)
    checked = (
        requests.select(*REQUEST).join(hits, "service_id", "left").join(lines, "service_id", "left").withColumn("hit", hit)
    )
    deny = F.col("hit").isNotNull()
    if honor_action:
        deny = deny & (F.col("hit.action") == "deny")
    recommendation = F.when(deny, "deny").when(F.col("hit").isNotNull(), F.col("hit.action")).otherwise("proceed")
    return checked.select(
        *REQUEST,
        (~deny).alias("allowed"),
        F.when(deny, "DENY").otherwise("ALLOW").alias("decision"),
        F.coalesce("hit.description", F.lit(ALLOW_REASON)).alias("reason"),
        F.col("hit.policy").alias("policy"),
        F.coalesce("details", F.lit("")).alias("details"),
        recommendation.alias("recommendation"),
    )


def audit_rows(decisions: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows of gate decisions."""
    return decisions.select(
        *REQUEST, "decision", F.lit(0).alias("drift_score"), F.lit(None).cast("string").alias("override_reason"),
        F.lit(None).cast("string").alias("override_by"), as_of.alias("decided_at"),
    )


def override(requests: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows of override requests; a request without a reason is rejected."""
    return requests.filter(not_blank(F.col("reason"))).select(
        *REQUEST, F.lit("OVERRIDE").alias("decision"), F.lit(None).cast("int").alias("drift_score"),
        F.col("reason").alias("override_reason"), "override_by", as_of.alias("decided_at"),
    )


def override_response(requests: DataFrame) -> DataFrame:
    return requests.filter(not_blank(F.col("reason"))).select(
        *REQUEST, F.lit(True).alias("allowed"), F.concat(F.lit("Overridden: "), "reason").alias("reason"),
        F.lit("proceed").alias("recommendation"),
    )


def history(gate_history: DataFrame, service: str | None = None) -> DataFrame:
    """Decisions newest first, of one service if given."""
    if service is not None:
        gate_history = gate_history.filter(F.col("service_id") == service)
    return gate_history.orderBy(F.desc("decided_at"))


def gate_timeline(gate_history: DataFrame, service: str | None = None) -> DataFrame:
    return history(gate_history, service).select(
        "id", "service_id", short_sha(F.col("version_sha")).alias("version"), "target_env", "decided_at",
        status_of(F.col("decision")).alias("status"),
    )


def decision_totals(gate_history: DataFrame) -> DataFrame:
    return gate_history.groupBy("decision").agg(F.count("*").alias("n"))
