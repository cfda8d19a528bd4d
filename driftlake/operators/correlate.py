"""Violations linked to the deployments that preceded them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.operators.asof import asof_join

WINDOW_MINUTES = 30


def correlate(
    violations: DataFrame, deployments: DataFrame, pick: str = "first", minutes: int = WINDOW_MINUTES
) -> DataFrame:
    """One deployment per violation with ``detected - minutes < deployed < detected``, both strict.

    ``first`` takes the earliest in the window (ties by id), ``nearest`` the latest. Violations
    without one are dropped; rows without a service match nothing.
    """
    deployments = deployments.filter(F.col("service_id").isNotNull())
    window = F.expr(f"INTERVAL {minutes} MINUTES")
    opened = violations.withColumn("opened_at", F.col("detected_at") - window)
    if pick == "first":
        found = asof_join(opened, deployments, ["service_id"], "opened_at", "deployed_at", "deployment_id", "forward")
        in_window = F.col("match.deployed_at") < F.col("detected_at")
    else:
        found = asof_join(opened, deployments, ["service_id"], "detected_at", "deployed_at", "deployment_id")
        in_window = F.col("match.deployed_at") > F.col("opened_at")
    return found.filter(in_window).select(*violations.columns, "match.*")


def status_of(decision: Column) -> Column:
    """Timeline status of a gate decision."""
    return F.when(decision == "DENY", "blocked").when(decision == "OVERRIDE", "overridden").otherwise("success")


def short_sha(version: Column) -> Column:
    return F.substring(version, 1, 7)


def timeline_items(deployments: DataFrame, correlated: DataFrame) -> DataFrame:
    """Deployments, newest first, each with its violations as separate rows (or one empty row)."""
    linked = correlated.select("deployment_id", "violation_id", "severity", "detected_at")
    return (
        deployments.withColumn("version", short_sha(F.col("version_sha")))
        .join(linked, "deployment_id", "left")
        .orderBy(F.desc("deployed_at"), "deployment_id", "detected_at")
    )


def timeline(deployments: DataFrame, correlated: DataFrame) -> DataFrame:
    """Deployments, newest first, with the number of their violations per severity.

    The violations are counted before the join, so a deployment with very many costs one row.
    """
    counts = correlated.groupBy("deployment_id").agg(
        F.count("*").alias("violations"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("BREAKING", "WARNING", "ADDITIVE")],
    )
    return (
        deployments.withColumn("version", short_sha(F.col("version_sha")))
        .join(counts, "deployment_id", "left")
        .na.fill(0, ["violations", "breaking", "warning", "additive"])
        .orderBy(F.desc("deployed_at"), "deployment_id")
    )
