"""Promotion policies as a small table, from YAML or from the defaults."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions.scalars import window_seconds

SCHEMA = (
    "ordinal int, policy string, description string, action string, "
    "condition int, severity string, min_count bigint, window string"
)

# The default policies.
DEFAULT_POLICIES = [
    {
        "name": "block-breaking",
        "description": "Deny if any BREAKING violation in last 24h",
        "conditions": [{"severity": "BREAKING", "min_count": 1, "window": "24h"}],
        "action": "deny",
    },
    {
        "name": "warn-on-warnings",
        "description": "Warn if 5+ WARNING violations in last 1h",
        "conditions": [{"severity": "WARNING", "min_count": 5, "window": "1h"}],
        "action": "warn",
    },
    {
        "name": "block-critical-services",
        "description": "Deny if any violation on payment-service in last 1h",
        "conditions": [{"severity": "BREAKING", "min_count": 1, "window": "1h"}],
        "action": "deny",
    },
]


def policy_table(spark: SparkSession, policies: list[dict] | None = None) -> DataFrame:
    """One row per condition, in file order; a policy without conditions yields no row (it never matches)."""
    rows = [
        (n, p["name"], p.get("description"), p.get("action", "deny"), i, c.get("severity"), c.get("min_count", 0), c.get("window"))
        for n, p in enumerate(DEFAULT_POLICIES if policies is None else policies)
        for i, c in enumerate(p.get("conditions") or [])
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("window_seconds", window_seconds(F.col("window")))


def load_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policies of a YAML file; a missing file means no policies, hence allow."""
    if not os.path.exists(path):
        return policy_table(spark, [])
    import yaml

    with open(path) as f:
        return policy_table(spark, (yaml.safe_load(f) or {}).get("policies") or [])
