"""Policies, gate decisions, overrides."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftlake.operators import gate as G
from driftlake.sources.policies import load_policies, policy_table

NOW = datetime(2024, 1, 10, 12)


def as_of():
    return F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")



def violations(spark, *rows):
    return spark.createDataFrame(
        [("s", sev, None if hours is None else NOW - timedelta(hours=hours)) for sev, hours in rows],
        "service_id string, severity string, detected_at timestamp_ntz",
    )


def requests(spark, *services):
    rows = [(s, "v1", "production") for s in services or ("s",)]
    return spark.createDataFrame(rows, "service_id string, version_sha string, target_env string")


def decide(spark, rows, mode="event", policies=None, **options):
    checked = G.gate_check(requests(spark), violations(spark, *rows), policy_table(spark, policies), as_of(), mode, **options)
    row = checked.first()
    return row["decision"], row["policy"], row["recommendation"]


def test_old_violation_hides_recent_ones_in_summary_mode(spark):
    rows = [("BREAKING", 72), ("BREAKING", 1)]
    assert decide(spark, rows, "summary") == ("ALLOW", None, "proceed")
    assert decide(spark, rows, "event") == ("DENY", "block-breaking", "deny")


@pytest.mark.parametrize("mode", ["summary", "event"])
def test_first_policy_wins_and_bounds_are_strict(spark, mode):
    assert decide(spark, [("BREAKING", 0.5)], mode)[1] == "block-breaking"
    assert decide(spark, [("BREAKING", 24)], mode)[0] == "ALLOW"
    assert decide(spark, [("BREAKING", 0)], mode)[0] == "ALLOW"
    assert decide(spark, [("WARNING", 0.5)] * 4, mode)[0] == "ALLOW"
    assert decide(spark, [("WARNING", 0.5)] * 5, mode) == ("DENY", "warn-on-warnings", "deny")


def test_warn_action(spark):
    assert decide(spark, [("WARNING", 0.5)] * 5, honor_action=True) == ("ALLOW", "warn-on-warnings", "warn")


def test_all_conditions_must_hold(spark):
    both = [{"name": "p", "conditions": [
        {"severity": "BREAKING", "min_count": 1, "window": "1h"}, {"severity": "WARNING", "min_count": 2, "window": "1d"}]}]
    assert decide(spark, [("BREAKING", 0.5), ("WARNING", 3)], policies=both)[0] == "ALLOW"
    assert decide(spark, [("BREAKING", 0.5), ("WARNING", 3), ("WARNING", 4)], policies=both)[0] == "DENY"


def test_policies_without_conditions_or_count(spark):
    assert decide(spark, [("BREAKING", 0.5)], policies=[{"name": "none", "conditions": []}])[0] == "ALLOW"
    assert decide(spark, [("BREAKING", 0.5)], policies=[])[0] == "ALLOW"
    always = [{"name": "always", "conditions": [{"severity": "BREAKING", "window": "1h"}]}]
    assert decide(spark, [("ADDITIVE", 1)], policies=always)[:2] == ("DENY", "always")
    no_window = [{"name": "ever", "conditions": [{"severity": "BREAKING", "min_count": 1}]}]
    assert decide(spark, [("BREAKING", 24 * 300)], policies=no_window)[0] == "DENY"


def test_details_and_unknown(spark):
    seen = violations(spark, (None, 1), ("WARNING", None), ("WARNING", 2))
    row = G.gate_check(requests(spark, "s", "t"), seen, policy_table(spark), as_of()).orderBy("service_id").collect()
    assert [r["details"] for r in row] == ["UNKNOWN: 1 violations; WARNING: 2 violations", ""]
    assert row[1]["reason"] == "No blocking policies matched"
    summary = {r["severity"]: r["latest"] for r in G.severity_summary(seen, as_of()).collect()}
    assert summary["WARNING"] == NOW


def test_override_needs_a_reason(spark):
    rows = [("s", "v1", "production", r, "me") for r in ("fix", "  ", None)]
    asked = spark.createDataFrame(rows, "service_id string, version_sha string, target_env string, reason string, override_by string")
    assert [r["override_reason"] for r in G.override(asked, as_of()).collect()] == ["fix"]
    assert [r["reason"] for r in G.override_response(asked).collect()] == ["Overridden: fix"]


def test_yaml(spark, tmp_path):
    assert load_policies(spark, str(tmp_path / "missing.yml")).count() == 0
    path = tmp_path / "policies.yml"
    path.write_text(
        'policies:\n  - name: "p"\n    description: "d"\n    conditions:\n      - severity: "BREAKING"\n        min_count: 2\n        window: "90m"\n    action: "deny"\n'
    )
    row = load_policies(spark, str(path)).first()
    assert (row["policy"], row["min_count"], row["window_seconds"]) == ("p", 2, 5400)
