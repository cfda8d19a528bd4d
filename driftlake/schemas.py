"""Record schemas of the sources and tables."""

import re


class Schema(str):
    """A schema in DDL text, with its column names."""

    @property
    def names(self) -> list[str]:
        return [part.split()[0] for part in re.split(r",(?![^<]*>)", self)]


AGENT_SAMPLE = Schema(
    "service_id string, endpoint string, method string, request_headers map<string,string>, "
    "response_headers map<string,string>, request_body string, response_body string, status_code int, "
    "timestamp timestamp, sampled_at timestamp"
)
PROXY_SAMPLE = Schema(
    "timestamp string, source string, destination string, method string, path string, status_code int, "
    "request_headers map<string,string>, response_headers map<string,string>, request_body string, "
    "response_body string, duration_ms bigint, environment string, _corrupt_record string"
)
WIRE_SAMPLE = Schema(
    "service_id string, endpoint string, method string, request_schema_sample string, "
    "response_schema_sample string, status_code int, timestamp bigint, sampled_at bigint"
)
RAW_SAMPLE = Schema(
    "service_id string, endpoint string, method string, normalized_payload string, content_hash string, "
    "ingested_at timestamp_ntz, ingest_date date"
)
CONTRACT = Schema(
    "id string, provider_id string, consumer_id string, endpoint string, method string, version int, "
    "schema_json string, inferred_at timestamp, source string, status string, created_at timestamp, updated_at timestamp"
)
VIOLATION = Schema(
    "violation_id string, contract_id string, service_id string, severity string, resolved boolean, detected_at timestamp"
)
DEPLOYMENT = Schema(
    "deployment_id string, service_id string, version_sha string, environment string, deployed_at timestamp, "
    "source string, metadata string"
)
GATE_HISTORY = Schema(
    "service_id string, version_sha string, target_env string, decision string, drift_score int, "
    "override_reason string, override_by string, decided_at timestamp_ntz"
)
TABLES = {
    "samples": AGENT_SAMPLE,
    "raw_samples": RAW_SAMPLE,
    "contracts": CONTRACT,
    "violations": VIOLATION,
    "deployments": DEPLOYMENT,
    "gate_history": GATE_HISTORY,
}
# The words the tables allow.
ALLOWED = {
    "contracts": {"source": ("inferred", "manual", "imported"), "status": ("active", "superseded", "archived")},
    "violations": {"severity": ("BREAKING", "WARNING", "ADDITIVE")},
    "gate_history": {"decision": ("ALLOW", "DENY", "OVERRIDE")},
}
