"""Queries on contracts, violations, deployments and gate decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions.scalars import window_seconds
from driftlake.operators import contracts as C
from driftlake.operators import correlate as R
from driftlake.operators import gate as G
from driftlake.operators import metrics as M
from driftlake.operators import registry_drift as RD
from driftlake.plans.catalog import query
from driftlake.plans.views import base, view
from driftlake.sources.policies import policy_table
from driftlake.sources.sinks import append, keyed_json
from driftlake.sources.snapshots import SnapshotTable
from driftlake.sources.traffic import deployments_from_releases
from driftlake.session import scratch_folder

AS_OF = "2024-01-20 12:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def contracts(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "contracts")


def violations(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "violations")


def deployments(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "deployments")


def gate_history(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "gate_history")


# -- contracts ---------------------------------------------------------------------------------

_LATEST = """SELECT * FROM contracts WHERE status = 'active'
 QUALIFY row_number() OVER (PARTITION BY provider_id, consumer_id, endpoint ORDER BY version DESC, id DESC) = 1"""


@query("latest_contract", _LATEST, ("contracts",))
def latest_contract(spark, sf_dir):
    return C.latest(contracts(spark, sf_dir))


@query(
    "contract_pairs",
    """SELECT provider_id, consumer_id, endpoint,
         arg_max(id, (version, id)) FILTER (source <> 'inferred') AS baseline_id,
         arg_max(id, (version, id)) FILTER (source = 'inferred') AS inferred_id
       FROM contracts WHERE status = 'active' GROUP BY ALL HAVING baseline_id IS NOT NULL AND inferred_id IS NOT NULL""",
    ("contracts",),
)
def contract_pairs(spark, sf_dir):
    return C.pairs(contracts(spark, sf_dir))


# A document per contract: a is an integer or a number, b comes and goes, and is required in some; each 17th is cut off.
_DOCUMENT = """CASE WHEN {n} % 17 = 0 THEN '{"properties":' ELSE concat('{"type":"object","required":["a"', CASE WHEN {n} % 7 < 3 THEN ',"b"' ELSE '' END,
  '],"properties":{"a":{"type":"', CASE WHEN {n} % 2 = 0 THEN 'integer' ELSE 'number' END, '"}', CASE WHEN {n} % 5 > 1 THEN ',"b":{"type":"string"}' ELSE '' END, '}}') END"""
_PAIRS_SQL = """pairs AS (SELECT provider_id, consumer_id, endpoint,
    arg_max(id, (version, id)) FILTER (source <> 'inferred') AS baseline_id, arg_max(id, (version, id)) FILTER (source = 'inferred') AS inferred_id
    FROM contracts WHERE status = 'active' GROUP BY ALL HAVING baseline_id IS NOT NULL AND inferred_id IS NOT NULL),
  numbered AS (SELECT *, CAST(substr(baseline_id, 5) AS BIGINT) AS n, CAST(substr(inferred_id, 5) AS BIGINT) AS m FROM pairs),
  verdicts AS (SELECT provider_id, consumer_id, endpoint, baseline_id, inferred_id, 'a' AS path,
      CASE WHEN n % 2 = 0 AND m % 2 = 1 THEN 'ADDITIVE' WHEN n % 2 = 1 AND m % 2 = 0 THEN 'BREAKING' END AS severity
      FROM numbered WHERE n % 17 <> 0 AND m % 17 <> 0 UNION ALL
    SELECT provider_id, consumer_id, endpoint, baseline_id, inferred_id, 'b',
      CASE WHEN n % 5 > 1 AND m % 5 <= 1 THEN CASE WHEN n % 7 < 3 THEN 'BREAKING' ELSE 'WARNING' END
           WHEN n % 5 <= 1 AND m % 5 > 1 THEN CASE WHEN m % 7 < 3 THEN 'BREAKING' ELSE 'ADDITIVE' END
           WHEN n % 5 > 1 AND n % 7 < 3 AND m % 7 >= 3 THEN 'BREAKING' END
      FROM numbered WHERE n % 17 <> 0 AND m % 17 <> 0)"""
_DRIFT_SQL = "SELECT * FROM verdicts WHERE severity IS NOT NULL"


def documents(spark, sf_dir) -> DataFrame:
    number = "CAST(substring(id, 5) AS BIGINT)"
    return contracts(spark, sf_dir).withColumn("schema_json", F.expr(_DOCUMENT.replace("{n}", number)))


@query("registry_drift", _DRIFT_SQL, ("contracts",), _PAIRS_SQL)
def registry_drift(spark, sf_dir):
    """Latest declared document of every key against its latest inferred one."""
    return RD.evaluate(RD.document_pairs(documents(spark, sf_dir)))[0].drop("description")


@query(
    "registry_rejects",
    """SELECT provider_id, consumer_id, endpoint, baseline_id, inferred_id, 'baseline' AS side, baseline_id AS contract_id FROM numbered WHERE n % 17 = 0
       UNION ALL SELECT provider_id, consumer_id, endpoint, baseline_id, inferred_id, 'inferred', inferred_id FROM numbered WHERE m % 17 = 0""",
    ("contracts",), _PAIRS_SQL,
)
def registry_rejects(spark, sf_dir):
    """Pairs with a document that cannot be read; the others are evaluated all the same."""
    return RD.evaluate(RD.document_pairs(documents(spark, sf_dir)))[1]


@query(
    "contract_import",
    """SELECT c.id, c.provider_id, c.consumer_id, c.endpoint, c.version, c.source,
         CASE WHEN t.k IS NOT NULL AND c.status = 'active' AND c.source <> 'inferred' THEN 'superseded' ELSE c.status END AS status
       FROM contracts c LEFT JOIN (SELECT DISTINCT provider_id, consumer_id, endpoint, 1 AS k FROM imports) t USING (provider_id, consumer_id, endpoint)
       UNION ALL
       SELECT i.id, i.provider_id, i.consumer_id, i.endpoint,
         coalesce(m.top, 0) + row_number() OVER (PARTITION BY i.provider_id, i.consumer_id, i.endpoint ORDER BY i.id), 'manual',
         CASE WHEN row_number() OVER (PARTITION BY i.provider_id, i.consumer_id, i.endpoint ORDER BY i.id DESC) = 1
              THEN 'active' ELSE 'superseded' END
       FROM imports i LEFT JOIN (SELECT provider_id, consumer_id, endpoint, max(version) AS top FROM contracts GROUP BY ALL) m
         USING (provider_id, consumer_id, endpoint)""",
    ("contracts",),
    """imports AS (SELECT concat('new-', CAST(s_suppkey AS STRING)) AS id, concat('svc-', CAST(s_suppkey % 10 AS STRING)) AS provider_id,
         concat('svc-', CAST((s_suppkey + 3) % 10 AS STRING)) AS consumer_id, '/api/click' AS endpoint
       FROM supplier WHERE s_suppkey % 4 <> 0)""",
)
def contract_import(spark, sf_dir):
    """Every supplier row is an import request; each fourth lacks its schema and is rejected."""
    return C.import_contracts(contracts(spark, sf_dir), import_requests(spark, sf_dir))


def import_requests(spark, sf_dir) -> DataFrame:
    return base(spark, sf_dir, "supplier").selectExpr(
        "concat('new-', s_suppkey) AS id", "concat('svc-', s_suppkey % 10) AS provider_id",
        "concat('svc-', (s_suppkey + 3) % 10) AS consumer_id", "'/api/click' AS endpoint",
        "CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE '{\"type\":\"object\"}' END AS schema_json", "CAST(NULL AS STRING) AS source",
    )


@query(
    "contract_versions",
    """SELECT id, provider_id, consumer_id, endpoint, version, source, CASE WHEN version = 0 THEN 'archived' ELSE status END AS status FROM (
      SELECT c.id, c.provider_id, c.consumer_id, c.endpoint, c.version, c.source,
         CASE WHEN t.k IS NOT NULL AND c.status = 'active' AND c.source <> 'inferred' THEN 'superseded' ELSE c.status END AS status
       FROM contracts c LEFT JOIN (SELECT DISTINCT provider_id, consumer_id, endpoint, 1 AS k FROM imports) t USING (provider_id, consumer_id, endpoint)
       UNION ALL
       SELECT i.id, i.provider_id, i.consumer_id, i.endpoint,
         coalesce(m.top, 0) + row_number() OVER (PARTITION BY i.provider_id, i.consumer_id, i.endpoint ORDER BY i.id), 'manual',
         CASE WHEN row_number() OVER (PARTITION BY i.provider_id, i.consumer_id, i.endpoint ORDER BY i.id DESC) = 1
              THEN 'active' ELSE 'superseded' END
       FROM imports i LEFT JOIN (SELECT provider_id, consumer_id, endpoint, max(version) AS top FROM contracts GROUP BY ALL) m
         USING (provider_id, consumer_id, endpoint))""",
    ("contracts",),
    """imports AS (SELECT concat('new-', CAST(s_suppkey AS STRING)) AS id, concat('svc-', CAST(s_suppkey % 10 AS STRING)) AS provider_id,
         concat('svc-', CAST((s_suppkey + 3) % 10 AS STRING)) AS consumer_id, '/api/click' AS endpoint
       FROM supplier WHERE s_suppkey % 4 <> 0)""",
)
def contract_versions(spark, sf_dir):
    """A table of versions: loaded, changed by an import, then by an archive; each change is one checked commit."""
    table = SnapshotTable(spark, scratch_folder(spark, "contracts"))
    table.commit(contracts(spark, sf_dir), 0)
    table.update(lambda rows: C.import_contracts(rows, import_requests(spark, sf_dir)))
    table.update(lambda rows: C.archive(rows, rows.filter("version = 0").select("id")))
    return table.read()


@query(
    "contract_archive",
    """SELECT id, provider_id, consumer_id, endpoint, version, source,
       CASE WHEN version = 0 THEN 'archived' ELSE status END AS status FROM contracts""",
    ("contracts",),
)
def contract_archive(spark, sf_dir):
    table = contracts(spark, sf_dir)
    return C.archive(table, table.filter("version = 0").select("id"))


@query(
    "contract_search",
    "SELECT * FROM contracts WHERE contains(lower(provider_id), 'vc-3') OR contains(lower(consumer_id), 'vc-3')",
    ("contracts",),
)
def contract_search(spark, sf_dir):
    return C.search(contracts(spark, sf_dir), "VC-3")


@query(
    "contracts_by_status",
    "SELECT * FROM contracts WHERE status = 'superseded' AND provider_id = 'svc-4' AND consumer_id = 'svc-7'",
    ("contracts",),
)
def contracts_by_status(spark, sf_dir):
    return C.select_contracts(contracts(spark, sf_dir), status="superseded", provider="svc-4", consumer="svc-7")


@query("contract_by_id", "SELECT * FROM contracts WHERE id = 'con-42'", ("contracts",))
def contract_by_id(spark, sf_dir):
    return C.select_contracts(contracts(spark, sf_dir), id="con-42")


_DOCUMENTS = """concat('{"type":"object","required":["id"', CASE WHEN c_custkey % 2 = 0 THEN ',"name"' ELSE '' END, '],"properties":{',
  '"id":{"type":"', CASE WHEN c_custkey % 3 = 0 THEN 'integer' ELSE 'string' END, '"},',
  '"name":{"type":"string","nullable":', CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END, '},',
  '"at":{"type":"string","format":"', CASE WHEN c_custkey % 2 = 0 THEN 'date' ELSE 'date-time' END, '"},',
  '"seg":{"type":"string","enum":["', c_mktsegment, '","OTHER"]},',
  '"any":{},"u":{"type":["string","null"]},',
  '"rows":{"type":"array","items":{"type":"object","required":["q"],"properties":{"q":{"type":"number","pattern":"^', CAST(c_custkey % 7 AS STRING), '"}}}}',
  '}}')"""


@query(
    "contract_to_nodes",
    """SELECT c_custkey, n.path, n.type, n.required, n.enum_values, n.format, n.pattern, n.nullable FROM customer, LATERAL (VALUES
      ('id', CASE WHEN c_custkey % 3 = 0 THEN 'integer' ELSE 'string' END, true, '', NULL, NULL, false),
      ('name', 'string', c_custkey % 2 = 0, '', NULL, NULL, c_custkey % 5 = 0),
      ('at', 'string', false, '', CASE WHEN c_custkey % 2 = 0 THEN 'date' ELSE 'date-time' END, NULL, false),
      ('seg', 'string', false, c_mktsegment || ',OTHER', NULL, NULL, false),
      ('any', 'object', false, '', NULL, NULL, false), ('u', '', false, '', NULL, NULL, false),
      ('rows', 'array', false, '', NULL, NULL, false), ('rows[]', 'object', false, '', NULL, NULL, false),
      ('rows[].q', 'number', true, '', NULL, '^' || CAST(c_custkey % 7 AS STRING), false)
    ) n(path, type, required, enum_values, format, pattern, nullable)""",
)
def contract_to_nodes(spark, sf_dir):
    docs = base(spark, sf_dir, "customer").select("c_custkey", F.expr(_DOCUMENTS).alias("schema_json"))
    return C.contract_to_nodes(docs, ["c_custkey"]).withColumn("enum_values", F.array_join("enum_values", ","))


# -- violations --------------------------------------------------------------------------------


@query(
    "violations_filtered",
    "SELECT * FROM violations WHERE severity = 'BREAKING' AND contains(lower(service_id), 'svc-1') AND NOT resolved",
    ("violations",),
)
def violations_filtered(spark, sf_dir):
    return C.filter_violations(violations(spark, sf_dir), severity="BREAKING", service_contains="SVC-1", resolved=False)


@query(
    "violation_resolve",
    """SELECT violation_id, contract_id, service_id, severity, resolved OR coalesce(severity = 'ADDITIVE', false) AS resolved, detected_at
       FROM violations""",
    ("violations",),
)
def violation_resolve(spark, sf_dir):
    table = violations(spark, sf_dir)
    return C.resolve(table, table.filter("severity = 'ADDITIVE'").select("violation_id"))


@query(
    "violation_summary",
    """SELECT count(*) AS total, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (resolved) AS resolved,
       count(*) FILTER (severity = 'BREAKING') AS breaking, count(*) FILTER (severity = 'WARNING') AS warning,
       count(*) FILTER (severity = 'ADDITIVE') AS additive FROM violations""",
    ("violations",),
)
def violation_summary(spark, sf_dir):
    return C.violation_summary(violations(spark, sf_dir))


@query("violations_by_type_resolved", "SELECT severity, resolved, count(*) AS n FROM violations GROUP BY ALL", ("violations",))
def violations_by_type_resolved(spark, sf_dir):
    return C.by_type_resolved(violations(spark, sf_dir))


_SEVERITY = """severities AS (SELECT service_id, coalesce(severity, 'UNKNOWN') AS severity, count(*) AS n,
   min(coalesce(detected_at, {as_of})) AS earliest, max(coalesce(detected_at, {as_of})) AS latest FROM violations GROUP BY 1, 2)""".format(as_of=AS_OF_SQL)


@query("severity_summary", "SELECT * FROM severities", ("violations",), _SEVERITY)
def severity_summary(spark, sf_dir):
    return G.severity_summary(violations(spark, sf_dir), as_of())


_RECENT = "SELECT * FROM violations ORDER BY detected_at DESC, violation_id DESC LIMIT 5"


@query("recent_violations", _RECENT, ("violations",))
def recent_violations(spark, sf_dir):
    return C.recent(violations(spark, sf_dir))


@query(
    "violations_by_provider",
    """SELECT v.violation_id, v.severity, v.detected_at, c.provider_id, c.consumer_id, c.endpoint
       FROM violations v JOIN contracts c ON c.id = v.contract_id WHERE c.provider_id = 'svc-2'""",
    ("violations", "contracts"),
)
def violations_by_provider(spark, sf_dir):
    active = contracts(spark, sf_dir).filter("provider_id = 'svc-2'")
    return C.violations_of(violations(spark, sf_dir), active).select(
        "violation_id", "severity", "detected_at", "provider_id", "consumer_id", "endpoint"
    )


@query(
    "orphan_violations",
    "SELECT v.* FROM violations v ANTI JOIN (SELECT id FROM contracts WHERE status <> 'archived') c ON c.id = v.contract_id",
    ("violations", "contracts"),
)
def orphan_violations(spark, sf_dir):
    return C.without_contract(violations(spark, sf_dir), contracts(spark, sf_dir).filter("status <> 'archived'"))


@query(
    "cascade_delete",
    "SELECT v.* FROM violations v SEMI JOIN (SELECT id FROM contracts WHERE status <> 'archived') c ON c.id = v.contract_id",
    ("violations", "contracts"),
)
def cascade_delete(spark, sf_dir):
    return C.cascade_delete(violations(spark, sf_dir), contracts(spark, sf_dir).filter("status <> 'archived'"))


@query("distinct_services", "SELECT DISTINCT service_id FROM gate_history", ("gate_history",))
def distinct_services(spark, sf_dir):
    return gate_history(spark, sf_dir).select("service_id").distinct()


# -- deployments -------------------------------------------------------------------------------


def _correlated_sql(order: str) -> str:
    return f"""correlated AS (
      SELECT v.*, d.deployed_at, d.deployment_id, d.version_sha, d.environment
      FROM violations v JOIN deployments d ON d.service_id = v.service_id
       AND d.deployed_at > v.detected_at - INTERVAL 30 MINUTE AND d.deployed_at < v.detected_at
      QUALIFY row_number() OVER (PARTITION BY v.violation_id ORDER BY d.deployed_at {order}, d.deployment_id) = 1)"""


def correlated(spark: SparkSession, sf_dir: str, pick: str) -> DataFrame:
    return R.correlate(violations(spark, sf_dir), deployments(spark, sf_dir), pick)


@query("correlate_first", "SELECT * FROM correlated", ("violations", "deployments"), _correlated_sql("ASC"))
def correlate_first(spark, sf_dir):
    return correlated(spark, sf_dir, "first")


@query("correlate_nearest", "SELECT * FROM correlated", ("violations", "deployments"), _correlated_sql("DESC"))
def correlate_nearest(spark, sf_dir):
    return correlated(spark, sf_dir, "nearest")


@query(
    "sink_correlated",
    """SELECT violation_id AS key, violation_id, deployment_id, version_sha, severity FROM correlated""",
    ("violations", "deployments"), _correlated_sql("ASC"),
)
def sink_correlated(spark, sf_dir):
    """Records keyed by violation; the JSON is read back to compare it."""
    records = keyed_json(correlate_first(spark, sf_dir), ["violation_id"])
    body = F.from_json("value", "violation_id string, deployment_id string, version_sha string, severity string")
    return records.select("key", body.alias("v")).select("key", "v.*")


@query(
    "deployment_timeline",
    """SELECT d.deployment_id, d.service_id, d.version_sha, d.environment, d.deployed_at, left(d.version_sha, 7) AS version,
         count(c.violation_id) AS violations, count(*) FILTER (c.severity = 'BREAKING') AS breaking,
         count(*) FILTER (c.severity = 'WARNING') AS warning, count(*) FILTER (c.severity = 'ADDITIVE') AS additive
       FROM deployments d LEFT JOIN correlated c USING (deployment_id)
       GROUP BY ALL ORDER BY d.deployed_at DESC""",
    ("violations", "deployments"), _correlated_sql("ASC"),
)
def deployment_timeline(spark, sf_dir):
    return R.timeline(deployments(spark, sf_dir), correlate_first(spark, sf_dir))


@query(
    "deployment_timeline_items",
    """SELECT d.*, left(d.version_sha, 7) AS version, c.violation_id, c.severity, c.detected_at
       FROM deployments d LEFT JOIN correlated c USING (deployment_id)""",
    ("violations", "deployments"), _correlated_sql("ASC"),
)
def deployment_timeline_items(spark, sf_dir):
    return R.timeline_items(deployments(spark, sf_dir), correlate_first(spark, sf_dir))


@query(
    "deployments_from_releases",
    """SELECT concat('repo-', CAST(user_id % 10 AS STRING), ':v', CAST(event_id % 500 AS STRING)) AS deployment_id,
         concat('repo-', CAST(user_id % 10 AS STRING)) AS service_id, concat('v', CAST(event_id % 500 AS STRING)) AS version_sha,
         'production' AS environment, min(ts) AS deployed_at, 'GITHUB_RELEASE' AS source,
         concat('Release ', CAST(event_id % 500 AS STRING)) AS metadata
       FROM events GROUP BY ALL""",
)
def releases(spark, sf_dir):
    """Each event is one listing entry of a poll; a tag shows up in many polls."""
    polled = base(spark, sf_dir, "events").selectExpr(
        "concat('repo-', user_id % 10) AS repo",
        """concat('{"tag_name":"v', event_id % 500, '","name":"Release ', event_id % 500, '"}') AS release""",
        "ts AS polled_at",
    )
    return deployments_from_releases(polled)


# -- gate --------------------------------------------------------------------------------------

_REQUESTS = "requests AS (SELECT DISTINCT service_id, version_sha, environment AS target_env FROM deployments)"
_POLICIES = """policies(ordinal, policy, description, severity, min_count, seconds) AS (VALUES
  (0, 'block-breaking', 'Deny if any BREAKING violation in last 24h', 'BREAKING', 1, 86400),
  (1, 'warn-on-warnings', 'Warn if 5+ WARNING violations in last 1h', 'WARNING', 5, 3600),
  (2, 'block-critical-services', 'Deny if any violation on payment-service in last 1h', 'BREAKING', 1, 3600))"""


def _gate_sql(mode: str, as_of_sql: str, stretch: int = 1) -> tuple[str, str]:
    severities = _SEVERITY.replace(AS_OF_SQL, as_of_sql)
    if mode == "summary":
        count = f"""SELECT s.service_id, p.* FROM severities s JOIN policies p USING (severity)
          WHERE s.earliest > {as_of_sql} - to_seconds(p.seconds * {stretch}) AND s.latest < {as_of_sql}
          GROUP BY ALL HAVING sum(s.n) >= p.min_count"""
    else:
        count = f"""SELECT v.service_id, p.* FROM violations v JOIN policies p USING (severity)
          WHERE v.detected_at > {as_of_sql} - to_seconds(p.seconds) AND v.detected_at < {as_of_sql}
          GROUP BY ALL HAVING count(*) >= p.min_count"""
    ctes = f"""{severities}, {_REQUESTS}, {_POLICIES}, held AS ({count}),
      hits AS (SELECT service_id, arg_min(policy, ordinal) AS policy, arg_min(description, ordinal) AS description FROM held GROUP BY ALL),
      lines AS (SELECT service_id, string_agg(severity || ': ' || n || ' violations', '; ' ORDER BY severity) AS details FROM severities GROUP BY ALL)"""
    sql = """SELECT r.*, h.policy IS NULL AS allowed, CASE WHEN h.policy IS NULL THEN 'ALLOW' ELSE 'DENY' END AS decision,
         coalesce(h.description, 'No blocking policies matched') AS reason, h.policy, coalesce(l.details, '') AS details,
         CASE WHEN h.policy IS NULL THEN 'proceed' ELSE 'deny' END AS recommendation
       FROM requests r LEFT JOIN hits h USING (service_id) LEFT JOIN lines l USING (service_id)"""
    return sql, ctes


def requests(spark, sf_dir) -> DataFrame:
    asked = deployments(spark, sf_dir).select("service_id", "version_sha", F.col("environment").alias("target_env"))
    return asked.distinct()


# In the summary form one violation before the window hides all others. So that decisions differ over the whole month,
# the windows are stretched to 31 times their length and begin within its first day.
SUMMARY_AS_OF, SUMMARY_STRETCH = "2024-02-01 06:00:00", 31
_sum_sql, _sum_ctes = _gate_sql("summary", f"TIMESTAMP '{SUMMARY_AS_OF}'", SUMMARY_STRETCH)


@query("gate_check_summary", _sum_sql, ("violations", "deployments"), _sum_ctes)
def gate_check_summary(spark, sf_dir):
    moment = F.lit(SUMMARY_AS_OF).cast("timestamp_ntz")
    policies = policy_table(spark).withColumn("window_seconds", F.col("window_seconds") * SUMMARY_STRETCH)
    return G.gate_check(requests(spark, sf_dir), violations(spark, sf_dir), policies, moment, "summary")


_event_sql, _event_ctes = _gate_sql("event", AS_OF_SQL)


@query("gate_check_event", _event_sql, ("violations", "deployments"), _event_ctes)
def gate_check_event(spark, sf_dir):
    return G.gate_check(requests(spark, sf_dir), violations(spark, sf_dir), policy_table(spark), as_of(), "event")


# Warnings of a day first: with honor_action they let a request pass, and a breaking change behind them does not block it.
WARN_FIRST = [
    {"name": "warn-on-warnings", "description": "Warn on any WARNING of the day", "conditions": [{"severity": "WARNING", "min_count": 2, "window": "24h"}], "action": "warn"},
    {"name": "block-breaking", "description": "Deny on any BREAKING of the day", "conditions": [{"severity": "BREAKING", "min_count": 1, "window": "24h"}], "action": "deny"},
]
_WARN_POLICIES = """policies(ordinal, policy, description, severity, min_count, seconds) AS (VALUES
  (0, 'warn-on-warnings', 'Warn on any WARNING of the day', 'WARNING', 2, 86400),
  (1, 'block-breaking', 'Deny on any BREAKING of the day', 'BREAKING', 1, 86400))"""


@query(
    "gate_check_warnings",
    _event_sql.replace("h.policy IS NULL AS allowed", "h.policy IS DISTINCT FROM 'block-breaking' AS allowed")
    .replace("CASE WHEN h.policy IS NULL THEN 'ALLOW' ELSE 'DENY' END", "CASE WHEN h.policy IS DISTINCT FROM 'block-breaking' THEN 'ALLOW' ELSE 'DENY' END")
    .replace("CASE WHEN h.policy IS NULL THEN 'proceed' ELSE 'deny' END", "CASE WHEN h.policy IS NULL THEN 'proceed' WHEN h.policy = 'block-breaking' THEN 'deny' ELSE 'warn' END"),
    ("violations", "deployments"), _event_ctes.replace(_POLICIES, _WARN_POLICIES),
)
def gate_check_warnings(spark, sf_dir):
    """The first matching policy decides, and one that only warns lets the request pass."""
    return G.gate_check(requests(spark, sf_dir), violations(spark, sf_dir), policy_table(spark, WARN_FIRST), as_of(), "event", honor_action=True)


@query(
    "gate_audit",
    f"""SELECT service_id, version_sha, target_env, decision, 0 AS drift_score, CAST(NULL AS VARCHAR) AS override_reason,
        CAST(NULL AS VARCHAR) AS override_by, {AS_OF_SQL} AS decided_at FROM ({_event_sql})""",
    ("violations", "deployments"), _event_ctes,
)
def gate_audit(spark, sf_dir):
    """Audit rows appended to a table folder and read back."""
    path = scratch_folder(spark, "gate_audit")
    append(G.audit_rows(gate_check_event(spark, sf_dir), as_of()), path)
    return spark.read.parquet(path)


@query(
    "gate_override",
    f"""SELECT service_id, version_sha, environment AS target_env, 'OVERRIDE' AS decision, CAST(NULL AS INTEGER) AS drift_score,
        concat('ticket ', deployment_id) AS override_reason, 'ops' AS override_by, {AS_OF_SQL} AS decided_at
        FROM deployments WHERE environment = 'production'""",
    ("deployments",),
)
def gate_override(spark, sf_dir):
    asked = deployments(spark, sf_dir).select(
        "service_id", "version_sha", F.col("environment").alias("target_env"), F.lit("ops").alias("override_by"),
        F.when(F.col("environment") == "production", F.concat(F.lit("ticket "), "deployment_id")).otherwise(" ").alias("reason"),
    )
    return G.override(asked, as_of())


@query("gate_history", "SELECT * FROM gate_history WHERE service_id = 'svc-3' ORDER BY decided_at DESC", ("gate_history",))
def history(spark, sf_dir):
    return G.history(gate_history(spark, sf_dir), "svc-3")


@query(
    "gate_timeline",
    """SELECT id, service_id, left(version_sha, 7) AS version, target_env, decided_at,
       CASE decision WHEN 'DENY' THEN 'blocked' WHEN 'OVERRIDE' THEN 'overridden' ELSE 'success' END AS status
       FROM gate_history WHERE service_id = 'svc-3'""",
    ("gate_history",),
)
def gate_timeline(spark, sf_dir):
    return G.gate_timeline(gate_history(spark, sf_dir), "svc-3")


@query("gate_decision_totals", "SELECT decision, count(*) AS n FROM gate_history GROUP BY ALL", ("gate_history",))
def gate_decision_totals(spark, sf_dir):
    return G.decision_totals(gate_history(spark, sf_dir))


_WINDOW_TEXT = """CASE event_id % 6 WHEN 0 THEN concat(CAST(event_id % 100 AS STRING), 'm') WHEN 1 THEN concat(CAST(event_id % 100 AS STRING), 'h')
  WHEN 2 THEN concat(CAST(event_id % 100 AS STRING), 'D ') WHEN 3 THEN '' WHEN 4 THEN CAST(NULL AS STRING) ELSE 'xyz' END"""


@query(
    "parse_window",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 100 * 60 WHEN 1 THEN event_id % 100 * 3600
       WHEN 2 THEN event_id % 100 * 86400 WHEN 5 THEN 86400 END AS seconds FROM events""",
)
def parse_window(spark, sf_dir):
    return base(spark, sf_dir, "events").select("event_id", window_seconds(F.expr(_WINDOW_TEXT)).alias("seconds"))


@query(
    "kpi_cards",
    """SELECT (SELECT count(*) FROM contracts) AS contracts, (SELECT count(*) FROM violations WHERE NOT resolved) AS active_violations,
       (SELECT count(*) FROM gate_history WHERE decision = 'DENY') AS gate_blocks,
       (SELECT round(avg(drift_score), 2) FROM gate_history) AS drift_score""",
    ("contracts", "violations", "gate_history"),
)
def kpi_cards(spark, sf_dir):
    return M.kpi_cards(contracts(spark, sf_dir), violations(spark, sf_dir), gate_history(spark, sf_dir))
