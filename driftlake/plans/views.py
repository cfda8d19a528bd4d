"""Domain views over the base tables, as SQL text that both Spark and DuckDB accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlake.session import prepare, spread

TRAFFIC_SAMPLES = """
SELECT event_id AS sample_id,
       concat('svc-', CAST(user_id % 10 AS STRING)) AS service_id,
       concat('svc-', CAST((user_id + 3) % 10 AS STRING)) AS consumer_id,
       concat('/api/', event_type) AS endpoint,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       event_id % 700 AS duration_ms,
       ts AS sampled_at,
       CASE
         WHEN event_id % 211 = 0 THEN '{"order_id":'
         WHEN event_id % 223 = 0 THEN '[1]'
         ELSE concat(
           '{"order_id":"ord_', CAST(event_id AS STRING), '"',
           ',"amount":', CAST(event_id % 997 AS STRING),
           CASE WHEN event_id % 40 = 0 THEN '.5' ELSE '' END,
           CASE WHEN user_id % 10 = 3 AND event_id % 2 = 0 THEN ''
                ELSE concat(',"currency":"',
                  CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END, '"') END,
           ',"items":["a","b"]',
           CASE WHEN user_id % 10 = 5 THEN ''
                ELSE concat(',"user":{"name":"u', CAST(user_id AS STRING), '"',
                  CASE WHEN event_id % 7 = 0 THEN ''
                       ELSE concat(',"email":"u', CAST(user_id AS STRING), '@example.com"') END,
                  '}') END,
           CASE WHEN user_id % 10 = 7 AND event_id % 50 = 0 THEN ',"zip":"1"' ELSE ',"zip":1' END,
           ',"note":', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"n"' END,
           CASE WHEN event_id % 9 = 0 THEN ',"lines":[{"q":1,"r":2},{"q":3}]' ELSE '' END,
           CASE WHEN event_id % 397 = 0
                THEN ',"deep":{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":[{"k":1,"l":[2,[3]]}]}}}}}}}}}}' ELSE '' END,
           ',"ts":', CAST(event_id * 1000 AS STRING),
           '}')
       END AS body
FROM events
"""

DEPLOYMENTS = """
SELECT concat('dep-', CAST(event_id AS STRING)) AS deployment_id,
       concat('svc-', CAST(user_id % 10 AS STRING)) AS service_id,
       concat('v', CAST(event_id AS STRING)) AS version_sha,
       CASE WHEN event_id % 2 = 0 THEN 'production' ELSE 'staging' END AS environment,
       ts AS deployed_at
FROM events WHERE event_type = 'signup'
"""

VIOLATIONS = """
SELECT concat('vio-', CAST(event_id AS STRING)) AS violation_id,
       concat('con-', CAST(user_id % 10 AS STRING)) AS contract_id,
       concat('svc-', CAST(user_id % 10 AS STRING)) AS service_id,
       CASE event_id % 7 WHEN 0 THEN 'BREAKING' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'WARNING'
            WHEN 3 THEN CAST(NULL AS STRING) ELSE 'ADDITIVE' END AS severity,
       event_id % 4 = 0 AS resolved,
       ts AS detected_at
FROM events WHERE event_type = 'error'
"""

GATE_HISTORY = """
SELECT event_id AS id,
       concat('svc-', CAST(user_id % 10 AS STRING)) AS service_id,
       concat('v', CAST(event_id AS STRING)) AS version_sha,
       CASE WHEN event_id % 2 = 0 THEN 'production' ELSE 'staging' END AS target_env,
       CASE event_id % 5 WHEN 0 THEN 'DENY' WHEN 1 THEN 'OVERRIDE' ELSE 'ALLOW' END AS decision,
       CASE event_id % 5 WHEN 0 THEN 100 + event_id % 3 ELSE event_id % 11 END AS drift_score,
       ts AS decided_at
FROM events WHERE event_type = 'purchase'
"""

CONTRACTS = """
SELECT concat('con-', CAST(c_custkey AS STRING)) AS id,
       concat('svc-', CAST(c_custkey % 10 AS STRING)) AS provider_id,
       concat('svc-', CAST((c_custkey + 3) % 10 AS STRING)) AS consumer_id,
       CASE c_custkey % 5 WHEN 0 THEN '/api/click' WHEN 1 THEN '/api/error' WHEN 2 THEN '/api/purchase'
            WHEN 3 THEN '/api/signup' ELSE '/api/view' END AS endpoint,
       c_custkey % 13 AS version,
       CASE c_custkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'imported' ELSE 'inferred' END AS source,
       CASE c_custkey % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'archived' ELSE 'active' END AS status
FROM customer
"""

VIEWS = {
    "traffic_samples": TRAFFIC_SAMPLES,
    "deployments": DEPLOYMENTS,
    "violations": VIOLATIONS,
    "gate_history": GATE_HISTORY,
    "contracts": CONTRACTS,
}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain view as a DataFrame."""
    source = "customer" if name == "contracts" else "events"
    base(spark, sf_dir, source).createOrReplaceTempView(f"driftlake_{source}")
    return spark.sql(VIEWS[name].replace(f"FROM {source}", f"FROM driftlake_{source}"))


def with_views(*names: str) -> str:
    """The views as a leading WITH clause for the SQL oracle (no trailing comma)."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
