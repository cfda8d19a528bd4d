"""Queries on payload structure: flatten, statistics, inference, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions import nodes as N
from driftlake.functions.nodes import TRAFFIC_KEYS, json_nodes, parse_objects, traffic_nodes
from driftlake.functions.scalars import score_band
from driftlake.operators import contracts as C
from driftlake.operators import diff as D
from driftlake.operators import infer as I
from driftlake.operators import stats as S
from driftlake.operators.metrics import drift_ranking
from driftlake.plans.catalog import query
from driftlake.plans.views import view
from driftlake.sources.sinks import event_records

KEYS = list(TRAFFIC_KEYS)
TRAFFIC = ("traffic_samples",)

# The contract every (service, endpoint, method) of the fixture traffic is checked against.
BASELINE_CONTRACT = """{"type": "object",
 "required": ["order_id", "amount", "currency", "items", "user", "note"],
 "properties": {
  "order_id": {"type": "string"}, "amount": {"type": "number"}, "currency": {"type": "string"},
  "items": {"type": "array", "items": {"type": "string"}},
  "user": {"type": "object", "required": ["name", "email"],
           "properties": {"name": {"type": "string"}, "email": {"type": "string"}}},
  "note": {"type": "string"}, "legacy_id": {"type": "string"}}}"""

NODES_SQL = r"""
valid AS (SELECT * FROM traffic_samples WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
tree AS (
  SELECT v.service_id, v.endpoint, v.method, v.sample_id, v.sampled_at, j.type AS jt, j.value AS jv,
         regexp_replace(regexp_replace(j.fullkey, '\[\d+\]', '[]', 'g'), '^\$\.?', '') AS path
  FROM valid v, json_tree(v.body) j),
nodes AS (
  SELECT service_id, endpoint, method, sample_id, sampled_at, path,
         regexp_replace(path, '(\[\]|\.?[^.\[\]]+)$', '') AS parent_path,
         ends_with(path, '[]') AS is_item, contains(path, '[]') AS in_array,
         CASE WHEN jt IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN jt = 'DOUBLE' THEN 'number'
              WHEN jt = 'VARCHAR' THEN 'string' ELSE lower(jt) END AS json_type,
         CASE WHEN jt = 'OBJECT' THEN NULL ELSE jv ->> '$' END AS value_str
  FROM tree)"""

STATS_SQL = NODES_SQL + """,
stats AS (
  SELECT service_id, endpoint, method, path, any_value(parent_path) AS parent_path, bool_or(is_item) AS is_item,
         bool_or(in_array) AS in_array, count(*) AS n,
         count(*) FILTER (json_type = 'integer') AS n_integer, count(*) FILTER (json_type = 'number') AS n_number,
         count(*) FILTER (json_type = 'string') AS n_string, count(*) FILTER (json_type = 'boolean') AS n_boolean,
         count(*) FILTER (json_type = 'null') AS n_null, count(*) FILTER (json_type = 'array') AS n_array,
         count(*) FILTER (json_type = 'object') AS n_object
  FROM nodes GROUP BY ALL),
totals AS (SELECT service_id, endpoint, method, n AS total FROM stats WHERE path = ''),
leaf AS (
  SELECT s.*, t.total, s.n - s.n_object AS present,
         greatest(n_integer, n_number, n_string, n_boolean, n_null, n_array) AS top
  FROM stats s JOIN totals t USING (service_id, endpoint, method) WHERE path <> '')"""

OBSERVED_SQL = """concat_ws(',',
  CASE WHEN n_array > 0 THEN 'array' END, CASE WHEN n_boolean > 0 THEN 'boolean' END,
  CASE WHEN n_integer > 0 THEN 'integer' END, CASE WHEN n_null > 0 THEN 'null' END,
  CASE WHEN n_number > 0 THEN 'number' END, CASE WHEN n_string > 0 THEN 'string' END)"""

SCHEMA_SQL = STATS_SQL + f""",
schema AS (
  SELECT l.service_id, l.endpoint, l.method, l.path, l.n, l.total,
    CASE WHEN NOT l.in_array AND l.n_object = 0 AND top < present AND top * 1.0 / present >= 0.95
              AND (l.n_integer = top OR l.n_number = top) THEN 'number'
         WHEN l.n = l.n_null THEN 'null'
         ELSE concat_ws('|',
           CASE WHEN l.n_array > 0 THEN 'array' END, CASE WHEN l.n_boolean > 0 THEN 'boolean' END,
           CASE WHEN l.n_integer > 0 AND l.n_number = 0 THEN 'integer' END, CASE WHEN l.n_number > 0 THEN 'number' END,
           CASE WHEN l.n_object > 0 THEN 'object' END, CASE WHEN l.n_string > 0 THEN 'string' END) END AS type,
    NOT l.is_item AND l.n = p.n_object AS required, l.n_null > 0 AS nullable,
    NOT l.in_array AND present > 0 AND present * 1.0 / l.total < 0.8 AS optional,
    CASE WHEN NOT l.in_array AND present > 0 AND top < present AND top * 1.0 / present >= 0.95
         THEN {OBSERVED_SQL.replace('n_', 'l.n_')} END AS observed_types
  FROM leaf l JOIN stats p ON p.service_id = l.service_id AND p.endpoint = l.endpoint AND p.method = l.method
       AND p.path = l.parent_path)"""

ENUM_SQL = """,
enums AS (
  SELECT service_id, endpoint, method, path, total, array_to_string(list_sort(list(DISTINCT value_str)), ',') AS enum_values
  FROM nodes JOIN totals USING (service_id, endpoint, method)
  WHERE NOT in_array AND path <> '' AND json_type NOT IN ('object', 'null') AND total >= 100
  GROUP BY ALL HAVING count(DISTINCT value_str) BETWEEN 2 AND 20)""".replace(
    "total, array_to_string", "any_value(total) AS total, array_to_string"
).replace("GROUP BY ALL", "GROUP BY service_id, endpoint, method, path")

BASELINE_SQL = """,
baseline AS (
  SELECT service_id, endpoint, method, b.* FROM (SELECT DISTINCT service_id, endpoint, method FROM traffic_samples),
    (VALUES ('order_id', 'string', true), ('amount', 'number', true), ('currency', 'string', true), ('items', 'array', true),
            ('items[]', 'string', false), ('user', 'object', true), ('user.name', 'string', true),
            ('user.email', 'string', true), ('note', 'string', true), ('legacy_id', 'string', false)) b(path, type, required))"""

COMPARED_SQL = SCHEMA_SQL + BASELINE_SQL + """,
matched AS (SELECT DISTINCT service_id, endpoint, method FROM schema INTERSECT SELECT DISTINCT service_id, endpoint, method FROM baseline),
compared AS (
  SELECT service_id, endpoint, method, path, b.path IS NOT NULL AS in_baseline, i.path IS NOT NULL AS in_inferred,
    CASE WHEN i.path IS NULL AND b.required THEN 'BREAKING' WHEN i.path IS NULL THEN 'WARNING'
         WHEN b.path IS NULL AND i.required THEN 'BREAKING' WHEN b.path IS NULL THEN 'ADDITIVE'
         WHEN b.required AND NOT i.required THEN 'BREAKING'
         WHEN b.type = 'integer' AND i.type = 'number' THEN 'ADDITIVE'
         WHEN b.type <> i.type THEN 'BREAKING'
         WHEN i.nullable THEN 'WARNING' END AS severity,
    CASE WHEN i.path IS NULL AND b.required THEN 'Required field removed: ' WHEN i.path IS NULL THEN 'Optional field removed: '
         WHEN b.path IS NULL AND i.required THEN 'New required field added: ' WHEN b.path IS NULL THEN 'New optional field added: '
         WHEN b.required AND NOT i.required THEN 'Required field made optional: '
         WHEN b.type <> i.type THEN 'Field type changed from ' || b.type || ' to ' || i.type || ': '
         WHEN i.nullable THEN 'Response schema now nullable: ' END || path AS description
  FROM baseline b FULL JOIN schema i USING (service_id, endpoint, method, path)
  SEMI JOIN matched USING (service_id, endpoint, method)),
scores AS (
  SELECT service_id, endpoint, method, count(*) FILTER (in_baseline) AS baseline_fields, count(*) FILTER (in_inferred) AS inferred_fields,
    count(*) FILTER (severity = 'BREAKING') AS breaking, count(*) FILTER (severity = 'WARNING') AS warning,
    count(*) FILTER (severity = 'ADDITIVE') AS additive,
    100 * count(*) FILTER (severity = 'BREAKING') + 10 * count(*) FILTER (severity = 'WARNING')
      + count(*) FILTER (severity = 'ADDITIVE') AS drift_score
  FROM compared GROUP BY ALL)"""
KEYS_SQL = "service_id, endpoint, method"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "traffic_samples")


def nodes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return traffic_nodes(samples(spark, sf_dir), **options)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.path_stats(nodes(spark, sf_dir, values=False))


def inferred(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return I.schema_nodes(stats(spark, sf_dir), **options)


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = samples(spark, sf_dir).select(*KEYS).distinct().withColumn("schema_json", F.lit(BASELINE_CONTRACT))
    return C.contract_to_nodes(contracts, KEYS, with_root=True, nested_items=True)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.compare(baseline(spark, sf_dir), inferred(spark, sf_dir, with_root=True), KEYS)


@query("valid_samples", "SELECT sample_id, service_id FROM valid", TRAFFIC, NODES_SQL)
def valid_samples(spark, sf_dir):
    return parse_objects(samples(spark, sf_dir)).select("sample_id", "service_id")


@query("json_flatten", "SELECT sample_id, path, json_type, value_str FROM nodes", TRAFFIC, NODES_SQL)
def json_flatten(spark, sf_dir):
    return nodes(spark, sf_dir, extra=["sample_id"]).select("sample_id", "path", "json_type", "value_str")


@query(
    "normalize_nodes",
    """SELECT sample_id, path, CASE WHEN path = 'ts' THEN 'string' ELSE json_type END AS json_type,
       CASE WHEN path = 'ts' THEN '__NORMALIZED_TIMESTAMP__' ELSE value_str END AS value_str FROM nodes""",
    TRAFFIC, NODES_SQL,
)
def normalize_nodes(spark, sf_dir):
    flat = nodes(spark, sf_dir, extra=["sample_id"], mask_volatile=True)
    return flat.select("sample_id", "path", "json_type", "value_str")


@query("depth_overflow", f"SELECT {KEYS_SQL}, CAST(0 AS BIGINT) AS truncated_nodes FROM valid GROUP BY ALL", TRAFFIC, NODES_SQL)
def depth_overflow(spark, sf_dir):
    return N.depth_overflow(nodes(spark, sf_dir, values=False))


@query(
    "field_presence",
    f"""SELECT {KEYS_SQL}, path, present, total, CAST(present AS DOUBLE) / total AS ratio
        FROM leaf WHERE NOT in_array AND present > 0""",
    TRAFFIC, STATS_SQL,
)
def field_presence(spark, sf_dir):
    return S.field_presence(stats(spark, sf_dir))


@query(
    "type_histogram",
    f"SELECT {KEYS_SQL}, path, n_integer, n_number, n_string, n_boolean, n_null, n_array, n_object FROM stats",
    TRAFFIC, STATS_SQL,
)
def type_histogram(spark, sf_dir):
    return stats(spark, sf_dir).select(*KEYS, "path", *S.COUNT_COLS[1:])


@query(
    "merge_stats",
    f"SELECT {KEYS_SQL}, path, n, n_integer, n_number, n_string, n_null FROM stats",
    TRAFFIC, STATS_SQL,
)
def merge_stats(spark, sf_dir):
    daily = traffic_nodes(samples(spark, sf_dir).withColumn("day", F.to_date("sampled_at")), extra=["day"], values=False)
    merged = S.merge_stats(S.path_stats(daily, [*KEYS, "day"]))
    return merged.select(*KEYS, "path", "n", "n_integer", "n_number", "n_string", "n_null")


@query(
    "value_cardinality",
    f"""SELECT {KEYS_SQL}, path, count(DISTINCT value_str) AS n_values FROM nodes
        WHERE NOT in_array AND path <> '' AND json_type NOT IN ('object', 'null') GROUP BY ALL""",
    TRAFFIC, NODES_SQL,
)
def value_cardinality(spark, sf_dir):
    return S.value_cardinality(nodes(spark, sf_dir))


@query(
    "optional_fields",
    f"""SELECT {KEYS_SQL}, path, present, total, CAST(present AS DOUBLE) / total AS ratio
        FROM leaf WHERE NOT in_array AND present > 0 AND CAST(present AS DOUBLE) / total < 0.8""",
    TRAFFIC, STATS_SQL,
)
def optional_fields(spark, sf_dir):
    return S.optional_fields(stats(spark, sf_dir))


@query("enum_detect", f"SELECT {KEYS_SQL}, path, total, enum_values FROM enums", TRAFFIC, STATS_SQL + ENUM_SQL)
def enum_detect(spark, sf_dir):
    return S.enum_values(nodes(spark, sf_dir)).withColumn("enum_values", F.array_join("enum_values", ","))


@query(
    "probabilistic_types",
    f"""SELECT {KEYS_SQL}, path,
          CASE top WHEN n_integer THEN 'integer' WHEN n_number THEN 'number' WHEN n_string THEN 'string'
                   WHEN n_boolean THEN 'boolean' WHEN n_null THEN 'null' ELSE 'array' END AS dominant_type,
          {OBSERVED_SQL} AS observed_types
        FROM leaf WHERE NOT in_array AND present > 0 AND top < present AND top * 1.0 / present >= 0.95""",
    TRAFFIC, STATS_SQL,
)
def probabilistic_types(spark, sf_dir):
    return S.probabilistic_types(stats(spark, sf_dir)).withColumn("observed_types", F.array_join("observed_types", ","))


@query("required_fields", f"SELECT {KEYS_SQL}, path FROM schema WHERE required", TRAFFIC, SCHEMA_SQL)
def required_fields(spark, sf_dir):
    return inferred(spark, sf_dir).filter("required").select(*KEYS, "path")


@query("merged_types", f"SELECT {KEYS_SQL}, path, type, nullable FROM schema", TRAFFIC, SCHEMA_SQL)
def merged_types(spark, sf_dir):
    return inferred(spark, sf_dir).select(*KEYS, "path", "type", "nullable")


@query("array_item_types", f"SELECT {KEYS_SQL}, path, type, n FROM schema WHERE contains(path, '[]')", TRAFFIC, SCHEMA_SQL)
def array_item_types(spark, sf_dir):
    return inferred(spark, sf_dir).filter(F.contains("path", F.lit("[]"))).select(*KEYS, "path", "type", "n")


@query(
    "infer_contract",
    f"""SELECT {KEYS_SQL}, path, type, required, nullable, optional, observed_types, enum_values AS enum_suggestion, n, schema.total
        FROM schema LEFT JOIN enums USING (service_id, endpoint, method, path)""",
    TRAFFIC, SCHEMA_SQL + ENUM_SQL,
)
def infer_contract(spark, sf_dir):
    found = I.schema_nodes(S.path_stats(nodes(spark, sf_dir), values=True))
    return found.select(
        *KEYS, "path", "type", "required", "nullable", "optional", F.array_join("observed_types", ",").alias("observed_types"),
        F.array_join("enum_suggestion", ",").alias("enum_suggestion"), "n", "total",
    )


_KINDS = ", ".join(
    f"CASE WHEN n_{t} > 0{' AND n_number = 0' if t == 'integer' else ''} THEN '{t}' END" for t in ("array", "boolean", "integer", "null", "number", "object", "string")
)


@query(
    "infer_contract_unions",
    f"""SELECT {KEYS_SQL}, path, CASE WHEN NOT in_array AND n_object = 0 AND top < present AND top * 1.0 / present >= 0.95 AND (n_integer = top OR n_number = top) THEN 'number'
          WHEN len(kinds) = 1 THEN kinds[1] ELSE '' END AS type, false AS nullable
        FROM (SELECT *, list_filter([{_KINDS}], lambda x: x IS NOT NULL) AS kinds FROM leaf)""",
    TRAFFIC, STATS_SQL,
)
def infer_contract_unions(spark, sf_dir):
    """Types with unions written as an empty type, and null as a type of its own."""
    return inferred(spark, sf_dir, union_mode="reference").select(*KEYS, "path", "type", "nullable")


@query("infer_document")
def infer_document(spark, sf_dir):
    found = I.schema_nodes(S.path_stats(nodes(spark, sf_dir), values=True))
    return I.schema_documents(found, expected=samples(spark, sf_dir))


@query("schema_diff", f"SELECT {KEYS_SQL}, path, severity, description FROM compared WHERE severity IS NOT NULL", TRAFFIC, COMPARED_SQL)
def schema_diff(spark, sf_dir):
    return D.schema_diff(baseline(spark, sf_dir), inferred(spark, sf_dir, with_root=True), KEYS)


@query("drift_score", f"SELECT {KEYS_SQL}, drift_score FROM scores", TRAFFIC, COMPARED_SQL)
def drift_score(spark, sf_dir):
    return D.drift_scores(compared(spark, sf_dir), KEYS).select(*KEYS, "drift_score")


@query("drift_counts", "SELECT * FROM scores", TRAFFIC, COMPARED_SQL)
def drift_counts(spark, sf_dir):
    return D.drift_scores(compared(spark, sf_dir), KEYS)


@query(
    "drift_score_band",
    f"""SELECT {KEYS_SQL}, drift_score, CASE WHEN drift_score < 1 THEN 'green' WHEN drift_score < 100 THEN 'yellow'
        ELSE 'red' END AS band FROM scores""",
    TRAFFIC, COMPARED_SQL,
)
def drift_score_band(spark, sf_dir):
    return drift_score(spark, sf_dir).withColumn("band", score_band(F.col("drift_score")))


@query("drift_ranking", f"SELECT {KEYS_SQL}, drift_score FROM scores ORDER BY drift_score DESC", TRAFFIC, COMPARED_SQL)
def ranking(spark, sf_dir):
    return drift_ranking(drift_score(spark, sf_dir))


@query(
    "drift_events",
    f"""SELECT service_id || ':' || endpoint || ':' || method AS contract_id, count(*) AS n_violations,
        string_agg(severity || ' ' || path, ';' ORDER BY path) AS summary,
        any_value(drift_score) AS drift_score
        FROM compared JOIN scores USING (service_id, endpoint, method) WHERE severity IS NOT NULL
        GROUP BY service_id, endpoint, method""",
    TRAFFIC, COMPARED_SQL,
)
def drift_events(spark, sf_dir):
    events = D.drift_events(schema_diff(spark, sf_dir), KEYS).withColumn("contract_id", F.concat_ws(":", *KEYS))
    back = F.from_json("value", "drift_score bigint, violations array<struct<path:string,severity:string>>").alias("v")
    return event_records(events).select(F.col("key").alias("contract_id"), back).select(
        "contract_id", F.size("v.violations").cast("bigint").alias("n_violations"),
        F.array_join(F.transform("v.violations", lambda x: F.concat_ws(" ", x["severity"], x["path"])), ";").alias("summary"),
        "v.drift_score",
    )


@query(
    "path_union",
    f"SELECT {KEYS_SQL}, path FROM baseline UNION SELECT {KEYS_SQL}, path FROM schema",
    TRAFFIC, SCHEMA_SQL + BASELINE_SQL,
)
def path_union(spark, sf_dir):
    return D.path_union(baseline(spark, sf_dir), inferred(spark, sf_dir), KEYS)


@query(
    "paths_removed",
    f"SELECT {KEYS_SQL}, path FROM baseline EXCEPT SELECT {KEYS_SQL}, path FROM schema",
    TRAFFIC, SCHEMA_SQL + BASELINE_SQL,
)
def paths_removed(spark, sf_dir):
    return D.paths_missing(baseline(spark, sf_dir), inferred(spark, sf_dir), KEYS)


@query(
    "paths_added",
    f"SELECT {KEYS_SQL}, path FROM schema EXCEPT SELECT {KEYS_SQL}, path FROM baseline",
    TRAFFIC, SCHEMA_SQL + BASELINE_SQL,
)
def paths_added(spark, sf_dir):
    return D.paths_missing(inferred(spark, sf_dir), baseline(spark, sf_dir), KEYS)


# A declared contract whose currency list differs from the traffic by one value each way.
ENUM_CONTRACT = """{"properties": {"currency": {"type": "string", "enum": ["USD", "EUR", "JPY"]}, "zip": {"enum": [1, 2]}}}"""


@query(
    "enum_drift",
    f"""SELECT {KEYS_SQL}, e.path, array_to_string(list_sort([x for x in d.declared if NOT list_contains(string_split(enum_values, ','), x)]), ',') AS removed,
          array_to_string(list_sort([x for x in string_split(enum_values, ',') if NOT list_contains(d.declared, x)]), ',') AS added
        FROM enums e JOIN (VALUES ('currency', ['USD', 'EUR', 'JPY']), ('zip', ['1', '2'])) d(path, declared) ON e.path = d.path
        WHERE list_sort(string_split(enum_values, ',')) <> list_sort(d.declared)""",
    TRAFFIC, STATS_SQL + ENUM_SQL,
)
def enum_drift(spark, sf_dir):
    """Declared enum values against the values seen in traffic."""
    declared = samples(spark, sf_dir).select(*KEYS).distinct().withColumn("schema_json", F.lit(ENUM_CONTRACT))
    out = D.enum_drift(C.contract_to_nodes(declared, KEYS), S.enum_values(nodes(spark, sf_dir)), KEYS)
    return out.withColumns({c: F.array_join(c, ",") for c in ("removed", "added")})


# only the first and the last document of each (service, endpoint) are taken apart
_DOC_SQL = NODES_SQL.replace(
    "valid AS (SELECT * FROM traffic_samples WHERE json_valid(body) AND json_type(body) = 'OBJECT')",
    """proper AS MATERIALIZED (SELECT * FROM traffic_samples WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
firsts AS MATERIALIZED (SELECT arg_min(sample_id, sampled_at) AS old_id, arg_max(sample_id, sampled_at) AS new_id FROM proper GROUP BY service_id, endpoint),
valid AS MATERIALIZED (SELECT * FROM proper WHERE sample_id IN (SELECT old_id FROM firsts UNION ALL SELECT new_id FROM firsts))""",
) + ", " + ", ".join(
    f"{n} AS MATERIALIZED (SELECT service_id, endpoint, path, value_str FROM nodes WHERE NOT in_array AND json_type <> 'object' "
    f"AND sample_id IN (SELECT {n}_id FROM firsts))"
    for n in ("old", "new")
) + """, lines AS (
  SELECT service_id, endpoint, path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added'
         WHEN o.value_str IS NOT DISTINCT FROM n.value_str THEN 'unchanged' ELSE 'changed' END AS change,
         o.value_str AS old_value, n.value_str AS new_value
  FROM old o FULL JOIN new n USING (service_id, endpoint, path))"""


def _document_lines(spark, sf_dir):
    """First against last payload of each (service, endpoint)."""
    keys = ["service_id", "endpoint"]
    ends = parse_objects(samples(spark, sf_dir)).groupBy(*keys).agg(
        F.min_by("body", "sampled_at").alias("old"), F.max_by("body", "sampled_at").alias("new")
    )

    def leaves(column: str) -> DataFrame:
        flat = json_nodes(parse_objects(ends.select(*keys, F.col(column).alias("body"))), keys)
        return flat.filter("NOT in_array AND json_type <> 'object'")

    return D.doc_diff(leaves("old"), leaves("new"), keys), keys


@query("doc_diff", "SELECT * FROM lines", TRAFFIC, _DOC_SQL)
def doc_diff(spark, sf_dir):
    return _document_lines(spark, sf_dir)[0]


@query(
    "doc_severity",
    """SELECT service_id, endpoint, CASE WHEN bool_or(change = 'removed') THEN 'BREAKING' WHEN bool_or(change = 'changed') THEN 'WARNING'
       ELSE 'ADDITIVE' END AS severity FROM lines GROUP BY ALL""",
    TRAFFIC, _DOC_SQL,
)
def doc_severity(spark, sf_dir):
    return D.doc_severity(*_document_lines(spark, sf_dir))


@query(
    "infer_window_10m",
    f"""SELECT {KEYS_SQL}, time_bucket(INTERVAL 10 MINUTE, sampled_at) AS window_start, path, count(*) AS n,
        count(*) FILTER (json_type = 'integer') AS n_integer, count(*) FILTER (json_type = 'string') AS n_string,
        count(*) FILTER (json_type = 'null') AS n_null FROM nodes GROUP BY ALL""",
    TRAFFIC, NODES_SQL,
)
def infer_window_10m(spark, sf_dir):
    start = F.window("sampled_at", "10 minutes").start
    windowed = samples(spark, sf_dir).withColumn("window_start", start)
    counted = S.path_stats(traffic_nodes(windowed, extra=["window_start"], values=False), [*KEYS, "window_start"])
    return counted.select(*KEYS, "window_start", "path", "n", "n_integer", "n_string", "n_null")
