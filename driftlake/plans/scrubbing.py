"""Queries on personal data and volatile parts of payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.functions import normalize as N
from driftlake.functions import scrub as P
from driftlake.functions.nodes import traffic_nodes
from driftlake.plans.catalog import query
from driftlake.plans.inference import NODES_SQL, TRAFFIC
from driftlake.plans.views import base, view

# The SSN rule without look-ahead: the excluded blocks are spelled out.
SSN_RE2 = (
    r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d{2}|6[0-57-9]\d|66[0-57-9])-(?:0[1-9]|[1-9]\d)-"
    r"(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
)


def _replace_all(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, label in rules:
        flags = "g"
        if pattern.startswith("(?i)"):
            pattern, flags = pattern[4:], "gi"
        column = f"regexp_replace({column}, '{pattern}', '{label}', '{flags}')"
    return column


def _text_rules_sql(column: str) -> str:
    rules = [(SSN_RE2 if kind == "SSN" else p, f"[REDACTED_{kind}]") for kind, p in P.TEXT_RULES]
    return _replace_all(column, rules)


@query("pii_scrub_text", f"SELECT doc_id, {_text_rules_sql('text')} AS text FROM documents")
def pii_scrub_text(spark, sf_dir):
    docs = base(spark, sf_dir, "documents")
    return docs.select("doc_id", P.scrub_text(F.col("text")).alias("text"))


@query("pii_scrub_conversations", f"SELECT conv_id, turn, {_text_rules_sql('text')} AS text FROM conversations")
def pii_scrub_conversations(spark, sf_dir):
    talks = base(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", P.scrub_text(F.col("text")).alias("text"))


@query(
    "pii_scrub_nodes",
    f"""SELECT sample_id, path, json_type, CASE WHEN json_type = 'string' THEN {_text_rules_sql('value_str')} ELSE value_str END AS value_str
        FROM nodes WHERE path <> ''""",
    TRAFFIC, NODES_SQL,
)
def pii_scrub_nodes(spark, sf_dir):
    flat = traffic_nodes(view(spark, sf_dir, "traffic_samples"), extra=["sample_id"]).filter("path <> ''")
    clean = F.when(F.col("json_type") == "string", P.scrub_text(F.col("value_str"))).otherwise(F.col("value_str"))
    return flat.select("sample_id", "path", "json_type", clean.alias("value_str"))


@query("pii_scrub_json", f"SELECT sample_id, {_text_rules_sql('body')} AS body FROM traffic_samples", TRAFFIC)
def pii_scrub_json(spark, sf_dir):
    """Whole documents; the fixture numbers are too short to look like personal data as text."""
    return view(spark, sf_dir, "traffic_samples").select("sample_id", P.scrub_json(F.col("body")).alias("body"))


@query(
    "pii_scrub_proxy",
    f"SELECT doc_id, {_replace_all('text', [(p, P.REDACTED) for p in P.PROXY_RULES])} AS text FROM documents",
)
def pii_scrub_proxy(spark, sf_dir):
    return base(spark, sf_dir, "documents").select("doc_id", P.scrub_proxy(F.col("text")).alias("text"))


_HEADER_NAMES = ("Authorization", "X-Api-Key", "Set-Cookie", "Accept", "X-Auth-Token")


@query(
    "header_redact",
    """SELECT event_id, unnest(['Authorization', 'X-Api-Key', 'Set-Cookie', 'Accept', 'X-Auth-Token']) AS name,
              unnest(['[REDACTED]', '[REDACTED]', '[REDACTED]', event_type, '[REDACTED]']) AS value FROM events""",
)
def header_redact(spark, sf_dir):
    pairs = [c for name in _HEADER_NAMES for c in (F.lit(name), F.col("event_type"))]
    events = base(spark, sf_dir, "events").select("event_id", F.create_map(*pairs).alias("headers"))
    return events.select("event_id", F.explode(P.redact_headers(F.col("headers"))).alias("name", "value"))


_UUIDS = """concat('{"id":"', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12),
  '","n":', CAST(event_id AS STRING), '}')"""


@query(
    "mask_uuid",
    """SELECT event_id, concat('{"id":"__NORMALIZED_UUID__","n":', CAST(event_id AS STRING), '}') AS payload FROM events""",
)
def mask_uuid(spark, sf_dir):
    hashed = base(spark, sf_dir, "events").withColumn("h", F.upper(F.md5(F.col("event_id").cast("string"))))
    return hashed.select("event_id", F.expr(_UUIDS).alias("payload")).withColumn("payload", N.mask_uuid(F.col("payload")))


@query("content_hash", "SELECT sample_id, sha256(body) AS content_hash FROM traffic_samples", TRAFFIC)
def content_hash(spark, sf_dir):
    samples = view(spark, sf_dir, "traffic_samples")
    return samples.select("sample_id", N.content_hash(F.col("body")).alias("content_hash"))


@query(
    "normalize_document",
    r"""SELECT sample_id, CASE WHEN json_valid(body) THEN regexp_replace(body, '"ts":\d+', '"ts":"__NORMALIZED_TIMESTAMP__"')
        ELSE body END AS body FROM traffic_samples""",
    TRAFFIC,
)
def normalize_document(spark, sf_dir):
    samples = view(spark, sf_dir, "traffic_samples")
    return samples.select("sample_id", N.normalize_document(F.col("body")).alias("body"))
