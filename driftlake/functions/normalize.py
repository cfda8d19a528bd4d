"""Masking of volatile payload parts and content hashing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.functions import deep_json

# Field names whose value changes on every request, and the placeholders.
VOLATILE_FIELDS = (
    "timestamp", "ts", "created_at", "updated_at", "traceId", "spanId", "requestId", "correlationId",
)
TIMESTAMP_PLACEHOLDER = "__NORMALIZED_TIMESTAMP__"
UUID_PLACEHOLDER = "__NORMALIZED_UUID__"
UUID_PATTERN = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def mask_uuid(text: Column) -> Column:
    return F.regexp_replace(text, UUID_PATTERN, UUID_PLACEHOLDER)


def content_hash(payload: Column) -> Column:
    """Hex SHA-256 of the UTF-8 payload."""
    return F.sha2(payload, 256)


@F.pandas_udf(T.StringType())
def _mask_volatile(bodies: pd.Series) -> pd.Series:
    names = frozenset(VOLATILE_FIELDS)

    def one(body):
        try:
            root = deep_json.loads(body)
        except ValueError:
            return body
        for node in deep_json.containers(root):
            if isinstance(node, dict):
                node.update(dict.fromkeys(names & node.keys(), TIMESTAMP_PLACEHOLDER))
        return deep_json.dumps(root)

    return bodies.map(one, na_action="ignore")


def normalize_document(body: Column) -> Column:
    """Whole-document form: volatile values masked, then every UUID in the text (keys too)."""
    return mask_uuid(_mask_volatile(body))
