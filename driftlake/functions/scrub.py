"""Personal-data scrubbing of text, headers and JSON documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.functions import deep_json

# The redaction rules, in the order they are applied.
TEXT_RULES = [
    ("EMAIL", r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    (
        "CREDIT_CARD",
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    ),
    ("SSN", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"),
    ("JWT", r"eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+"),
    ("PHONE", r"\b\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    (
        "API_KEY",
        r"\b(?:sk-[a-zA-Z0-9]{20,}|api[-_]?key[-_]?[=:][\s]*[a-zA-Z0-9]{16,}|[a-zA-Z0-9]{32,64})\b",
    ),
]

# The rules of the proxy-side scrubber.
PROXY_RULES = [
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14})\b",
    r"(?i)(authorization|auth-token|api-key)\s*[:=]\s*\S+",
]
SECRET_HEADERS = r"(?i)authorization|auth-token|api-key|cookie|set-cookie"
REDACTED = "[REDACTED]"


def scrub_text(text: Column) -> Column:
    """Replace each kind of personal data by ``[REDACTED_<kind>]``; null and blank stay as they are."""
    for kind, pattern in TEXT_RULES:
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind}]")
    return text


def scrub_proxy(text: Column) -> Column:
    for pattern in PROXY_RULES:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def redact_headers(headers: Column) -> Column:
    """Blank out the values of headers whose name carries a credential."""
    return F.transform_values(
        headers, lambda name, value: F.when(name.rlike(SECRET_HEADERS), F.lit(REDACTED)).otherwise(value)
    )


@F.pandas_udf(T.StringType())
def scrub_json(bodies: pd.Series) -> pd.Series:
    """Scrub the string values of whole JSON documents; anything else is scrubbed as text.

    Keys, numbers and a bare root string stay untouched. Use it where the rewritten document
    is wanted; the node table needs only :func:`scrub_text` on ``value_str``.
    """
    # re.ASCII gives \b, \d and \s the meaning they have in the JVM patterns
    rules = [(re.compile(p, re.ASCII), f"[REDACTED_{kind}]") for kind, p in TEXT_RULES]

    def plain(text):
        for pattern, label in rules:
            text = pattern.sub(label, text)
        return text

    def one(body):
        if body is None or not body.strip():
            return body
        try:
            root = deep_json.loads(body)
        except ValueError:
            return plain(body)
        for node in deep_json.containers(root):
            for k, v in node.items() if isinstance(node, dict) else enumerate(node):
                if isinstance(v, str):
                    node[k] = plain(v)
        return deep_json.dumps(root)

    return bodies.map(one, na_action="ignore")
