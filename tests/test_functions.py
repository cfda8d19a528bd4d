"""Scrubbing, normalizing, hashing and small functions."""

import json

import pytest
from pyspark.sql import functions as F

from driftlake.functions import normalize as N
from driftlake.functions import scalars as X
from driftlake.functions import scrub as P
from driftlake.functions.nodes import traffic_nodes


def apply(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("x 123-45-6789 000-11-2222", "x [REDACTED_SSN] 000-11-2222"),
        ("call +1 (415) 555-1212 or 415-555-1212 ok", "call +[REDACTED_PHONE] or[REDACTED_PHONE] ok"),
        ("Mail A.b@Ex-ample.COM!", "Mail [REDACTED_EMAIL]!"),
        ("4111111111111111 and 378282246310005", "[REDACTED_CREDIT_CARD] and [REDACTED_CREDIT_CARD]"),
        ("t eyJab.cd-e.f_g end", "t [REDACTED_JWT] end"),
        ("id 123e4567-e89b-12d3-a456-42661417400a", "id [REDACTED_UUID]"),
        ("sk-abcdefghijklmnopqrstuv", "[REDACTED_API_KEY]"),
        ("api_key=abcdefghijklmnop1", "[REDACTED_API_KEY]"),
        ("abcdefghijklmnopqrstuvwxyz0123456789", "[REDACTED_API_KEY]"),
        ("  ", "  "),
        (None, None),
    ],
)
def test_scrub_text(spark, text, want):
    got = apply(spark, text, P.scrub_text)
    assert got == want
    assert apply(spark, got, P.scrub_text) == want


def test_scrub_json(spark):
    body = {"a@b.co": "m x@y.io", "n": 4111111111111111, "l": ["x@y.io", {"k": "ok"}], "d": 1.5, "z": None}
    got = json.loads(apply(spark, json.dumps(body), P.scrub_json))
    assert got == {"a@b.co": "m [REDACTED_EMAIL]", "n": 4111111111111111, "l": ["[REDACTED_EMAIL]", {"k": "ok"}], "d": 1.5, "z": None}
    assert apply(spark, "{bad x@y.io", P.scrub_json) == "{bad [REDACTED_EMAIL]"
    assert apply(spark, '"x@y.io"', P.scrub_json) == '"x@y.io"'
    assert apply(spark, None, P.scrub_json) is None


def test_proxy_and_headers(spark):
    assert apply(spark, "Authorization: Bearer x@y.io 111-22-3333", P.scrub_proxy) == "[REDACTED] [REDACTED] [REDACTED]"
    headers = F.create_map(F.lit("X-API-Key"), F.lit("s"), F.lit("Cookie2"), F.lit("t"), F.lit("Accept"), F.lit("u"))
    got = spark.range(1).select(P.redact_headers(headers)).first()[0]
    assert got == {"X-API-Key": "[REDACTED]", "Cookie2": "[REDACTED]", "Accept": "u"}


def test_normalize_document(spark):
    uid = "123E4567-e89b-12d3-a456-426614174000"
    body = {"ts": {"deep": 1}, "a": [{"requestId": 5, "TS": 1}], uid: uid}
    got = json.loads(apply(spark, json.dumps(body), N.normalize_document))
    assert got == {"ts": N.TIMESTAMP_PLACEHOLDER, "a": [{"requestId": N.TIMESTAMP_PLACEHOLDER, "TS": 1}], N.UUID_PLACEHOLDER: N.UUID_PLACEHOLDER}
    assert apply(spark, f"bad {uid}", N.normalize_document) == f"bad {N.UUID_PLACEHOLDER}"


def test_normalize_nodes(spark):
    body = {"ts": {"deep": 1}, "a": [{"traceId": [1]}], "id": "123e4567-e89b-12d3-a456-426614174000"}
    rows = spark.createDataFrame([("s", "e", "m", json.dumps(body))], "service_id string, endpoint string, method string, body string")
    got = {r["path"]: r["value_str"] for r in traffic_nodes(rows, mask_volatile=True).collect()}
    assert got["ts"] == got["a[].traceId"] == N.TIMESTAMP_PLACEHOLDER and got["id"] == N.UUID_PLACEHOLDER
    assert "ts.deep" not in got and "a[].traceId[]" not in got


@pytest.mark.parametrize(
    "text, want",
    [("90m", 5400), ("24h", 86400), (" 2D ", 172800), ("", None), (None, None), ("xyz", 86400), ("1w", 86400)],
)
def test_window_seconds(spark, text, want):
    assert apply(spark, text, X.window_seconds) == want


def test_score_and_band(spark):
    row = spark.range(1).select(X.score(F.lit(2), F.lit(3), F.lit(4)).alias("s")).first()
    assert row["s"] == 234
    bands = [spark.range(1).select(X.score_band(F.lit(v))).first()[0] for v in (0, 1, 99, 100)]
    assert bands == ["green", "yellow", "yellow", "red"]
