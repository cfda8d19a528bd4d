"""Removal of repeated payloads within a first-anchored period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.functions.normalize import content_hash, normalize_document
from driftlake.functions.scalars import micros
from driftlake.operators.anchors import FOLD_LIMIT, LEAF_ROWS, drop_repeats

PERIOD_SECONDS = 300


def with_hash(samples: DataFrame, body: str = "body", hash_on: str = "raw") -> DataFrame:
    """Add ``content_hash`` of the payload as captured, or of its normalized form."""
    payload = normalize_document(F.col(body)) if hash_on == "normalized" else F.col(body)
    return samples.withColumn("content_hash", content_hash(payload))


def dedup(
    samples: DataFrame,
    time: str = "sampled_at",
    row_id: str = "sample_id",
    seconds: int = PERIOD_SECONDS,
    fold_limit: int = FOLD_LIMIT,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Drop a sample while less than ``seconds`` passed since the kept one of its hash."""
    timed = samples.withColumn("t_us", micros(F.col(time)))
    kept = drop_repeats(timed, ["content_hash"], "t_us", row_id, seconds * 1_000_000, fold_limit, leaf_rows)
    return kept.drop("t_us")
