"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the drift score and its colour bands.
SCORE_WEIGHTS = {"BREAKING": 100, "WARNING": 10, "ADDITIVE": 1}
DEFAULT_WINDOW_SECONDS = 24 * 3600


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column, like: str = "timestamp_ntz") -> Column:
    return F.timestamp_micros(us).cast(like)


def window_seconds(text: Column) -> Column:
    """``90m`` / ``24h`` / ``2d`` as seconds; empty or null means since the epoch (null here);
    anything else, and a window too long to count, means 24 hours.
    """
    t = F.lower(F.trim(text))
    unit = F.substring(t, -1, 1)
    number = F.regexp_extract(t, r"^\s*(\d+)\s*[mhd]$", 1)
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("bigint"))
        .otherwise(F.coalesce(F.try_multiply(number.try_cast("bigint"), seconds.cast("bigint")), F.lit(DEFAULT_WINDOW_SECONDS).cast("bigint")))
    )


def score(breaking: Column, warning: Column, additive: Column) -> Column:
    return (
        SCORE_WEIGHTS["BREAKING"] * breaking
        + SCORE_WEIGHTS["WARNING"] * warning
        + SCORE_WEIGHTS["ADDITIVE"] * additive
    )


def score_band(value: Column) -> Column:
    return F.when(value < 1, "green").when(value < 100, "yellow").otherwise("red")


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def endpoint_with_query(path: Column, query: Column) -> Column:
    return F.when(query.isNotNull(), F.concat(path, F.lit("?"), query)).otherwise(path)
