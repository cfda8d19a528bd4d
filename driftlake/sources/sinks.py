"""Sinks: keyed JSON records, raw samples by date, drift events, audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions.normalize import content_hash, normalize_document
from driftlake.schemas import RAW_SAMPLE


def keyed_json(df: DataFrame, key: Sequence[str], separator: str = ":") -> DataFrame:
    """Records (key, value) for a topic: joined key columns and the row as JSON."""
    return df.select(F.concat_ws(separator, *key).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka(records: DataFrame, servers: str, topic: str) -> None:
    """Publish keyed records; needs the Kafka sink on the class path."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def raw_samples(samples: DataFrame, body: str = "body", time: str = "sampled_at") -> DataFrame:
    """Rows of the replay store: normalized payload, hash of the raw payload, ingestion date."""
    out = samples.select(
        "service_id", "endpoint", "method", normalize_document(F.col(body)).alias("normalized_payload"),
        content_hash(F.col(body)).alias("content_hash"), F.col(time).alias("ingested_at"), F.to_date(time).alias("ingest_date"),
    )
    return out.select(*RAW_SAMPLE.names)


def write_raw_samples(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Files per date, sorted by service and time inside, so a replay reads few row groups.

    Rows go to the writers as they are partitioned: a shuffle by date would send a day to one task.
    """
    ordered = rows.sortWithinPartitions("ingest_date", "service_id", "ingested_at")
    ordered.write.mode(mode).partitionBy("ingest_date").parquet(path)


def replay(rows: DataFrame, start: Column, end: Column, time: str = "ingested_at", date: str | None = "ingest_date") -> DataFrame:
    """Samples with ``start <= time <= end``, newest first; the date bound prunes partitions."""
    if date is not None:
        rows = rows.filter(F.col(date).between(F.to_date(start), F.to_date(end)))
    return rows.filter(F.col(time).between(start, end)).orderBy(F.desc(time))


def read_raw_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SAMPLE).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Append audit rows or violations to a table folder."""
    rows.write.mode("append").parquet(path)


def event_records(events: DataFrame, key: str = "contract_id") -> DataFrame:
    """Drift events (at least one violation) keyed by contract."""
    return keyed_json(events.filter(F.size("violations") > 0), [key])
