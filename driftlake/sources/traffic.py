"""Traffic sources: topics, NDJSON files, wire records, release listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.functions.scalars import from_micros, not_blank
from driftlake.schemas import PROXY_SAMPLE, WIRE_SAMPLE

TOPIC = "raw-traffic"


def kafka_stream(spark: SparkSession, servers: str, topic: str = TOPIC, **options: str) -> DataFrame:
    """Records (key, value, headers, timestamp) of a topic from the earliest offset.

    Needs the Kafka source on the class path; the checkpoint of the query takes the place of acks.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", "earliest").option("includeHeaders", "true")
    return reader.options(**options).load()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str) -> DataFrame:
    """A folder of files as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def decode_envelope(records: DataFrame, headers: str = "headers", keep: Sequence[str] = ()) -> DataFrame:
    """Service, endpoint, method and payload of raw records, with the fallbacks of the consumer.

    ``headers`` is a map of strings; ``key`` and ``value`` are binary or string. Malformed UTF-8 is replaced.
    """
    def text(name: str) -> Column:
        kind = records.schema[name].dataType
        value = F.col(name).cast("string")
        return F.make_valid_utf8(value) if isinstance(kind, T.BinaryType) else value

    return records.select(
        *keep,
        F.coalesce(F.col(headers)["service_id"], text("key"), F.lit("unknown")).alias("service_id"),
        F.coalesce(F.col(headers)["endpoint"], F.lit("/unknown")).alias("endpoint"),
        F.coalesce(F.col(headers)["method"], F.lit("GET")).alias("method"),
        F.coalesce(text("value"), F.lit("{}")).alias("payload"),
    )


def header_map(headers: Column) -> Column:
    """Kafka's array of (key, binary value) as a map of strings; the last value of a name wins."""
    pairs = F.transform(headers, lambda h: F.struct(h["key"].alias("key"), F.make_valid_utf8(h["value"].cast("string")).alias("value")))
    named = F.filter(pairs, lambda p: p["key"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda p: p["key"]))
    last = F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(named, lambda p: p["key"] == n), -1)["value"]))
    return F.map_from_entries(last)


def from_millis(column: str) -> Column:
    """Epoch milliseconds as a time; null outside the years 1 to 9999."""
    inside = F.col(column).between(-62135596800000, 253402300799999)
    return F.when(inside, from_micros(F.try_multiply(F.when(inside, F.col(column)), F.lit(1000))))


def decode_wire(lines: DataFrame, value: str = "value") -> DataFrame:
    """Wire records (JSON text): defaults for absent schema samples, epoch milliseconds to times."""
    r = F.from_json(F.col(value), WIRE_SAMPLE)
    return lines.select(r.alias("r")).filter("r.service_id IS NOT NULL").select(
        "r.service_id", "r.endpoint", "r.method",
        F.coalesce("r.request_schema_sample", F.lit("")).alias("request_schema_sample"),
        F.coalesce("r.response_schema_sample", F.lit("")).alias("response_schema_sample"),
        "r.status_code",
        from_millis("r.timestamp").alias("captured_at"),
        from_millis("r.sampled_at").alias("sampled_at"),
    )


def parse_ndjson(lines: DataFrame, value: str = "value") -> DataFrame:
    """Proxy samples from lines of JSON; blank and unparsable lines are skipped, a malformed time is null."""
    bad = F.col("s._corrupt_record").isNotNull()
    sample = F.from_json(F.trim(F.col(value)), PROXY_SAMPLE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    names = [f for f in PROXY_SAMPLE.names if f not in ("timestamp", "_corrupt_record")]
    return (
        lines.filter(not_blank(F.col(value))).select(sample.alias("s"))
        .filter(F.col("s").isNotNull() & ~bad)
        .select(F.try_to_timestamp(F.col("s.timestamp")).cast("timestamp_ntz").alias("sampled_at"), *[f"s.{n}" for n in names])
    )


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return parse_ndjson(spark.read.text(path))


def validate(samples: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): service, endpoint and method must not be blank; a missing time is ``as_of``."""
    ok = not_blank(F.col("service_id")) & not_blank(F.col("endpoint")) & not_blank(F.col("method"))
    timed = samples.withColumn("sampled_at", F.coalesce("sampled_at", as_of))
    return timed.filter(ok), samples.filter(~ok)


def deployments_from_releases(releases: DataFrame) -> DataFrame:
    """Deployments from polled release listings (repo, release JSON, polled_at).

    A release shows up in many polls; it becomes one deployment, first seen at its earliest poll.
    """
    release = F.from_json("release", "tag_name string, name string")
    return (
        releases.select("repo", release.alias("r"), "polled_at")
        .filter("r.tag_name IS NOT NULL")
        .groupBy(F.col("repo").alias("service_id"), F.col("r.tag_name").alias("version_sha"))
        .agg(F.min("polled_at").alias("deployed_at"), F.min_by("r.name", F.struct("polled_at", "r.name")).alias("metadata"))
        .select(
            F.concat_ws(":", "service_id", "version_sha").alias("deployment_id"), "service_id", "version_sha",
            F.lit("production").alias("environment"), "deployed_at", F.lit("GITHUB_RELEASE").alias("source"), "metadata",
        )
    )
