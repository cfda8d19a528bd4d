"""Ingestion as one stream: decoded samples are checked, hashed, cleared of repeats, normalized and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlake.functions.normalize import normalize_document
from driftlake.functions.scalars import not_blank
from driftlake.operators.dedup import with_hash
from driftlake.session import state_partitions
from driftlake.streaming.dedup import WATERMARK, dedup_stream


def ingest(
    samples: DataFrame, out_path: str, reject_path: str, checkpoint: str, hash_on: str = "raw", row_id: str = "sample_id",
    seconds: int = 300, watermark: str = WATERMARK, trigger: dict | None = None,
) -> StreamingQuery:
    """Store new samples (``row_id``, service_id, endpoint, method, body, sampled_at) in the replay table, invalid ones beside it.

    Samples without service, endpoint, method or time take no part in the dedup: they get a hash of their own and meet the
    others again in the sink. Every batch writes folders of its own (``batch=<n>/ingest_date=<d>``), so a batch that is
    run again after a failure replaces what it wrote, and a restarted query goes on with the state of the checkpoint.
    """
    valid = not_blank(F.col("service_id")) & not_blank(F.col("endpoint")) & not_blank(F.col("method"))
    hashed = with_hash(samples.filter(F.col("sampled_at").isNotNull()), hash_on=hash_on).withColumn("valid", F.coalesce(valid, F.lit(False)))
    own = F.concat(F.lit("invalid "), F.col(row_id).cast("string"))
    hashed = hashed.withColumn("content_hash", F.when(F.col("valid"), F.col("content_hash")).otherwise(own))
    kept = dedup_stream(hashed, "content_hash", "sampled_at", row_id, seconds, watermark)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            fine = batch.filter("valid")
            ordered = _stored(fine, row_id).sortWithinPartitions("ingest_date", "service_id", "ingested_at")
            ordered.write.mode("overwrite").partitionBy("ingest_date").parquet(f"{out_path}/batch={batch_id}")
            batch.filter("NOT valid").drop("valid", "content_hash").write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    with state_partitions(samples.sparkSession):
        return kept.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _stored(rows: DataFrame, row_id: str) -> DataFrame:
    """Rows of the replay table with the id and the hash that they were told apart by."""
    return rows.select(
        row_id, "service_id", "endpoint", "method", normalize_document(F.col("body")).alias("normalized_payload"), "content_hash",
        F.col("sampled_at").alias("ingested_at"), F.to_date("sampled_at").alias("ingest_date"),
    )
