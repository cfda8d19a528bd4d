"""Late data: rows older than the watermark go to a side table instead of vanishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlake.functions.scalars import micros

WATERMARK = "10 minutes"


def late_by_batch(rows: DataFrame, batch: str, time: str, delay: str = WATERMARK) -> DataFrame:
    """Rows older than the watermark that held when their batch arrived.

    The watermark of a batch is the newest time of all earlier batches less the delay. Batches
    are reduced to one row each before the running maximum.
    """
    earlier = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.groupBy(batch).agg(F.max(time).alias("newest"))
    marks = seen.select(batch, F.max("newest").over(earlier).alias("seen"))
    late = F.col(time) < F.col("seen") - F.expr(f"INTERVAL {delay}")
    return rows.join(marks, batch).filter(late).drop("seen")


def split_late(
    stream: DataFrame, time: str, on_time_path: str, late_path: str, marks_path: str, checkpoint: str, delay: str = WATERMARK
) -> StreamingQuery:
    """Write a stream to two tables, on-time and late rows.

    The newest time of each batch is kept in ``marks_path``, so a restarted query goes on with
    the same watermark. A batch that is run again replaces its own rows.
    """
    spark: SparkSession = stream.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id > 0:
            marks = spark.read.schema("newest bigint, batch_id bigint").parquet(marks_path)
            newest = marks.filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        limit = F.timestamp_micros(F.lit(newest).cast("bigint")) - F.expr(f"INTERVAL {delay}")
        is_late = F.coalesce(F.col(time) < limit, F.lit(False))
        for rows, path in ((batch.filter(~is_late), on_time_path), (batch.filter(is_late), late_path)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        mark = batch.agg(F.max(micros(F.col(time))).alias("newest"))
        mark.write.mode("overwrite").parquet(f"{marks_path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
