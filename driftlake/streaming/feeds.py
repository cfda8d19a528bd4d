"""Live views: newest rows first, kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest_feed(
    stream: DataFrame, time: str, row_id: str, n: int, publish: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Publish the ``n`` newest rows after every batch.

    The view before the batch is a table of at most ``n`` rows beside the checkpoint, so a
    restarted query finds it again.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint}-view"

    def refresh(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/{batch_id - 1}"))
        rows.orderBy(F.desc(time), F.desc(row_id)).limit(n).write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        publish(spark.read.schema(batch.schema).parquet(f"{folder}/{batch_id}"))

    return (
        stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
