"""A table replayed as a file stream, and one-shot runs of streaming queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlake.session import scratch_folder, state_partitions


def as_stream(table: DataFrame, time: str, slices: int = 4, cuts: Sequence | None = None) -> DataFrame:
    """Write the table as successive time slices and read them back, one slice per micro-batch.

    The file source takes files by age, so the slices are written one after the other; each is
    written in parallel. ``cuts`` are the last values of all slices but the newest one. Event times must be TIMESTAMP for a watermark, so TIMESTAMP_NTZ is cast.
    """
    spark = table.sparkSession
    path = scratch_folder(spark, "stream")
    casts = {f.name: F.col(f.name).cast("timestamp") for f in table.schema if f.dataType.typeName() == "timestamp_ntz"}
    rows = table.withColumns(casts)
    files = spark.sparkContext.defaultParallelism
    shares = [i / slices for i in range(1, slices)]
    cuts = rows.agg(F.percentile_approx(F.col(time), shares)).first()[0] if cuts is None else list(cuts)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(F.col(time) > F.lit(low))
        part = part if high is None else part.filter(F.col(time) <= F.lit(high))
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a query over all available input into a table folder and return the table."""
    spark = stream.sparkSession
    out, checkpoint = scratch_folder(spark, name), scratch_folder(spark, f"{name}-checkpoint")
    with state_partitions(spark):
        query: StreamingQuery = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def plain_times(table: DataFrame) -> DataFrame:
    """TIMESTAMP columns as TIMESTAMP_NTZ, the type of the batch tables."""
    casts = {f.name: F.col(f.name).cast("timestamp_ntz") for f in table.schema if f.dataType.typeName() == "timestamp"}
    return table.withColumns(casts)
