"""Windowed inference and drift detection on a stream of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlake.functions.nodes import TRAFFIC_KEYS, is_object, traffic_nodes
from driftlake.operators import diff as D
from driftlake.operators import infer as I
from driftlake.operators import stats as S
from driftlake.session import spread

WATERMARK = "10 minutes"


def windowed_stats(stream: DataFrame, time: str = "sampled_at", window: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Path statistics per key and tumbling window; only counts are kept as state."""
    marked = stream.withWatermark(time, watermark)
    flat = traffic_nodes(marked, extra=[time], values=False)
    return S.path_stats(flat, [*TRAFFIC_KEYS, F.window(time, window).alias("w")]).select(
        *TRAFFIC_KEYS, F.col("w.start").alias("window_start"), *S.PATH_COLS, *S.COUNT_COLS
    )


def infer_windows(stream: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Contracts per key and window, written once a window is complete."""
    keys = [*TRAFFIC_KEYS, "window_start"]

    def write(batch: DataFrame, batch_id: int) -> None:
        I.schema_nodes(batch, keys).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        windowed_stats(stream).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def detect_drift(
    stream: DataFrame, baseline: DataFrame, out_path: str, reject_path: str, checkpoint: str,
    keys: Sequence[str] = TRAFFIC_KEYS, trigger: dict | None = None,
) -> StreamingQuery:
    """Every 60 seconds: infer the contracts of the new samples and compare all keys at once.

    A key whose payloads in a batch are all ``{}`` has lost every field of its contract. For a contract without fields to
    count as well, ``baseline`` needs its root rows (``with_root=True``). Payloads that are no JSON objects go to ``reject_path`` and do not stop the batch.
    A batch that is run again overwrites its own folder.
    """

    def detect(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            # files of a trigger are packed into one task per core, however many rows they hold
            rows = spread(batch)
            parsed = F.try_parse_json("body")
            rejected = rows.withColumn("doc", parsed).filter(~is_object("doc")).drop("doc")
            rejected.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
            inferred = I.schema_nodes(S.path_stats(traffic_nodes(rows, values=False), keys), keys, with_root=True)
            found = D.schema_diff(baseline, inferred, keys)
            found.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(detect).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    )
