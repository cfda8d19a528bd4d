"""Exact first-anchored dedup and rate limiting on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftlake.functions.scalars import micros
from driftlake.operators.anchors import drop_repeats

WATERMARK = "10 minutes"
#: Groups of keys that share a state.
BUCKETS = 512
_ID, _BUCKET = "dedup_id", "dedup_bucket"


def _sorted(batches: Iterator[pd.DataFrame], time: str, row_id: str) -> tuple[pd.DataFrame, np.ndarray]:
    rows = pd.concat(list(batches), ignore_index=True).sort_values([time, row_id], ignore_index=True)
    return rows, rows[time].to_numpy().astype("datetime64[us]").astype("int64")


class _KeepFirst(StatefulProcessor):
    """State per bucket of keys: the last kept time of each key, as one Arrow table, so that a bucket costs a few calls to the
    state store however many keys it holds. Keys whose period ended before the watermark leave it; a timer clears the rest.
    """

    def __init__(self, columns: list[str], time: str, row_id: str, period_us: int | None, period_column: str | None):
        self.columns, self.time, self.row_id, self.period, self.period_column = columns, time, row_id, period_us, period_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "keys binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, times = _sorted(rows, self.time, self.row_id)
        codes, ids = pd.factorize(frame[_ID])
        order = np.argsort(codes, kind="stable")
        times = times[order]
        starts = np.searchsorted(codes[order], np.arange(len(ids) + 1))
        periods = np.full(len(ids), self.period or 0, dtype="int64")
        if self.period_column:
            periods = frame[self.period_column].to_numpy()[order[starts[:-1]]].astype("int64") * 1_000_000
        known = self._known(timerValues.getCurrentWatermarkInMs() * 1000)
        before = known["last"].reindex(ids)
        seen = before.notna().to_numpy()
        after = np.where(seen, before.fillna(0).to_numpy(dtype="int64") + periods, np.iinfo(np.int64).min)

        keep = np.zeros(len(times), dtype=bool)
        last = before.fillna(0).to_numpy(dtype="int64").copy()
        kept_some = times[starts[:-1]] >= after
        # most keys come once
        single = np.diff(starts) == 1
        once = np.flatnonzero(single & kept_some)
        keep[starts[once]] = True
        last[once] = times[starts[once]]
        for k in np.flatnonzero(~single).tolist():
            low, high = int(starts[k]), int(starts[k + 1])
            own, at, free = times[low:high], 0, int(after[k])
            while (at := at + int(np.searchsorted(own[at:], free, "left"))) < len(own):
                keep[low + at] = kept_some[k] = True
                last[k] = own[at]
                free = int(own[at]) + int(periods[k])
                at += 1
        if kept_some.any():
            fresh = pd.DataFrame({"last": last[kept_some], "until": (last + periods)[kept_some]}, index=ids[kept_some])
            self._store(pd.concat([known[~known.index.isin(fresh.index)], fresh]))
        yield frame.iloc[np.sort(order[keep])][self.columns]

    def _known(self, passed: int) -> pd.DataFrame:
        if not self.last.exists():
            return pd.DataFrame({"last": pd.Series(dtype="int64"), "until": pd.Series(dtype="int64")}, index=pd.Index([], dtype=object))
        with pa.ipc.open_stream(self.last.get()[0]) as reader:
            known = reader.read_all().to_pandas().set_index("id")
        return known[known["until"] > passed]

    def _store(self, keys: pd.DataFrame) -> None:
        table = pa.table({"id": pa.array(keys.index, pa.string()), "last": keys["last"].to_numpy("int64"), "until": keys["until"].to_numpy("int64")})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.last.update((sink.getvalue().to_pybytes(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(keys["until"].max()) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedup_stream(
    stream: DataFrame, key: str | Sequence[str] = "content_hash", time: str = "sampled_at", row_id: str = "sample_id",
    seconds: int | None = 300, watermark: str = WATERMARK, period_column: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Keep a row if no kept row of its key lies less than ``seconds`` before it.

    Keys are dealt to ``buckets``, which are the groups of the state, and the rows of a bucket and micro-batch are handled
    at once: a key that comes once costs no call to the state store. A bucket is bounded by the trigger's batch size;
    :func:`dedup_batches` also splits the rows of one key. With ``period_column`` each key brings its
    own period in seconds, as alert throttling needs it. ``buckets`` is fixed for the life of a checkpoint.
    """
    keys = [key] if isinstance(key, str) else list(key)
    period = None if period_column else seconds * 1_000_000
    rows = stream.withWatermark(time, watermark).withColumns({
        _ID: F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), _BUCKET: F.pmod(F.xxhash64(*keys), F.lit(buckets)),
    })
    return rows.groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=_KeepFirst(stream.columns, time, row_id, period, period_column),
        outputStructType=stream.schema, outputMode="Append", timeMode="EventTime",
    )


class _RateLimit(StatefulProcessor):
    """State per agent: start of the current window and the rows taken in it."""

    def __init__(self, time: str, row_id: str, cap: int, width_us: int):
        self.time, self.row_id, self.cap, self.width = time, row_id, cap, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start bigint, taken bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, times = _sorted(rows, self.time, self.row_id)
        start, taken = self.window.get() if self.window.exists() else (None, 0)
        keep = []
        for at, t in enumerate(times.tolist()):
            if start is None or t >= start + self.width:
                start, taken = t, 0
            if taken < self.cap:
                taken += 1
                keep.append(at)
        self.window.update((start, taken))
        yield frame.iloc[keep]

    def close(self) -> None:
        pass


def rate_limit_stream(
    stream: DataFrame, agent: Sequence[str], time: str = "sampled_at", row_id: str = "sample_id", cap: int = 1000, seconds: int = 60
) -> DataFrame:
    """At most ``cap`` rows per agent and window; a window restarts at the first row ``seconds``
    or more after its start. The budget is per agent, so the agents share the work."""
    return stream.groupBy(*agent).transformWithStateInPandas(
        statefulProcessor=_RateLimit(time, row_id, cap, seconds * 1_000_000),
        outputStructType=stream.schema, outputMode="Append", timeMode="None",
    )


def dedup_batches(
    stream: DataFrame, out_path: str, state_path: str, checkpoint: str, key: str = "content_hash", time: str = "sampled_at",
    row_id: str = "sample_id", seconds: int = 300, watermark_seconds: int = 600, trigger: dict | None = None,
) -> StreamingQuery:
    """The same dedup for streams in which one key may hold much of a micro-batch.

    Each micro-batch runs the batch operator, which cuts busy keys into time segments. The last
    kept time per key is a table in ``state_path``, one folder per batch; keys whose period
    ended before the watermark leave it.
    """
    spark = stream.sparkSession
    key_type = stream.schema[key].dataType.simpleString()
    state_schema = f"{key} {key_type}, last bigint"

    def run(batch: DataFrame, batch_id: int) -> None:
        before = spark.createDataFrame([], state_schema)
        if batch_id > 0:
            before = spark.read.schema(state_schema).parquet(f"{state_path}/batch={batch_id - 1}")
        timed = batch.withColumn("t_us", micros(F.col(time)))
        kept = drop_repeats(timed, [key], "t_us", row_id, seconds * 1_000_000, last_kept=before)
        kept.drop("t_us").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        written = spark.read.schema(batch.schema).parquet(f"{out_path}/batch={batch_id}")
        state = before.unionByName(written.select(key, micros(F.col(time)).alias("last")))
        newest = batch.agg(F.max(micros(F.col(time)))).first()[0]
        state = state.groupBy(key).agg(F.max("last").alias("last"))
        if newest is not None:
            state = state.filter(F.col("last") >= newest - (seconds + watermark_seconds) * 1_000_000)
        state.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def dedup_cheap(stream: DataFrame, key: str = "content_hash", time: str = "sampled_at", period: str = "5 minutes") -> DataFrame:
    """Built-in form without Python; it may also drop a repeat that comes after the period."""
    return stream.withWatermark(time, period).dropDuplicatesWithinWatermark([key])
