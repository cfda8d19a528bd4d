"""Violations linked to deployments, both as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlake.functions.scalars import micros

WATERMARK = "10 minutes"
#: Groups of (service, bucket) that share a state.
GROUPS = 512
_ROWS = pa.schema([("service", pa.string()), ("bucket", pa.int64()), ("t", pa.int64()), ("v", pa.string()), ("deployment_id", pa.string()), ("version_sha", pa.string())])
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class _First(StatefulProcessor):
    """State of a group of (service, bucket), as one Arrow table, so that a group costs a few calls to the state store however
    many rows it holds: the deployments of each bucket, the first one of the bucket after it, and the violations that the
    watermark has not passed. Times are in microseconds.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run([frame[_ROWS.names] for frame in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run([], timerValues)

    def _known(self) -> list[pd.DataFrame]:
        if not self.kept.exists():
            return []
        with pa.ipc.open_stream(self.kept.get()[0]) as reader:
            return [reader.read_all().to_pandas()]

    def _run(self, new: list[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [*self._known(), *new]
        if not frames:
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.concat(frames, ignore_index=True).drop_duplicates(ignore_index=True)
        rows["group"] = rows.groupby(["service", "bucket"], sort=False).ngroup()
        order = rows.fillna({"deployment_id": "", "version_sha": ""}).sort_values(["group", "t", "deployment_id", "version_sha"]).index
        rows = rows.loc[order].reset_index(drop=True)
        deployed = rows["v"].isna()
        in_bucket = rows["t"] // self.width == rows["bucket"]
        own, following = rows[deployed & in_bucket], rows[deployed & ~in_bucket].drop_duplicates("group")
        seen = rows[~deployed]
        ready = seen["t"] <= passed
        yield from self._links(seen[ready], own, following)
        needed = pd.concat([seen[~ready], own, following])
        # no violation of a bucket can come once the watermark has passed its end
        self._store(needed[(needed["bucket"] + 2) * self.width > passed][_ROWS.names])

    def _links(self, seen: pd.DataFrame, own: pd.DataFrame, following: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if seen.empty or own.empty and following.empty:
            return

        def place(rows: pd.DataFrame, t: pd.Series) -> np.ndarray:
            return (rows["group"] * self.width + t - rows["bucket"] * self.width).to_numpy("int64")

        # the first deployment of the bucket after the opening of the window, or else the first one of the next bucket
        choice = pd.concat([own, following], ignore_index=True)
        at = np.searchsorted(place(own, own["t"]), place(seen, seen["t"] - self.width), "right")
        inside = np.append(own["group"].to_numpy("int64"), -1)[at] == seen["group"].to_numpy("int64")
        other = pd.Series(np.arange(len(own), len(choice)), index=following["group"]).reindex(seen["group"]).fillna(-1).to_numpy("int64")
        at = np.where(inside, at, other)
        found = choice.iloc[at][["t", "deployment_id", "version_sha"]]
        hit = (at >= 0) & (found["t"].to_numpy() < seen["t"].to_numpy())
        if hit.any():
            out = found[hit].reset_index(drop=True)
            out.insert(0, "v", seen["v"].to_numpy()[hit])
            yield out

    def _store(self, rows: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows.empty:
            self.kept.clear()
            return
        table = pa.Table.from_pandas(rows, _ROWS, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.kept.update((sink.getvalue().to_pybytes(),))
        # a timer fires once the watermark lies behind it
        waiting = rows.loc[rows["v"].notna(), "t"]
        ends = -(-(int(rows["bucket"].min()) + 2) * self.width // 1000)
        self.handle.registerTimer(min([ends, *([-(-int(waiting.min()) // 1000) - 1] if len(waiting) else [])]))

    def close(self) -> None:
        pass


def correlate_stream(
    violations: DataFrame, deployments: DataFrame, minutes: int = 30, watermark: str = WATERMARK, groups: int = GROUPS
) -> DataFrame:
    """The first deployment in the window before each violation, both ends of the window strict.

    Rows are dealt by service and time bucket as long as the window to ``groups``, which are the groups of the state, and the
    rows of a group and micro-batch are handled at once; ``groups`` is fixed for the life of a checkpoint. A violation belongs to the bucket in which its
    window opens, and either finds its deployment there, by binary search, or takes the first one of the bucket after it;
    so a deployment goes to two buckets, a violation to one, and no pairs are built. A busy service spreads over its
    buckets. A result is emitted only after the watermark has passed the violation, because an earlier deployment may
    still arrive before that; a bucket leaves the state when no violation can need it. Violations that are equal in
    every column count once. Rows without a service or a time match nothing.
    """
    width = minutes * 60_000_000
    shape = violations.schema
    null = F.lit(None).cast("string")

    def sides(rows: DataFrame, time: str, buckets, v, own_id, sha) -> DataFrame:
        t = micros(F.col(time))
        return rows.withWatermark(time, watermark).filter(F.col("service_id").isNotNull() & F.col(time).isNotNull()).select(
            F.col("service_id").cast("string").alias("service"), buckets(F.floor(t / width)).alias("bucket"), F.col(time).alias("at"),
            t.alias("t"), v.alias("v"), own_id.alias("deployment_id"), sha.alias("version_sha"),
        )

    seen = F.to_json(F.struct(*shape.names), _MICROS)
    left = sides(violations, "detected_at", lambda b: b - 1, seen, null, null)
    right = sides(
        deployments, "deployed_at", lambda b: F.explode(F.array(b, b - 1)), null,
        F.col("deployment_id").cast("string"), F.col("version_sha").cast("string"),
    )
    dealt = left.unionByName(right).withColumn("dealt", F.pmod(F.xxhash64("service", "bucket"), F.lit(groups)))
    found = dealt.groupBy("dealt").transformWithStateInPandas(
        statefulProcessor=_First(width), outputStructType="v string, t bigint, deployment_id string, version_sha string",
        outputMode="Append", timeMode="EventTime",
    )
    types = {f.name: f.dataType for f in deployments.schema}
    return found.select(
        F.from_json("v", shape, _MICROS).alias("v"), F.timestamp_micros("t").alias("deployed_at"),
        F.col("deployment_id").cast(types["deployment_id"]), F.col("version_sha").cast(types["version_sha"]),
    ).select("v.service_id", *[f"v.{n}" for n in shape.names if n != "service_id"], "deployed_at", "deployment_id", "version_sha")
