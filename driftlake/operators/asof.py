"""As-of lookup: for each left row the nearest right row in time, per key.

Rows are split by (key, time bucket), so one busy key spreads over its buckets, and no pairs
are built: the lookup is a running ``last_value`` over the time-ordered union of both sides.
A bucket sees older right rows through one carried row, the last of the buckets before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.scalars import micros

BUCKET_SECONDS = 60


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_id: str,
    direction: str = "backward",
    allow_equal: bool = False,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """``left`` with a struct column ``match`` (null if none).

    ``backward`` finds the latest right row before the left time, ``forward`` the earliest one
    after it; among right rows of one time the smallest ``right_id`` wins.
    """
    keys = list(keys)
    # forward is backward on a reversed time axis
    sign = 1 if direction == "backward" else -1
    width = bucket_seconds * 1_000_000
    axis = {"t": sign * micros(F.col(left_time))}
    # a right row at the same instant must come first to be seen, last to stay unseen
    left_kind, right_kind = (1, 0) if allow_equal else (0, 1)

    lefts = left.withColumns(axis).select(
        *keys, F.floor(F.col("t") / width).alias("bucket"), "t", F.lit(left_kind).alias("kind"),
        F.lit(None).cast(right.select(right_id).schema[0].dataType).alias("rid"),
        F.struct(*left.columns).alias("l"),
    )
    match = F.struct(*[c for c in right.columns if c not in keys])
    rights = right.withColumn("t", sign * micros(F.col(right_time))).select(
        *keys, F.floor(F.col("t") / width).alias("bucket"), "t", F.lit(right_kind).alias("kind"),
        F.col(right_id).alias("rid"), match.alias("match"),
    )

    # the last right row of every bucket, carried into later buckets that hold left rows
    newest = rights.select(*keys, "bucket", "t", "rid", "match").groupBy(*keys, "bucket").agg(
        F.max("t").alias("t"), F.min_by(F.struct("rid", "match"), F.struct((-F.col("t")).alias("nt"), "rid")).alias("m")
    )
    wanted = lefts.select(*keys, "bucket").distinct().withColumn("wanted", F.lit(True))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = newest.withColumn("c", F.struct("t", "m")).drop("t", "m").join(wanted, [*keys, "bucket"], "full_outer")
    carried = (
        buckets.withColumn("c", F.last_value("c", ignoreNulls=True).over(earlier))
        .filter("wanted AND c IS NOT NULL")
        .select(*keys, "bucket", "c.t", F.lit(right_kind).alias("kind"), "c.m.rid", "c.m.match")
    )

    both = lefts.unionByName(rights.unionByName(carried), allowMissingColumns=True)
    upto = (
        Window.partitionBy(*keys, "bucket").orderBy("t", "kind", F.desc("rid"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("match", F.last_value("match", ignoreNulls=True).over(upto))
        .filter("l IS NOT NULL")
        .select("l.*", "match")
    )
