"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings a session can change at run time; every job here relies on them.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}

#: Rows of a scan that one task takes.
TASK_ROWS = 50_000


def build_session(app: str = "driftlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the cluster's shared folder; where none is set, of the warehouse, which is shared as well."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/driftlake-scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps restart from the files."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None) -> Iterator[None]:
    """Start streaming queries with one state partition per core.

    The number is fixed for the life of a checkpoint and adaptive execution does not change it.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, n or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Use all cores and give no task more than about ``task_rows`` rows, or keep the splits of the input if they are finer.

    Only for plain scans, whose rows are counted from the files' footers: a compact file is cut into a few splits per core
    at most, however many rows it holds, and a payload takes far more work than its bytes tell.
    """
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df
