"""The drift cycle as a stream of registry changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlake.operators import registry_drift as R
from driftlake.operators.contracts import PAIR


def drift_cycles(
    changes: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = PAIR, changed_at: str = "changed_at", trigger: dict | None = None
) -> StreamingQuery:
    """Every cycle takes the changed contracts, and evaluates the pairs of their keys of which a document is a new one.

    ``changes`` are contract rows; the newest row (``changed_at``) of an id is its state, so an archived contract gives way
    to the one before it. Tables below ``folder``, each with one folder per batch that a repeated batch overwrites:
    ``contracts`` (state of all ids after the batch), ``evaluated`` (the pairs evaluated in it, and those known before),
    ``violations`` and ``rejects`` (of the pairs evaluated in it).
    """
    spark: SparkSession = changes.sparkSession
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    known = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "documents string", "batch bigint"])

    def cycle(batch: DataFrame, batch_id: int) -> None:
        def at(table: str, number: int = batch_id) -> str:
            return f"{folder}/{table}/batch={number}"

        before, evaluated = spark.createDataFrame([], batch.schema), spark.createDataFrame([], known)
        if batch_id > 0:
            before = spark.read.schema(batch.schema).parquet(at("contracts", batch_id - 1))
            evaluated = spark.read.schema(known).parquet(at("evaluated", batch_id - 1))
        newest = F.max_by(F.struct(*batch.columns), F.struct(changed_at, "status")).alias("c")
        before.unionByName(batch).groupBy("id").agg(newest).select("c.*").write.mode("overwrite").parquet(at("contracts"))
        contracts = spark.read.schema(batch.schema).parquet(at("contracts"))
        touched = batch.select(*keys).distinct()
        pairs = R.document_pairs(contracts.join(touched, keys, "left_semi"), keys)
        changed = R.changed_pairs(pairs, evaluated, keys)
        changed.write.mode("overwrite").parquet(at("changed"))
        changed = spark.read.schema(changed.schema).parquet(at("changed"))
        violations, rejects = R.evaluate(changed, keys)
        violations.write.mode("overwrite").parquet(at("violations"))
        rejects.write.mode("overwrite").parquet(at("rejects"))
        # pairs that are gone leave the list, so that they are evaluated anew if they come back
        rest = evaluated.join(touched, keys, "left_anti").unionByName(
            evaluated.join(R.fingerprinted(pairs).select(*keys, "documents"), [*keys, "documents"], "left_semi")
        )
        now = changed.select(*keys, "documents", F.lit(batch_id).cast("bigint").alias("batch"))
        rest.select(*keys, "documents", "batch").unionByName(now).write.mode("overwrite").parquet(at("evaluated"))

    return (
        changes.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    )


def current(spark: SparkSession, folder: str, last_batch: int, table: str, keys: Sequence[str] = PAIR) -> DataFrame:
    """``violations`` or ``rejects`` of the pairs as they stand after a batch."""
    evaluated = spark.read.parquet(f"{folder}/evaluated/batch={last_batch}").select(*keys, "batch")
    return spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}").join(evaluated, [*keys, "batch"], "left_semi").drop("batch")
