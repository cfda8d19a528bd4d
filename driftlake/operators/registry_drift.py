"""The drift cycle over the registry's own documents: each declared contract against the inferred one of its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.nodes import is_object
from driftlake.operators import contracts as C
from driftlake.operators import diff as D

IDS = ("baseline_id", "inferred_id")


def document_pairs(contracts: DataFrame, keys: Sequence[str] = C.PAIR) -> DataFrame:
    """Keys with both sides: ids and documents of the latest declared and the latest inferred active contract."""
    inferred = F.col("source") == "inferred"

    def newest(condition: Column) -> Column:
        return F.max_by(F.when(condition, F.struct("id", "schema_json")), F.when(condition, F.struct("version", "id")))

    sides = contracts.filter(F.col("status") == "active").groupBy(*keys).agg(newest(~inferred).alias("b"), newest(inferred).alias("i"))
    return sides.filter("b IS NOT NULL AND i IS NOT NULL").select(
        *keys, F.col("b.id").alias("baseline_id"), F.col("i.id").alias("inferred_id"), F.col("b.schema_json").alias("baseline"), F.col("i.schema_json").alias("inferred")
    )


def changed_pairs(pairs: DataFrame, evaluated: DataFrame, keys: Sequence[str] = C.PAIR) -> DataFrame:
    """Pairs of which a document is not the one that was evaluated last.

    ``evaluated`` has the keys and ``documents``, the hash of both documents and their ids.
    """
    return fingerprinted(pairs).join(evaluated.select(*keys, "documents"), [*keys, "documents"], "left_anti")


def fingerprinted(pairs: DataFrame) -> DataFrame:
    """Adds ``documents``: one hash of both ids and both documents, in which null differs from any text."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (*IDS, "baseline", "inferred")]
    return pairs.withColumn("documents", F.sha2(F.concat_ws("|", *parts), 256))


def evaluate(pairs: DataFrame, keys: Sequence[str] = C.PAIR) -> tuple[DataFrame, DataFrame]:
    """(violations, rejects). A pair with an unreadable document gives reject rows (side, contract_id) and no violations."""
    keys = [*keys, *IDS]
    readable = {s: F.coalesce(is_object(f"try_parse_json({s})"), F.lit(False)) for s in ("baseline", "inferred")}
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("contract_id"), readable[s].alias("ok")) for s in readable])
    rejects = pairs.select(*keys, F.explode(sides).alias("s")).filter(~F.col("s.ok")).select(*keys, "s.side", "s.contract_id")
    fine = pairs.filter(readable["baseline"] & readable["inferred"])
    nodes = [C.contract_to_nodes(fine, keys, s, with_root=True, nested_items=True) for s in readable]
    return D.schema_diff(*nodes, keys), rejects
