"""Contract inference: one schema per key from path statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.nodes import JSON_TYPES, TRAFFIC_KEYS
from driftlake.operators import stats as S

NODE_COLS = ("path", "type", "required", "enum_values", "format", "pattern", "nullable")


def merged_type(union_mode: str = "nullable", top_level_only: bool = False) -> tuple[Column, Column]:
    """(type, nullable) of a path from its type counts.

    integer and number merge to number; a clearly prevailing integer or number makes the path
    a number. ``union_mode='nullable'`` takes null as a flag and joins other mixes with ``|``;
    ``'reference'`` writes any union as an empty type and never reports nullable.
    """
    leaf = S.leaf_counts()
    hit, name = S.probabilistic(leaf)
    numeric_override = hit & name.isin("integer", "number") & ~F.col("in_array") & (F.col("n_object") == 0)
    if top_level_only:
        numeric_override = numeric_override & (F.col("depth") == 1)
    has = {t: F.col(f"n_{t}") > 0 for t in JSON_TYPES}
    seen = F.array_compact(
        F.array(
            F.when(has["array"], "array"),
            F.when(has["boolean"], "boolean"),
            F.when(has["integer"] & ~has["number"], "integer"),
            F.when(has["null"], "null") if union_mode == "reference" else F.lit(None).cast("string"),
            F.when(has["number"], "number"),
            F.when(has["object"], "object"),
            F.when(has["string"], "string"),
        )
    )
    if union_mode == "reference":
        merged = F.when(F.size(seen) == 1, seen[0]).otherwise("")
        nullable = F.lit(False)
    else:
        merged = F.when(F.size(seen) == 0, "null").otherwise(F.array_join(seen, "|"))
        nullable = has["null"]
    return F.when(numeric_override, "number").otherwise(merged), nullable


def schema_nodes(
    stats: DataFrame,
    keys: Sequence[str] = TRAFFIC_KEYS,
    union_mode: str = "nullable",
    top_level_only: bool = False,
    with_root: bool = False,
) -> DataFrame:
    """The inferred contract as node rows, with the hints beside the schema columns.

    ``with_root`` keeps the row of the root (``path = ''``), which shows that a key was seen even if its payloads are
    empty objects.

    ``enum_suggestion`` is filled if the statistics hold value sketches. ``enum_values``,
    ``format`` and ``pattern`` stay empty: only declared contracts carry them.
    """
    leaf = S.leaf_counts()
    hit, _ = S.probabilistic(leaf)
    hinted = hit & ~F.col("in_array")
    if top_level_only:
        hinted = hinted & (F.col("depth") == 1)
    kind, nullable = merged_type(union_mode, top_level_only)
    full = S.with_parent_objects(S.with_totals(stats, keys), keys)
    if not with_root:
        full = full.filter("path <> ''")
    present = F.col("n") - F.col("n_object")
    suggestion = F.lit(None).cast("array<string>")
    if "value_sketch" in stats.columns:
        suggestion = F.when(F.col("depth") == 1, S.enums_of()) if top_level_only else S.enums_of()
    return full.select(
        *keys,
        "path",
        "parent_path",
        "name",
        "depth",
        kind.alias("type"),
        (~F.col("is_item") & (F.col("n") == F.col("n_parent"))).alias("required"),
        F.array().cast("array<string>").alias("enum_values"),
        F.lit(None).cast("string").alias("format"),
        F.lit(None).cast("string").alias("pattern"),
        nullable.alias("nullable"),
        (~F.col("in_array") & (present > 0) & (present / F.col("total") < S.OPTIONAL_BELOW)).alias("optional"),
        F.when(hinted, S.observed(leaf)).alias("observed_types"),
        suggestion.alias("enum_suggestion"),
        "n",
        "total",
    )


def use_suggested_enums(nodes: DataFrame) -> DataFrame:
    """Let the diff compare suggested enum values as if they were declared."""
    return nodes.withColumn("enum_values", F.coalesce("enum_suggestion", "enum_values"))


STUB = {"openapi": "3.1.0", "info": {"title": "Inferred Schema", "version": "1.0.0"}, "type": "object"}


def _document(rows: pd.DataFrame) -> dict:
    """Nested schema document of one contract from its node rows."""
    root = {**STUB, "jsonSchemaDialect": "https://spec.openapis.org/oas/3.1/dialect/base"}
    by_path = {"": root}
    for row in rows.sort_values(["depth", "path"]).itertuples(index=False):
        types = sorted(set(row.type.split("|")))
        node = {"type": types[0] if len(types) == 1 else types}
        if row.nullable:
            node["nullable"] = True
        if row.enum_suggestion is not None:
            node["x-enum-suggestion"] = list(row.enum_suggestion)
        if row.observed_types is not None:
            node["x-observed-types"] = list(row.observed_types)
        by_path[row.path] = node
        parent = by_path[row.parent_path]
        if row.name == "[]" and row.path == row.parent_path + "[]":
            parent["items"] = node
            continue
        parent.setdefault("properties", {})[row.name] = node
        if row.required:
            parent.setdefault("required", []).append(row.name)
    return root


def schema_documents(nodes: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS, expected: DataFrame | None = None) -> DataFrame:
    """One JSON schema document per key; the groups are node tables, not samples.

    A key of ``expected`` without a single valid sample gets the stub document.
    """
    keys = list(keys)
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1][keys].copy()
        out["schema_json"] = json.dumps(_document(rows), sort_keys=True)
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(*keys).schema)
    cols = [*keys, "path", "parent_path", "name", "depth", "type", "required", "nullable", "observed_types", "enum_suggestion"]
    documents = nodes.select(*cols).groupBy(*keys).applyInPandas(build, f"{schema}, schema_json string")
    if expected is None:
        return documents
    everyone = expected.select(*keys).distinct().join(documents, keys, "left")
    return everyone.withColumn("schema_json", F.coalesce("schema_json", F.lit(json.dumps(STUB, sort_keys=True))))
