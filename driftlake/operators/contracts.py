"""The contract registry: documents to nodes, lookups, life cycle, violations by contract."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.functions.scalars import contains_ci, not_blank

_DEEP_NODES = T.ArrayType(T.StructType().add("path", "string").add("type", "string").add("required", "boolean").add(
    "enum_values", T.ArrayType(T.StringType())).add("format", "string").add("pattern", "string").add("nullable", "boolean"))
PAIR = ("provider_id", "consumer_id", "endpoint")
# levels unrolled as SQL; what lies deeper is rare and walked in Python
MAX_DEPTH = 8

_PROPS = "try_variant_get({v}, '$.properties', 'map<string,variant>')"
_NAMES = "try_variant_get({v}, '$.required', 'array<string>')"


def _text(value: str) -> str:
    """Text of a scalar; a list or an object in its place reads as empty text."""
    return f"""CASE WHEN schema_of_variant({value}) RLIKE '^(ARRAY|OBJECT)' THEN ''
        ELSE coalesce(CAST({value} AS STRING), 'null') END"""


def _schema_node(path: str, depth: int, value: str, required: str) -> str:
    def part(name: str, absent: str) -> str:
        found = f"try_variant_get({value}, '$.{name}', 'variant')"
        return f"CASE WHEN {found} IS NULL THEN {absent} ELSE {_text(found)} END"

    enums = f"try_variant_get({value}, '$.enum', 'array<variant>')"
    return f"""struct({path} AS path, {depth} AS depth, {part('type', "'object'")} AS type, {required} AS required,
        coalesce(transform({enums}, x -> {_text('x')}), CAST(array() AS ARRAY<STRING>)) AS enum_values,
        {part('format', 'NULL')} AS format, {part('pattern', 'NULL')} AS pattern,
        coalesce(try_variant_get({value}, '$.nullable', 'boolean'), false) AS nullable,
        {value} AS v)"""


def _walked(node: str) -> str:
    """A node is descended when it is an object or has properties."""
    return f"({node}.type = 'object' OR {_PROPS.format(v=node + '.v')} IS NOT NULL)"


@F.pandas_udf(_DEEP_NODES)
def deeper_schema(parents: pd.Series, raw_paths: pd.Series, nested_items: pd.Series) -> pd.Series:
    """All nodes below the given ones (path, schema text), by the rules of :func:`_schema_node`."""

    def text(value):
        if isinstance(value, (list, dict)):
            return ""
        return {None: "null", True: "true", False: "false"}.get(value, value) if value is None or isinstance(value, bool) else str(value)

    def node(path, schema, required):
        has = schema if isinstance(schema, dict) else {}
        enums = has.get("enum")
        return {
            "path": path, "type": text(has["type"]) if "type" in has else "object", "required": required,
            "enum_values": [text(x) for x in enums] if isinstance(enums, list) else [],
            "format": text(has["format"]) if "format" in has else None, "pattern": text(has["pattern"]) if "pattern" in has else None,
            "nullable": has.get("nullable") is True,
        }

    def walked(path, has):
        return node(path, has, False)["type"] == "object" or isinstance(has.get("properties"), dict)

    def below(path, schema, raw, nested):
        out, todo = [], [(path, schema)]
        while todo:
            at, has = todo.pop()
            if nested and at.endswith("[]") and isinstance(has.get("items"), dict):
                out.append(node(at + "[]", has["items"], False))
                todo.append((at + "[]", has["items"]))
            if not walked(at, has):
                continue
            properties, names = has.get("properties"), has.get("required")
            for name, value in (properties if isinstance(properties, dict) else {}).items():
                found = [node(f"{at}.{name if raw else name.replace('.', chr(92) + '.')}", value, isinstance(names, list) and name in names)]
                kept = [(found[0], value)]
                if isinstance(value, dict) and isinstance(value.get("items"), dict):
                    found.append(node(found[0]["path"] + "[]", value["items"], False))
                    kept.append((found[1], value["items"]))
                out += found
                todo += [(n["path"], v) for n, v in kept if isinstance(v, dict)]
        return out

    sys.setrecursionlimit(20_000)  # the parser nests at most 1000 levels
    return pd.Series([[n for p in nodes for n in below(p["path"], json.loads(p["v"]), raw, nested)] for nodes, raw, nested in zip(parents, raw_paths, nested_items, strict=True)])


def contract_to_nodes(
    contracts: DataFrame, keys: Sequence[str], schema: str = "schema_json", max_depth: int = MAX_DEPTH,
    raw_paths: bool = False, with_root: bool = False, nested_items: bool = False,
) -> DataFrame:
    """Node rows of JSON-schema documents: properties, and array items as ``path[]``.

    One level per step inside the row, like the payload nodes. Items of items are followed with ``nested_items``, as ``path[][]``. A document deeper than
    ``max_depth`` is walked by Python from there on. A dot inside a name is escaped as in payload paths unless
    ``raw_paths``; ``with_root`` adds a row with the empty path for every readable document.
    """
    keys = list(keys)
    name = "e.key" if raw_paths else "replace(e.key, '.', '\\\\.')"
    root = "array(struct('' AS path, 0 AS depth, try_parse_json({0}) AS v)) AS l0".format(schema)
    levels = contracts.select(*keys, F.expr(root))
    for depth in range(1, max_depth + 1):
        walk = "true" if depth == 1 else _walked("n")
        prop = _schema_node(
            f"concat(n.path, CASE WHEN n.path = '' THEN '' ELSE '.' END, {name})", depth, "e.value",
            f"coalesce(array_contains({_NAMES.format(v='n.v')}, e.key), false)",
        )

        def item(node: str) -> str:
            found = _schema_node(f"concat({node}.path, '[]')", depth, f"variant_get({node}.v, '$.items', 'variant')", "false")
            has_items = f"try_variant_get({node}.v, '$.items', 'map<string,variant>') IS NOT NULL"
            return f"CASE WHEN {has_items} THEN array({found}) ELSE array() END"

        members = f"""flatten(transform(coalesce(transform(map_entries({_PROPS.format(v='n.v')}), e -> {prop}), array()),
            p -> concat(array(p), {item('p')})))"""
        # a property's items come with it; the items of items come with the next level
        inner = f"CASE WHEN {str(nested_items).lower()} AND endswith(n.path, '[]') THEN {item('n')} ELSE array() END"
        step = f"flatten(transform(l{depth - 1}, n -> concat(CASE WHEN {walk} THEN {members} ELSE array() END, {inner})))"
        levels = levels.select("*", F.expr(step).alias(f"l{depth}"))
    last = f"l{max_depth}"
    more = f"({_walked('n')} OR {str(nested_items).lower()} AND endswith(n.path, '[]') AND try_variant_get(n.v, '$.items', 'map<string,variant>') IS NOT NULL)"
    deep = F.expr(f"transform(filter({last}, n -> {more}), n -> struct(n.path, to_json(n.v) AS v))")
    levels = levels.withColumn("deep", deeper_schema(deep, F.lit(raw_paths), F.lit(nested_items)))
    shown = [F.transform(f"l{d}", lambda n: n.dropFields("v", "depth")) for d in range(1, max_depth + 1)]
    root = _schema_node("''", 0, "CAST(NULL AS VARIANT)", "false")
    roots = F.expr(f"transform(filter(l0, n -> n.v IS NOT NULL), n -> {root})")
    every = F.concat(*([F.transform(roots, lambda n: n.dropFields("v", "depth"))] if with_root else []), *shown, "deep")
    return levels.select(*keys, F.explode(every).alias("n")).select(*keys, "n.*")


def latest(contracts: DataFrame, keys: Sequence[str] = PAIR, status: str = "active", order: Sequence[str] = ("version", "id")) -> DataFrame:
    """The newest contract with the status per key.

    ``max_by`` aggregates before the exchange, so a key with many versions costs one row per task.
    """
    keys = list(keys)
    rest = [c for c in contracts.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("c")
    return contracts.filter(F.col("status") == status).groupBy(*keys).agg(newest).select(*keys, "c.*")


def pairs(contracts: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Latest declared (manual or imported) contract beside the latest inferred one; a key that
    lacks either side is skipped. Both sides come from one aggregation."""
    keys = list(keys)
    inferred = F.col("source") == "inferred"

    def newest(condition: Column) -> Column:
        return F.max_by(F.when(condition, F.col("id")), F.when(condition, F.struct("version", "id")))

    return (
        contracts.filter(F.col("status") == "active")
        .groupBy(*keys)
        .agg(newest(~inferred).alias("baseline_id"), newest(inferred).alias("inferred_id"))
        .filter("baseline_id IS NOT NULL AND inferred_id IS NOT NULL")
    )


def import_contracts(existing: DataFrame, imports: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """The table after an import: valid imports appended as active with the next version of their
    key, older active declared rows of that key marked superseded.

    An import needs provider, consumer, endpoint and schema. The numbering window runs over the
    import batch and the newest version of each key only.
    """
    keys = list(keys)
    checks = [not_blank(F.col(c)) for c in (*keys, "schema_json")]
    valid = imports.filter(checks[0] & checks[1] & checks[2] & checks[3])
    top = existing.groupBy(*keys).agg(F.max("version").alias("top"))
    order = Window.partitionBy(*keys).orderBy("id")
    newest_of_batch = Window.partitionBy(*keys)
    numbered = (
        valid.withColumns({"rn": F.row_number().over(order), "batch": F.count("*").over(newest_of_batch)})
        .join(top, keys, "left")
        .withColumn("version", (F.coalesce("top", F.lit(0)) + F.col("rn")).cast("int"))
        .withColumn("source", F.coalesce("source", F.lit("manual")))
        .withColumn("status", F.when(F.col("rn") == F.col("batch"), "active").otherwise("superseded"))
    )
    touched = valid.select(*keys).distinct().withColumn("touched", F.lit(True))
    # the inferred contract stays, as the side that the import is compared with
    outdated = F.col("touched") & (F.col("status") == "active") & (F.col("source") != "inferred")
    status = F.when(outdated, "superseded").otherwise(F.col("status"))
    older = existing.join(touched, keys, "left").withColumn("status", status)
    return older.select(*existing.columns).unionByName(
        numbered.select(*[F.col(f.name).cast(f.dataType) for f in existing.schema])
    )


def set_where(table: DataFrame, ids: DataFrame, key: str, **changes: Column) -> DataFrame:
    """The table with ``changes`` applied to the rows whose key is in ``ids``; rows are kept."""
    hit = ids.select(key).distinct().withColumn("hit", F.lit(True))
    out = table.join(hit, key, "left")
    for column, value in changes.items():
        out = out.withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column)))
    return out.select(*table.columns)


def archive(contracts: DataFrame, ids: DataFrame) -> DataFrame:
    return set_where(contracts, ids, "id", status=F.lit("archived"))


def resolve(violations: DataFrame, ids: DataFrame) -> DataFrame:
    return set_where(violations, ids, "violation_id", resolved=F.lit(True))


def search(contracts: DataFrame, text: str) -> DataFrame:
    return contracts.filter(contains_ci(F.col("provider_id"), text) | contains_ci(F.col("consumer_id"), text))


def select_contracts(
    contracts: DataFrame, id: str | None = None, status: str | None = None, provider: str | None = None,
    consumer: str | None = None, endpoint: str | None = None,
) -> DataFrame:
    """Lookups by id, status, pair and endpoint; each given value narrows the scan."""
    wanted = {"id": id, "status": status, "provider_id": provider, "consumer_id": consumer, "endpoint": endpoint}
    for column, value in wanted.items():
        if value is not None:
            contracts = contracts.filter(F.col(column) == value)
    return contracts


def filter_violations(
    violations: DataFrame, violation_id: str | None = None, contract_id: str | None = None, severity: str | None = None,
    service_contains: str | None = None, resolved: bool | None = None,
) -> DataFrame:
    for column, value in (("violation_id", violation_id), ("contract_id", contract_id), ("severity", severity), ("resolved", resolved)):
        if value is not None:
            violations = violations.filter(F.col(column) == value)
    if service_contains:
        violations = violations.filter(contains_ci(F.col("service_id"), service_contains))
    return violations


def violations_of(violations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Violations with provider, consumer and endpoint of their contract."""
    c = contracts.select(F.col("id").alias("contract_id"), *PAIR)
    return violations.join(c, "contract_id")


def without_contract(violations: DataFrame, contracts: DataFrame) -> DataFrame:
    return violations.join(contracts.select(F.col("id").alias("contract_id")), "contract_id", "left_anti")


def cascade_delete(violations: DataFrame, contracts: DataFrame) -> DataFrame:
    """The violations that remain once the other contracts are deleted."""
    return violations.join(contracts.select(F.col("id").alias("contract_id")), "contract_id", "left_semi")


def violation_summary(violations: DataFrame) -> DataFrame:
    """Totals in one pass."""
    return violations.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if("resolved").alias("resolved"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("BREAKING", "WARNING", "ADDITIVE")],
    )


def by_type_resolved(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity", "resolved").agg(F.count("*").alias("n"))


def recent(violations: DataFrame, n: int = 5) -> DataFrame:
    return violations.orderBy(F.desc("detected_at"), F.desc("violation_id")).limit(n)
