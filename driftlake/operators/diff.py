"""Drift between two node tables, and between two documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.scalars import score

DIFF_COLS = ("type", "required", "enum_values", "format", "pattern", "nullable")


def _side(nodes: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    renamed = [F.col(c).alias(f"{tag}_{c}") for c in DIFF_COLS]
    return nodes.select(*keys, "path", F.lit(True).alias(f"has_{tag}"), *renamed)


def type_change(old: Column, new: Column) -> Column:
    """Only widening an integer to a number is harmless."""
    return F.when((old == "integer") & (new == "number"), "ADDITIVE").otherwise("BREAKING")


def _rules() -> list[tuple[Column, Column, Column]]:
    """(condition, severity, description) in order of precedence."""
    def b(c: str) -> Column:
        return F.col(f"b_{c}")

    def i(c: str) -> Column:
        return F.col(f"i_{c}")

    path = F.col("path")
    breaking, warning, additive = F.lit("BREAKING"), F.lit("WARNING"), F.lit("ADDITIVE")
    gone, new = F.col("has_i").isNull(), F.col("has_b").isNull()

    def text(label: str) -> Column:
        return F.concat(F.lit(label + ": "), path)

    def differs(c: str) -> Column:
        return b(c).isNotNull() & i(c).isNotNull() & (b(c) != i(c))

    return [
        (gone & b("required"), breaking, text("Required field removed")),
        (gone, warning, text("Optional field removed")),
        (new & i("required"), breaking, text("New required field added")),
        (new, additive, text("New optional field added")),
        (b("required") & ~i("required"), breaking, text("Required field made optional")),
        (
            b("type") != i("type"),
            type_change(b("type"), i("type")),
            F.concat(F.lit("Field type changed from "), b("type"), F.lit(" to "), i("type"), F.lit(": "), path),
        ),
        (F.size(F.array_except(b("enum_values"), i("enum_values"))) > 0, breaking, text("Enum values removed")),
        (
            F.size(F.array_distinct(i("enum_values"))) > F.size(F.array_distinct(b("enum_values"))),
            additive,
            text("Enum values added"),
        ),
        (
            differs("format"),
            breaking,
            F.concat(F.lit("Format changed from "), b("format"), F.lit(" to "), i("format"), F.lit(": "), path),
        ),
        (differs("pattern"), breaking, text("Pattern changed")),
        (~b("nullable") & i("nullable"), warning, text("Response schema now nullable")),
    ]


def compare(baseline: DataFrame, inferred: DataFrame, keys: Sequence[str], require_both: bool = True) -> DataFrame:
    """Every path of either side with its verdict; ``severity`` is null where nothing changed.

    Both inputs are node tables. With ``require_both`` a key that exists on one side only is
    skipped: the joined rows tell which sides a key has, so neither input is read twice. A root row
    (``path = ''``) shows that a side exists even if it has no fields; it gets no verdict.
    """
    keys = list(keys)
    pairs = _side(baseline, keys, "b").join(_side(inferred, keys, "i"), [*keys, "path"], "full_outer")
    if require_both:
        contract = Window.partitionBy(*keys)
        pairs = (
            pairs.withColumns({f"key_{s}": F.max(f"has_{s}").over(contract) for s in ("b", "i")})
            .filter("key_b AND key_i")
        )
    pairs = pairs.filter(F.col("path") != "")
    rules = _rules()

    def pick(column: int) -> Column:
        first, *rest = rules
        return reduce(lambda chain, r: chain.when(r[0], r[column]), rest, F.when(first[0], first[column]))

    return pairs.select(
        *keys, "path", pick(1).alias("severity"), pick(2).alias("description"),
        F.coalesce("has_b", F.lit(False)).alias("in_baseline"), F.coalesce("has_i", F.lit(False)).alias("in_inferred"),
    )


def schema_diff(baseline: DataFrame, inferred: DataFrame, keys: Sequence[str], require_both: bool = True) -> DataFrame:
    """Violations of ``inferred`` against ``baseline``, matched on (keys, path)."""
    compared = compare(baseline, inferred, keys, require_both)
    return compared.filter(F.col("severity").isNotNull()).drop("in_baseline", "in_inferred")


def severity_counts() -> dict[str, Column]:
    return {s.lower(): F.count_if(F.col("severity") == s) for s in ("BREAKING", "WARNING", "ADDITIVE")}


def drift_scores(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field counts of both sides, severity counts and drift score per key."""
    counts = severity_counts()
    return compared.groupBy(*keys).agg(
        F.count_if("in_baseline").alias("baseline_fields"),
        F.count_if("in_inferred").alias("inferred_fields"),
        *[c.alias(n) for n, c in counts.items()],
        score(*counts.values()).alias("drift_score"),
    )


def drift_events(violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One event per key with at least one violation.

    The list holds at most one entry per path of one contract, so its size is that of a schema
    document and does not grow with traffic.
    """
    item = F.struct("path", "severity", "description")
    return violations.groupBy(*keys).agg(
        score(*severity_counts().values()).alias("drift_score"), F.array_sort(F.collect_list(item)).alias("violations")
    )


def doc_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaf-by-leaf comparison of two flattened documents per key.

    Inputs: (keys, path, value_str) with one row per leaf path.
    """
    keys = list(keys)
    o = old.select(*keys, "path", F.lit(True).alias("has_old"), F.col("value_str").alias("old_value"))
    n = new.select(*keys, "path", F.lit(True).alias("has_new"), F.col("value_str").alias("new_value"))
    change = (
        F.when(F.col("has_new").isNull(), "removed")
        .when(F.col("has_old").isNull(), "added")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged")
        .otherwise("changed")
    )
    return o.join(n, [*keys, "path"], "full_outer").select(
        *keys, "path", change.alias("change"), "old_value", "new_value"
    )


def doc_severity(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """removed → BREAKING, else changed → WARNING, else ADDITIVE."""
    has = {c: F.bool_or(F.col("change") == c) for c in ("removed", "changed")}
    return lines.groupBy(*keys).agg(
        F.when(has["removed"], "BREAKING").when(has["changed"], "WARNING").otherwise("ADDITIVE").alias("severity")
    )


def _paths(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nodes.filter(F.col("path") != "").select(*keys, "path")


def path_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paths of either side; the root of a document (path ``''``) is no path of its own."""
    return _paths(left, keys).union(_paths(right, keys)).distinct()


def paths_missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paths of ``left`` that ``right`` does not have, the root left out."""
    return _paths(left, keys).subtract(_paths(right, keys))


def enum_drift(baseline: DataFrame, inferred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Enum values removed and added per path present on both sides."""
    b = baseline.select(*keys, "path", F.col("enum_values").alias("old_values"))
    i = inferred.select(*keys, "path", F.col("enum_values").alias("new_values"))
    removed = F.array_except("old_values", "new_values")
    added = F.array_except("new_values", "old_values")
    return b.join(i, [*keys, "path"]).select(
        *keys, "path", F.array_sort(removed).alias("removed"), F.array_sort(added).alias("added")
    ).filter((F.size("removed") > 0) | (F.size("added") > 0))
