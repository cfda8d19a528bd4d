"""Presence, type and value statistics per JSON path.

``path_stats`` is additive: statistics of two days are the sum of both, so a longer range is
inferred from stored statistics without reading a sample again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.nodes import JSON_TYPES, TRAFFIC_KEYS

PATH_COLS = ("path", "parent_path", "name", "depth", "is_item", "in_array")
COUNT_COLS = ("n", *[f"n_{t}" for t in JSON_TYPES])
# Thresholds of the inference rules.
OPTIONAL_BELOW = 0.8
ENUM_MAX_VALUES = 20
ENUM_MIN_SAMPLES = 100
DOMINANT_SHARE = 0.95


def path_stats(nodes: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS, values: bool = False, max_values: int = ENUM_MAX_VALUES) -> DataFrame:
    """Counts per (keys, path); partial aggregation happens before the only exchange.

    With ``values`` each leaf path also keeps two small sketches of its non-null values, for
    :func:`enums_of`; wide paths (ids) cost no more than narrow ones.
    """
    sketches = []
    if values:
        tracked, lg_size = _sketch_sizes(max_values)
        is_leaf = "NOT in_array AND path <> '' AND json_type NOT IN ('object', 'null')"
        # a sketch passes over empty strings, so every value gets a letter in front
        value = f"CASE WHEN {is_leaf} THEN concat('v', value_str) END"
        sketches = [
            F.expr(f"theta_sketch_agg({value}, {lg_size})").alias("value_sketch"),
            F.expr(f"approx_top_k_accumulate({value}, {tracked})").alias("value_top"),
        ]
    return nodes.groupBy(*keys, *PATH_COLS).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("json_type") == t).alias(f"n_{t}") for t in JSON_TYPES],
        *sketches,
    )


def _sketch_sizes(max_values: int) -> tuple[int, int]:
    """(items tracked, log2 of the theta size); both hold more than ``max_values`` and a null."""
    return max(64, 2 * max_values), max(6, (2 * max_values).bit_length())


def merge_stats(stats: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS, max_values: int = ENUM_MAX_VALUES) -> DataFrame:
    """Add up statistics of several periods, the sketches too if they are there."""
    sketches = []
    if "value_sketch" in stats.columns:
        tracked, lg_size = _sketch_sizes(max_values)
        sketches = [
            F.expr(f"theta_union_agg(value_sketch, {lg_size})").alias("value_sketch"),
            F.expr(f"approx_top_k_combine(value_top, {tracked})").alias("value_top"),
        ]
    return stats.groupBy(*keys, *PATH_COLS).agg(*[F.sum(c).alias(c) for c in COUNT_COLS], *sketches)


def with_totals(stats: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS) -> DataFrame:
    """Add the number of valid samples of the key, which is the count of root nodes."""
    root = F.max(F.when(F.col("path") == "", F.col("n")))
    return stats.withColumn("total", root.over(Window.partitionBy(*keys)))


def with_parent_objects(stats: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS) -> DataFrame:
    """Add how often the parent of each path was an object.

    A container path is a member of two families: its parent's, as a child, and its own, as
    the parent. The grouping key is the family, so no key gathers all paths of a service.
    """
    roles = F.when(
        F.col("n_object") > 0,
        F.array(
            F.struct(F.lit(False).alias("is_parent"), F.col("parent_path").alias("family")),
            F.struct(F.lit(True).alias("is_parent"), F.col("path").alias("family")),
        ),
    ).otherwise(F.array(F.struct(F.lit(False).alias("is_parent"), F.col("parent_path").alias("family"))))
    family = Window.partitionBy(*keys, "family")
    return (
        stats.withColumn("role", F.explode(roles))
        .withColumns({"is_parent": F.col("role.is_parent"), "family": F.col("role.family")})
        .drop("role")
        .withColumn("n_parent", F.max(F.when(F.col("is_parent"), F.col("n_object"))).over(family))
        .filter(~F.col("is_parent"))
        .drop("is_parent", "family")
    )


def leaves(stats: DataFrame) -> DataFrame:
    """Paths as the field analysis sees them: objects are descended, arrays are values."""
    present = F.col("n") - F.col("n_object")
    return stats.filter(~F.col("in_array") & (F.col("path") != "")).withColumn("present", present).filter(
        "present > 0"
    )


def field_presence(stats: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS) -> DataFrame:
    """present count, total and ratio per leaf path."""
    return leaves(with_totals(stats, keys)).select(
        *keys, "path", "present", "total", (F.col("present") / F.col("total")).alias("ratio")
    )


def optional_fields(stats: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS, below: float = OPTIONAL_BELOW) -> DataFrame:
    return field_presence(stats, keys).filter(F.col("ratio") < below)


def leaf_counts() -> dict[str, Column]:
    """Type counts that the field analysis uses: objects are not values."""
    return {t: F.col(f"n_{t}") for t in JSON_TYPES if t != "object"}


def dominant(counts: dict[str, Column]) -> tuple[Column, Column]:
    """(name, count) of the most frequent type; ties go to the first in the fixed order."""
    top = F.greatest(*counts.values())
    name = F.coalesce(*[F.when(c == top, F.lit(t)) for t, c in counts.items()])
    return name, top


def observed(counts: dict[str, Column]) -> Column:
    """Names of the types seen, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c > 0, F.lit(t)) for t, c in counts.items()])))


def probabilistic(counts: dict[str, Column], share: float = DOMINANT_SHARE) -> tuple[Column, Column]:
    """(condition, dominant type): one type clearly prevails although others were seen."""
    name, top = dominant(counts)
    total = sum(counts.values(), F.lit(0))
    return (total > 0) & (top < total) & (top / total >= share), name


def probabilistic_types(stats: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS, share: float = DOMINANT_SHARE) -> DataFrame:
    counts = leaf_counts()
    hit, name = probabilistic(counts, share)
    return (
        stats.filter(~F.col("in_array") & (F.col("path") != "") & hit)
        .select(*keys, "path", name.alias("dominant_type"), observed(counts).alias("observed_types"))
    )


def _leaf_values(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    is_leaf = ~F.col("in_array") & (F.col("path") != "") & ~F.col("json_type").isin("object", "null")
    return nodes.filter(is_leaf).select(*keys, "path", "value_str")


def value_cardinality(nodes: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS) -> DataFrame:
    """Exact number of distinct non-null values per leaf path.

    The values are made distinct before the second exchange, so a busy path spreads over its
    values and no task holds the value set of a path.
    """
    values = _leaf_values(nodes, keys).distinct()
    return values.groupBy(*keys, "path").agg(F.count("*").alias("n_values"))


def enums_of(max_values: int = ENUM_MAX_VALUES, min_samples: int = ENUM_MIN_SAMPLES) -> Column:
    """Sorted values of a path with 2..max_values distinct non-null values among at least
    ``min_samples`` samples, else null. Needs the sketches and ``total``.

    A theta sketch counts exactly while it holds no more values than its size, and the item
    sketch keeps every value while it tracks fewer than it may. Both sizes lie above
    ``max_values``, so the result is exact for every path that passes, and no other path can.
    """
    few = F.theta_sketch_estimate("value_sketch").between(2, max_values) & (F.col("total") >= min_samples)
    items = F.expr(f"approx_top_k_estimate(value_top, {max_values + 2})")
    values = F.array_sort(F.array_compact(F.transform(items, lambda i: F.substr(i["item"], F.lit(2)))))
    return F.when(few, values)


def enum_values(
    nodes: DataFrame,
    keys: Sequence[str] = TRAFFIC_KEYS,
    max_values: int = ENUM_MAX_VALUES,
    min_samples: int = ENUM_MIN_SAMPLES,
) -> DataFrame:
    """Enum-like paths with their values, from one pass over the nodes."""
    stats = with_totals(path_stats(nodes, keys, values=True, max_values=max_values), keys)
    return (
        stats.withColumn("enum_values", enums_of(max_values, min_samples))
        .filter(F.col("enum_values").isNotNull())
        .select(*keys, "path", "total", "enum_values")
    )
