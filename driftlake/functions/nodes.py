"""JSON payloads as one long table of nodes.

Every document is unfolded inside its own row (nested array functions over VARIANT), then exploded once: one scan, one
generator, no join, no Python, and the same expression works on a stream. Types and value texts are taken while a document
is unfolded, so only plain columns are copied for a node, never the dictionary of its VARIANT.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions.normalize import TIMESTAMP_PLACEHOLDER, VOLATILE_FIELDS, mask_uuid

TRAFFIC_KEYS = ("service_id", "endpoint", "method")
JSON_TYPES = ("integer", "number", "string", "boolean", "null", "array", "object")
# levels written out as nested expressions; what lies deeper is rare and taken level by level in a loop
UNROLLED = 4

_MEMBERS = "try_variant_get({v}, '$', 'map<string,variant>')"
_ITEMS = "try_variant_get({v}, '$', 'array<variant>')"


def is_object(variant: str) -> Column:
    return F.expr(f"{_MEMBERS.format(v=variant)} IS NOT NULL")


def json_type(variant: Column) -> Column:
    """JSON type name of a VARIANT value."""
    return _type_of(F.schema_of_variant(variant))


def _type_of(shape: Column) -> Column:
    """JSON type name of what ``schema_of_variant`` tells; integers beyond 18 digits are decimals without a fraction."""
    return (
        F.when(shape.isin("BIGINT", *[f"DECIMAL({p},0)" for p in range(19, 39)]), "integer")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def parse_objects(df: DataFrame, body: str = "body", out: str = "doc") -> DataFrame:
    """Parse ``body`` and keep only well-formed JSON objects."""
    parsed = df.withColumn(out, F.try_parse_json(F.col(body)))
    return parsed.filter(is_object(out))


class _Unfold:
    """SQL for the nodes of a document. ``n`` is a node with its VARIANT ``v``, ``x`` what it holds: members or items."""

    def __init__(self, max_depth: int | None, values: bool, raw_paths: bool, masked: Iterable[str]):
        self.max_depth, self.values = max_depth, values
        self.name = "e.key" if raw_paths else "replace(e.key, '.', '\\\\.')"
        names = ", ".join(f"'{m}'" for m in masked)
        self.value = f"""CASE WHEN e.key IN ({names}) THEN parse_json('"{TIMESTAMP_PLACEHOLDER}"') ELSE e.value END""" if names else "e.value"

    @staticmethod
    def _let(name: str, value: str, body: str) -> str:
        """``body`` with ``name`` for a struct. Array functions ask for the type of their argument in every row; that of a name is at hand."""
        return f"aggregate(array(0), struct({value}), ({name}, u) -> {name}, {name} -> {body})"

    def _with_content(self, node: str, body: str) -> str:
        return self._let("x", f"{_MEMBERS.format(v=f'{node}.v')} AS m, {_ITEMS.format(v=f'{node}.v')} AS a", body)

    def _flat(self, name: str, arrays: str) -> str:
        return self._let(name, f"{arrays} AS parts", f"flatten({name}.parts)")

    def _kids(self, node: str) -> str:
        """Nodes below ``node``, null for a scalar."""
        return f"""coalesce(
            transform(map_entries(x.m), e -> struct(concat({node}.path, CASE WHEN {node}.path = '' THEN '' ELSE '.' END, {self.name}) AS path,
              {node}.path AS parent_path, e.key AS name, false AS is_item, {node}.in_array AS in_array, {self.value} AS v)),
            transform(x.a, e -> struct(concat({node}.path, '[]') AS path, {node}.path AS parent_path, '[]' AS name, true AS is_item, true AS in_array, e AS v)))"""

    def _row(self, node: str, depth: int | str) -> str:
        text = f"CASE WHEN x.m IS NULL THEN CAST({node}.v AS STRING) END" if self.values else "CAST(NULL AS STRING)"
        cut = "size(x.m) > 0 OR size(x.a) > 0" if depth == self.max_depth else "false"
        return f"""struct({node}.path AS path, {node}.parent_path AS parent_path, {node}.name AS name, {depth} AS depth, {node}.is_item AS is_item,
            {node}.in_array AS in_array, CASE WHEN x.m IS NOT NULL THEN 'OBJECT' WHEN x.a IS NOT NULL THEN 'ARRAY' ELSE schema_of_variant({node}.v) END AS shape,
            {text} AS value_str, coalesce({cut}, false) AS truncated)"""

    def _below(self, node: str, depth: int) -> str:
        """All nodes below one at the last level that is written out. A level needs a bracket, which bounds the rounds."""
        json = f"to_json({node}.v)"
        brackets = f"length({json}) - length(replace(replace({json}, '{{', ''), '[', ''))"
        deeper = self._flat("y", f"transform(s.front, d -> {self._with_content('d', f'coalesce({self._kids("d")}, array())')})")
        rows = f"transform(s.front, d -> {self._with_content('d', self._row('d', 'i'))})"
        return f"""CASE WHEN size(x.m) > 0 OR size(x.a) > 0 THEN aggregate(sequence({depth + 1}, {depth} + {brackets}),
            struct({self._kids(node)} AS front, array({self._row(node, depth)}) AS done),
            (s, i) -> CASE WHEN size(s.front) = 0 THEN s ELSE struct({deeper} AS front, concat(s.done, {rows}) AS done) END, s -> s.done)
          ELSE array({self._row(node, depth)}) END"""

    def nodes(self, node: str, depth: int = 0) -> str:
        """An array of ``node`` and all nodes below it, null if it is the root and no object."""
        own = f"array({self._row(node, depth)})"
        if depth == self.max_depth:
            whole = own
        elif self.max_depth is None and depth == max(UNROLLED, 1):
            whole = self._below(node, depth)
        else:
            below = f"n{depth + 1}"
            subtrees = self._flat(f"y{depth}", f"transform({self._kids(node)}, {below} -> {self.nodes(below, depth + 1)})")
            whole = f"CASE WHEN x.m IS NULL AND x.a IS NULL THEN {own} ELSE concat({own}, {subtrees}) END"
        return self._with_content(node, whole if depth else f"CASE WHEN x.m IS NOT NULL THEN {whole} END")


def json_nodes(
    df: DataFrame,
    keys: Sequence[str],
    doc: str = "doc",
    max_depth: int | None = None,
    values: bool = True,
    raw_paths: bool = False,
    mask_volatile: bool = False,
) -> DataFrame:
    """One row per JSON node of the documents that are objects, the root (``path = ''``) included.

    ``doc`` is a VARIANT column or SQL expression. ``values=False`` leaves out the value text, which keeps the
    rows small when only types are counted. Documents of any depth are unfolded whole. Only a ``max_depth``
    that the caller gives ends them: nodes there that still have children carry ``truncated = true``. A dot inside a name is
    escaped as ``\\.`` unless ``raw_paths``. With ``mask_volatile`` the volatile fields become
    a placeholder string and are not descended into, and UUIDs in names and values are masked.
    """
    unfold = _Unfold(max_depth, values, raw_paths, VOLATILE_FIELDS if mask_volatile else ())
    # a name for the root, so that a document is parsed once; a non-object leaves no node
    root = f"'' AS path, CAST(NULL AS STRING) AS parent_path, CAST(NULL AS STRING) AS name, false AS is_item, false AS in_array, {doc} AS v"
    whole = F.expr(unfold._let("n0", root, unfold.nodes("n0")))
    keys = list(keys)
    # with a plain explode, the filter that Spark infers would unfold every document a second time, before the exchange
    flat = df.select(*keys, whole.alias("all")).select(*keys, F.explode_outer("all").alias("n")).select(*keys, "n.*").filter("path IS NOT NULL")
    out = flat.withColumn("json_type", _type_of(F.col("shape")))
    if mask_volatile:
        out = out.withColumns({c: mask_uuid(F.col(c)) for c in ("path", "parent_path", "name", "value_str")})
    columns = ["path", "parent_path", "name", "depth", "is_item", "in_array", "json_type", *(["value_str"] if values else []), "truncated"]
    return out.select(*keys, *columns)


def traffic_nodes(samples: DataFrame, extra: Sequence[str] = (), **options) -> DataFrame:
    """Nodes of the bodies of traffic samples, with the traffic keys and ``extra`` columns."""
    return json_nodes(samples, [*TRAFFIC_KEYS, *extra], doc="try_parse_json(body)", **options)


def depth_overflow(nodes: DataFrame, keys: Sequence[str] = TRAFFIC_KEYS) -> DataFrame:
    """How many nodes per key lie at a given depth bound and still have children; without a bound none does."""
    return nodes.groupBy(*keys).agg(F.count_if("truncated").alias("truncated_nodes"))
