"""Protobuf definitions as contract nodes.

A corpus is a table with one definition text per row. Statements and their enclosing blocks
are found with array functions inside the row and exploded once; names are resolved against
the arrays of the same file, so the whole corpus is one scan without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON type and format of the scalar and the well-known types.
SCALARS = {
    "double": ("number", "double"),
    "float": ("number", "float"),
    "int32": ("integer", "int32"),
    "int64": ("integer", "int64"),
    "uint32": ("integer", "int64"),
    "uint64": ("integer", "int64"),
    "sint32": ("integer", "int32"),
    "sint64": ("integer", "int64"),
    "fixed32": ("integer", "int64"),
    "fixed64": ("integer", "int64"),
    "sfixed32": ("integer", "int32"),
    "sfixed64": ("integer", "int64"),
    "bool": ("boolean", None),
    "string": ("string", None),
    "bytes": ("string", "byte"),
}
WELL_KNOWN = {
    "google.protobuf.Timestamp": ("string", "date-time"),
    "google.protobuf.Duration": ("string", "duration"),
    "google.protobuf.Struct": ("object", None),
    "google.protobuf.Value": ("object", None),
    "google.protobuf.ListValue": ("array", None),
    "google.protobuf.Empty": ("object", None),
    "google.protobuf.Any": ("object", None),
}

_LITERAL = r"""\"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""


def _statements(text: Column) -> Column:
    """Statements with their ending mark. Literals are found before comments, so that neither hides in the other."""
    bare = F.regexp_replace(text, rf"({_LITERAL})|(?s:/\*.*?\*/)|//[^\n]*", "$1 ")
    bare = F.regexp_replace(bare, _LITERAL, " x ")
    for _ in range(3):  # bracketed options, innermost lists first
        bare = F.regexp_replace(bare, r"\[[^\[\]]*\]", " ")
    return F.regexp_extract_all(bare, F.lit(r"[^{};]*[{};]"), F.lit(0))


_CLEAN = r"trim(regexp_replace(left(t, length(t) - 1), r'\s+', ' '))"
_BLOCKS = f"""aggregate(statements,
    named_struct('stack', CAST(array() AS ARRAY<STRING>),
                 'out', CAST(array() AS ARRAY<STRUCT<stack: ARRAY<STRING>, text: STRING, opens: BOOLEAN>>)),
    (s, t) -> CASE
      WHEN right(t, 1) = '}}' THEN named_struct('stack', slice(s.stack, 1, greatest(size(s.stack) - 1, 0)), 'out', s.out)
      WHEN right(t, 1) = '{{' THEN named_struct('stack', array_append(s.stack, {_CLEAN}),
        'out', array_append(s.out, named_struct('stack', s.stack, 'text', {_CLEAN}, 'opens', true)))
      ELSE named_struct('stack', s.stack, 'out', array_append(s.out, named_struct('stack', s.stack, 'text', {_CLEAN}, 'opens', false)))
    END, s -> s.out)"""
_NAME = r"regexp_extract({0}, r'^\w+ (\w+)', 1)"
_MESSAGES = f"transform(filter(blocks, b -> b.opens AND startswith(b.text, 'message ')), b -> {_NAME.format('b.text')})"
_ENUMS = f"""transform(filter(blocks, b -> NOT b.opens AND size(b.stack) > 0 AND startswith(element_at(b.stack, -1), 'enum ')
      AND b.text RLIKE r'^\\w+ ?=' ),
    b -> named_struct('name', {_NAME.format('element_at(b.stack, -1)')}, 'value', regexp_extract(b.text, r'^(\\w+)', 1),
      'scope', transform(filter(b.stack, x -> startswith(x, 'message ')), x -> {_NAME.format('x')})))"""
_FIELDS = r"""filter(blocks, b -> NOT b.opens AND size(b.stack) > 0
    AND (startswith(element_at(b.stack, -1), 'message ') OR startswith(element_at(b.stack, -1), 'oneof ')))"""
_FIELD = r"^(?:(optional|required|repeated) )?(map ?< ?[\w.]+ ?, ?[\w.]+ ?>|[\w.]+) (\w+) ?= ?\d+"


def _lookup(table: dict[str, tuple[str, str | None]]) -> Column:
    entries = [c for name, (kind, form) in table.items() for c in (F.lit(name), F.struct(F.lit(kind).alias("type"), F.lit(form).cast("string").alias("format")))]
    return F.create_map(*entries)


def _resolved(fields: DataFrame) -> DataFrame:
    """Columns ``type``, ``format``, ``enum_values`` and ``ref`` of the type name ``wanted``, in the order names are looked up.

    Every step is a column of its own: the optimizer does not merge them, as each is used several times, while the fields
    of one struct would be put in place wherever they are used.
    """
    name = F.col("wanted")
    full = F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(F.lit("google.protobuf."), name))
    fields = fields.withColumns({
        "known": F.coalesce(_lookup(SCALARS)[name], _lookup(WELL_KNOWN)[full]), "last": F.element_at(F.split(name, r"\."), -1)
    })
    unknown = F.col("known").isNull()
    named = F.filter("enums", lambda e: e["name"] == F.col("last"))
    fields = fields.withColumn("named", F.when(unknown, named))
    # from the innermost scope outwards; a qualified name says its scope itself
    dotted = F.concat(F.lit("."), F.ltrim(name, F.lit(".")))
    inside = F.when(
        F.contains(name, F.lit(".")),
        F.filter("named", lambda e: F.endswith(F.concat(F.lit("."), F.array_join(F.concat(e["scope"], F.array(e["name"])), ".")), dotted)),
    ).otherwise(F.filter("named", lambda e: F.slice("scopes", F.lit(1), F.size(e["scope"])) == e["scope"]))
    fields = fields.withColumn("inside", F.when(F.size("named") > 0, inside))
    fields = fields.withColumn("found", F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("named"))).drop("inside", "named")
    nearest = F.array_max(F.transform("found", lambda e: F.struct(F.size(e["scope"]).alias("n"), e["scope"].alias("scope"))))["scope"]
    fields = fields.withColumn("nearest", nearest)
    none = F.array().cast("array<string>")
    values = F.transform(F.filter("found", lambda e: e["scope"] == F.col("nearest")), lambda e: e["value"])
    fields = fields.withColumn("enum_values", F.coalesce(F.when(F.size("found") > 0, values), none)).drop("found", "nearest")
    is_enum = F.size("enum_values") > 0
    return fields.withColumns({
        "type": F.when(unknown & is_enum, "string").otherwise(F.coalesce("known.type", F.lit("object"))),
        "format": F.col("known.format"),
        "ref": F.when(unknown & ~is_enum & F.array_contains("messages", F.col("last")), F.col("last")),
    }).drop("known", "last")


def proto_nodes(corpus: DataFrame, keys: Sequence[str], text: str = "proto") -> DataFrame:
    """Contract nodes of every message of every file; nothing is required.

    ``message`` is the message name and ``outer`` the messages around it. Repeated fields give
    an array node and a ``path[]`` node, maps an object node with ``value_type``, fields of a
    oneof carry its name, and a message-typed field carries ``ref``.
    """
    keys = list(keys)
    parsed = (
        corpus.select(*keys, _statements(F.col(text)).alias("statements"))
        .select(*keys, F.expr(_BLOCKS).alias("blocks"))
        .select(*keys, F.expr(_MESSAGES).alias("messages"), F.expr(_ENUMS).alias("enums"), F.expr(_FIELDS).alias("fields"))
    )
    part = [F.regexp_extract("f.text", _FIELD, i) for i in (1, 2, 3)]
    scopes = F.transform(F.filter("f.stack", lambda b: b.startswith("message ")), lambda b: F.regexp_extract(b, r"^\w+ (\w+)", 1))
    block = F.element_at("f.stack", -1)
    fields = (
        # outer: else a filter on the size of the list would parse every file once more at the scan
        parsed.select(*keys, "messages", "enums", F.explode_outer("fields").alias("f"))
        .withColumns({"label": part[0], "kind": part[1], "name": part[2], "scopes": scopes})
        .withColumn("oneof", F.when(block.startswith("oneof "), F.regexp_extract(block, r"^\w+ (\w+)", 1)))
        .filter("name <> '' AND kind <> 'option' AND size(scopes) > 0")
    )
    is_map = F.col("kind").startswith("map")
    value = F.regexp_extract("kind", r", ?([\w.]+) ?>", 1)
    fields = fields.withColumn("wanted", F.when(is_map, value).otherwise(F.col("kind")))
    fields = _resolved(fields)
    found = {n: F.col(n) for n in ("type", "format", "enum_values", "ref")}
    repeated = F.col("label") == "repeated"
    none = F.array().cast("array<string>")
    null = F.lit(None).cast("string")

    def node(path: Column, kind: Column, form: Column, enums: Column, ref: Column, value_type: Column) -> Column:
        return F.struct(
            path.alias("path"), kind.alias("type"), form.alias("format"), enums.alias("enum_values"), ref.alias("ref"),
            value_type.alias("value_type"),
        )

    name = F.col("name")
    plain = node(name, found["type"], found["format"], found["enum_values"], found["ref"], null)
    as_map = node(name, F.lit("object"), null, none, null, found["type"])
    as_list = node(name, F.lit("array"), null, none, null, null)
    item = node(F.concat(name, F.lit("[]")), found["type"], found["format"], found["enum_values"], found["ref"], null)
    nodes = F.when(is_map, F.array(as_map)).when(repeated, F.array(as_list, item)).otherwise(F.array(plain))
    message = F.element_at("scopes", -1)
    outer = F.array_join(F.slice("scopes", 1, F.size("scopes") - 1), ".")
    return fields.select(
        *keys, outer.alias("outer"), message.alias("message"), "oneof", F.explode(nodes).alias("n")
    ).select(
        *keys, "outer", "message", "n.path", "n.type", F.lit(False).alias("required"), "n.enum_values", "n.format",
        null.alias("pattern"), F.lit(False).alias("nullable"), "n.ref", "n.value_type", "oneof",
    )


def expand_refs(nodes: DataFrame, keys: Sequence[str], message: str, depth: int | None = None) -> DataFrame:
    """Nodes of one message with the fields of referenced messages below their paths.

    Each level is one equi-join on (file, message), until a level is empty or at the given ``depth``; a message that
    stands on its own path is not entered again.
    """
    keys = list(keys)
    tops = [c for c in nodes.columns if c != "message"]
    level = nodes.filter(F.col("message") == message).drop("message").withColumn("inside", F.array(F.lit(message)))
    out = level
    below = nodes.select(*keys, F.col("message").alias("ref"), *[F.col(c).alias(f"x_{c}") for c in tops if c not in keys])
    while depth is None or depth > 0:
        again = F.lit(depth is None) & F.array_contains("inside", F.col("ref"))
        heads = level.filter(F.col("ref").isNotNull() & ~again).select(*keys, "ref", F.col("path").alias("head"), "inside")
        if depth is None and heads.isEmpty():
            break
        child = heads.join(below, [*keys, "ref"])
        level = child.select(
            *[
                F.col(c) if c in keys
                else F.concat_ws(".", "head", "x_path").alias("path") if c == "path"
                else F.col(f"x_{c}").alias(c)
                for c in tops
            ],
            F.array_append("inside", F.col("ref")).alias("inside"),
        )
        out = out.unionByName(level)
        depth = depth if depth is None else depth - 1
    return out.drop("inside")


def with_roots(nodes: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes of a contract and one root row (``path = ''``) per file, which shows that a contract without fields exists."""
    roots = files.select(*keys).distinct().withColumn("path", F.lit(""))
    return nodes.unionByName(roots, allowMissingColumns=True)
