"""Inference on small sample sets: the shapes of the reference's own unit tests and more."""

import json

from driftlake.functions.nodes import TRAFFIC_KEYS, traffic_nodes
from driftlake.operators import infer as I
from driftlake.operators import stats as S

KEY = ("svc", "/e", "POST")


def samples(spark, bodies):
    rows = [(*KEY, b if isinstance(b, str) else json.dumps(b)) for b in bodies]
    return spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string")


def infer(spark, bodies, **options):
    nodes = I.schema_nodes(S.path_stats(traffic_nodes(samples(spark, bodies)), values=True), **options)
    return {r["path"]: r for r in nodes.collect()}


def test_basic(spark):
    nodes = infer(spark, [{"name": "a", "age": i, "active": True} for i in range(3)])
    assert {p: n["type"] for p, n in nodes.items()} == {"name": "string", "age": "integer", "active": "boolean"}
    assert all(n["required"] for n in nodes.values())


def test_nested(spark):
    nodes = infer(spark, [{"user": {"name": "a", "address": {"city": "c", "zip": "z"}}}] * 3)
    assert nodes["user"]["type"] == nodes["user.address"]["type"] == "object"
    assert nodes["user.address.city"]["required"]


def test_array_of_objects(spark):
    nodes = infer(spark, [{"items": [{"id": 1, "val": "a"}, {"id": 2}]}] * 3)
    assert nodes["items"]["type"] == "array" and nodes["items[]"]["type"] == "object"
    assert nodes["items[].id"]["required"] and not nodes["items[].val"]["required"]
    assert not nodes["items[]"]["required"]


def test_optional(spark):
    bodies = [{"name": "a", "email": "e"}] * 4 + [{"name": "a"}]
    nodes = infer(spark, bodies)
    assert nodes["name"]["required"] and not nodes["email"]["required"]
    assert not nodes["email"]["optional"]  # 4 of 5 is not below 0.8
    assert infer(spark, bodies + [{"name": "a"}])["email"]["optional"]


def test_enum(spark):
    nodes = infer(spark, [{"status": s} for s in ("active", "inactive", "pending") * 40])
    assert nodes["status"]["enum_suggestion"] == ["active", "inactive", "pending"]


def test_enum_needs_samples_and_few_values(spark):
    assert infer(spark, [{"code": f"c{i}"} for i in range(50)])["code"]["enum_suggestion"] is None
    assert infer(spark, [{"code": f"c{i % 50}"} for i in range(120)])["code"]["enum_suggestion"] is None
    twenty = infer(spark, [{"code": f"c{i % 20}"} for i in range(120)])["code"]["enum_suggestion"]
    assert len(twenty) == 20
    assert infer(spark, [{"code": f"c{i % 21}"} for i in range(120)])["code"]["enum_suggestion"] is None
    assert infer(spark, [{"code": "only"} for i in range(120)])["code"]["enum_suggestion"] is None


def test_probabilistic(spark):
    nodes = infer(spark, [{"val": i, "label": "x"} for i in range(95)] + [{"val": 1.5, "label": "x"}] * 5)
    assert nodes["val"]["observed_types"] == ["integer", "number"] and nodes["val"]["type"] == "number"
    assert nodes["label"]["observed_types"] is None


def test_mostly_integer_becomes_number(spark):
    bodies = [{"zip": 1}] * 96 + [{"zip": "1"}] * 4
    assert infer(spark, bodies)["zip"]["type"] == "number"
    nested = [{"a": b} for b in bodies]
    assert infer(spark, nested)["a.zip"]["type"] == "number"
    assert infer(spark, nested, top_level_only=True)["a.zip"]["type"] == "integer|string"


def test_empty(spark):
    assert infer(spark, ["[1]", "{bad", "5", "", "null"]) == {}


def test_boolean_is_not_integer(spark):
    nodes = infer(spark, [{"flag": True, "val": 1}] * 3)
    assert nodes["flag"]["type"] == "boolean" and nodes["val"]["type"] == "integer"


def test_nullable(spark):
    bodies = [{"field": "a"}, {"field": "b"}, {"field": None}]
    node = infer(spark, bodies)["field"]
    assert (node["type"], node["nullable"], node["required"]) == ("string", True, True)
    node = infer(spark, bodies, union_mode="reference")["field"]
    assert (node["type"], node["nullable"]) == ("", False)


def test_string_array(spark):
    nodes = infer(spark, [{"tags": ["a", "b"]}, {"tags": []}])
    assert nodes["tags"]["type"] == "array" and nodes["tags[]"]["type"] == "string"


def test_number_kinds(spark):
    nodes = infer(spark, ['{"a":1.0,"b":1,"c":12345678901234567890123,"d":1e5}'])
    assert [nodes[p]["type"] for p in "abcd"] == ["number", "integer", "integer", "number"]


def test_dotted_names_do_not_collide(spark):
    body = ['{"a.b":1,"a":{"b":"x"}}']
    nodes = infer(spark, body)
    assert nodes["a\\.b"]["type"] == "integer" and nodes["a.b"]["type"] == "string"
    flat = traffic_nodes(samples(spark, body), raw_paths=True)
    assert [r["path"] for r in flat.collect()].count("a.b") == 2


def test_depth_bound_is_reported(spark):
    body = "[1]"
    for _ in range(9):
        body = '{"a":' + body + "}"
    flat = traffic_nodes(samples(spark, [body]), max_depth=8)
    assert flat.filter("truncated").count() == 1
    # without a bound, no document is cut
    deeper = traffic_nodes(samples(spark, [body]))
    assert deeper.filter("truncated").count() == 0 and deeper.agg({"depth": "max"}).first()[0] == 10


def test_empty_containers_are_not_truncated(spark):
    flat = traffic_nodes(samples(spark, ['{"a":{},"b":[]}']), max_depth=1)
    assert flat.filter("truncated").count() == 0
    flat = traffic_nodes(samples(spark, ['{"a":{"x":1},"b":[1]}']), max_depth=1)
    assert flat.filter("truncated").count() == 2


def test_stats_are_additive(spark):
    a, b = [{"x": i} for i in range(5)], [{"x": "s", "y": 1}] * 3
    merged = S.merge_stats(S.path_stats(traffic_nodes(samples(spark, a))).union(S.path_stats(traffic_nodes(samples(spark, b)))))
    whole = S.path_stats(traffic_nodes(samples(spark, a + b)))
    cols = [*TRAFFIC_KEYS, "path", *S.COUNT_COLS]
    assert sorted(merged.select(cols).collect()) == sorted(whole.select(cols).collect())


def test_merged_sketches(spark):
    halves = [[{"s": v, "id": f"{h}{i}"} for i in range(60) for v in "ab"[: h + 1]] for h in (0, 1)]
    daily = [S.path_stats(traffic_nodes(samples(spark, b)), values=True) for b in halves]
    nodes = I.schema_nodes(S.merge_stats(daily[0].union(daily[1])))
    got = {r["path"]: r["enum_suggestion"] for r in nodes.collect()}
    assert got == {"s": ["a", "b"], "id": None}


def test_document(spark):
    bodies = [{"id": 1, "user": {"name": "a"}, "tags": ["x"]}, {"id": 2, "user": {"name": None}}]
    nodes = I.schema_nodes(S.path_stats(traffic_nodes(samples(spark, bodies))))
    doc = json.loads(I.schema_documents(nodes).first()["schema_json"])
    assert doc["openapi"] == "3.1.0" and doc["required"] == ["id", "user"]
    assert doc["properties"]["tags"] == {"type": "array", "items": {"type": "string"}}
    assert doc["properties"]["user"]["properties"]["name"]["type"] == "string" and doc["properties"]["user"]["properties"]["name"]["nullable"]
