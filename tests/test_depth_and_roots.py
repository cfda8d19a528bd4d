"""Documents of any depth, sides without fields, awkward names, and records that must not end a job."""

import json

import pytest
from pyspark.sql import functions as F

from driftlake.functions import deep_json
from driftlake.functions import nodes as N
from driftlake.functions.nodes import TRAFFIC_KEYS, json_nodes, traffic_nodes
from driftlake.functions.normalize import normalize_document
from driftlake.functions.scalars import window_seconds
from driftlake.functions.scrub import scrub_json
from driftlake.operators import contracts as C
from driftlake.operators import diff as D
from driftlake.operators import infer as I
from driftlake.operators import stats as S
from driftlake.session import spread
from driftlake.sources import traffic as T

KEYS = list(TRAFFIC_KEYS)


def samples(spark, bodies):
    return spark.createDataFrame([("s", "/e", "GET", b) for b in bodies], "service_id string, endpoint string, method string, body string")


def inferred(spark, bodies):
    return I.schema_nodes(S.path_stats(traffic_nodes(samples(spark, bodies))), with_root=True)


def contract(spark, document, **options):
    docs = spark.createDataFrame([("s", "/e", "GET", document)], "service_id string, endpoint string, method string, schema_json string")
    return C.contract_to_nodes(docs, KEYS, with_root=True, nested_items=True, **options)


def nested(levels, leaf):
    for _ in range(levels):
        leaf = {"a": leaf}
    return leaf


def walk(value, path=""):
    yield path
    kids = [(f"{path}.{k}" if path else k, v) for k, v in value.items()] if isinstance(value, dict) else [(path + "[]", v) for v in value] if isinstance(value, list) else []
    for at, v in kids:
        yield from walk(v, at)


def test_payload_nodes_of_any_depth(spark, monkeypatch):
    for body in (nested(13, 1), nested(7, [[[{"x": [1.10, {"y": None}]}]]]), nested(300, "x")):
        got = json_nodes(samples(spark, [json.dumps(body)]), KEYS, doc="try_parse_json(body)").collect()
        assert sorted(r.path for r in got) == sorted(walk(body)) and not any(r.truncated for r in got)
    body = json.dumps(nested(6, [{"ts": 5, "v": "1", "u.w": [True, None, "é", 1.50]}]))
    shallow = json_nodes(samples(spark, [body]), KEYS, doc="try_parse_json(body)", mask_volatile=True)
    monkeypatch.setattr(N, "UNROLLED", 2)
    early = json_nodes(samples(spark, [body]), KEYS, doc="try_parse_json(body)", mask_volatile=True)
    assert sorted(map(tuple, shallow.collect()), key=str) == sorted(map(tuple, early.collect()), key=str)


def test_payloads_are_unfolded_once_and_without_python(spark):
    flat = traffic_nodes(samples(spark, ['{"a":{"b":[1]}}', "[1]", "{"]).repartition(3))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("try_parse_json") + plan.count("ParseJson") <= plan.count("aggregate(") + 1
    assert "Filter (size(" not in plan and sorted(r.path for r in flat.collect()) == ["", "a", "a.b", "a.b[]"]


def test_wide_and_deep_payloads(spark):
    body = {"w": [nested(9, i) for i in range(50)], "s": "[[{{", "e": [{}, [], [[]], "x", None, 1.5, 10**20], "d": nested(5, {})}
    got = json_nodes(samples(spark, [json.dumps(body)]), KEYS, doc="try_parse_json(body)").collect()
    assert sorted(r.path for r in got) == sorted(walk(body))
    assert sorted(r.json_type for r in got if r.path == "e[]") == ["array", "array", "integer", "null", "number", "object", "string"]
    assert {r.value_str for r in got if r.depth == 11} == {str(i) for i in range(50)}


def test_contract_nodes_of_any_depth(spark):
    def deep(levels, leaf):
        for k in range(levels):
            leaf = {"type": "object", "properties": {f"p.{k}": leaf}, "required": [f"p.{k}"]}
        return leaf

    rows = {"type": "array", "nullable": True, "items": {"type": "array", "items": {"properties": {"q": {"type": ["a", "b"], "enum": [1, True, None]}}}}}
    for document in (deep(12, rows), deep(3, rows)):
        whole = contract(spark, json.dumps(document)).collect()
        early = contract(spark, json.dumps(document), max_depth=2).collect()
        assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, early), key=str)
    paths = {r.path for r in whole}
    assert paths == {"", "p\\.2", "p\\.2.p\\.1", *("p\\.2.p\\.1.p\\.0" + x for x in ("", "[]", "[][]", "[][].q"))}


def test_lost_and_empty_sides_are_reported(spark):
    want = contract(spark, '{"type":"object","required":["a"],"properties":{"a":{"type":"string"},"b":{"type":"string"}}}')
    found = {(r.path, r.severity) for r in D.schema_diff(want, inferred(spark, ["{}", "{}"]), KEYS).collect()}
    assert found == {("a", "BREAKING"), ("b", "WARNING")}
    empty = contract(spark, '{"type":"object","properties":{}}')
    found = {(r.path, r.severity) for r in D.schema_diff(empty, inferred(spark, ['{"n":1}']), KEYS).collect()}
    assert found == {("n", "BREAKING")}
    assert D.schema_diff(want, inferred(spark, ["[1]"]), KEYS).count() == 0


def test_dots_and_nested_arrays_conform(spark):
    want = contract(spark, '{"required":["a.b","m"],"properties":{"a.b":{"type":"string"},"m":{"type":"array","items":{"type":"array","items":{"required":["q"],"properties":{"q":{"type":"integer"}}}}}}}')
    assert D.schema_diff(want, inferred(spark, ['{"a.b":"x","m":[[{"q":1}]]}'] * 2), KEYS).count() == 0


def test_inferred_document_reads_back(spark):
    nodes = inferred(spark, ['{"a":null,"b":{"c":[1]}}', '{"a":"x","b":{"c":[2]}}'])
    back = C.contract_to_nodes(I.schema_documents(nodes.filter("path <> ''")), KEYS, with_root=True)
    assert D.schema_diff(back, nodes, KEYS).count() == 0


def test_import_keeps_pairs(spark):
    rows = [("1", "p", "c", "/e", 1, "manual", "active"), ("2", "p", "c", "/e", 2, "inferred", "active")]
    table = spark.createDataFrame(rows, "id string, provider_id string, consumer_id string, endpoint string, version int, source string, status string")
    new = spark.createDataFrame([("3", "p", "c", "/e", "{}", None)], "id string, provider_id string, consumer_id string, endpoint string, schema_json string, source string")
    assert [(r.baseline_id, r.inferred_id) for r in C.pairs(C.import_contracts(table, new)).collect()] == [("3", "2")]


def test_enums_with_an_empty_string(spark):
    bodies = ['{"k":""}', '{"k":"x"}'] * 60
    assert [(r.path, r.enum_values) for r in S.enum_values(traffic_nodes(samples(spark, bodies))).collect()] == [("k", ["", "x"])]
    many = [json.dumps({"k": "" if i == 0 else f"v{i}"}) for i in range(21)] * 6
    assert S.enum_values(traffic_nodes(samples(spark, many))).count() == 0


def test_bad_records_do_not_end_the_job(spark):
    lines = spark.createDataFrame([('{"service_id":"s","timestamp":"n/a"}',), ('{"service_id":"s","timestamp":"2024-01-01T00:00:00Z"}',)], "value string")
    assert sorted(r.sampled_at is None for r in T.parse_ndjson(lines).collect()) == [False, True]
    wire = spark.createDataFrame([('{"service_id":"s","timestamp":9223372036854775807,"sampled_at":1}',)], "value string")
    row = T.decode_wire(wire).first()
    assert row.captured_at is None and row.sampled_at is not None
    records = spark.createDataFrame([(None, bytearray(b"ok\xff"), [("a", bytearray(b"1")), ("a", bytearray(b"2\xfe"))])], "key binary, value binary, headers array<struct<key:string,value:binary>>")
    out = T.decode_envelope(records.withColumn("headers", T.header_map(F.col("headers")))).first()
    assert out.payload == "ok�"
    assert records.select(T.header_map(F.col("headers")).alias("m")).first().m == {"a": "2�"}
    spans = spark.createDataFrame([("99999999999999999999d",), ("9223372036854775807d",), ("2h",)], "w string")
    assert [r[0] for r in spans.select(window_seconds(F.col("w"))).collect()] == [86400, 86400, 7200]
    deep = spark.createDataFrame([("[" * 100_000 + "]" * 100_000,)], "b string")
    assert deep.select(scrub_json("b").alias("b"), normalize_document(F.col("b")).alias("n")).first().b.startswith("[[")


def test_deep_bodies_are_scrubbed_and_masked(spark):
    body = lambda levels: '[{"a":' * levels + '{"ts":5,"mail":"joe@example.com","n":[1.5,null,"é"]}' + "}]" * levels
    for levels in (1_000, 2_000, 50_000):  # two levels each
        row = spark.createDataFrame([(body(levels),)], "b string").select(scrub_json("b").alias("s"), normalize_document(F.col("b")).alias("n")).first()
        assert row.s == body(levels).replace("joe@example.com", "[REDACTED_EMAIL]")
        assert row.n == body(levels).replace('"ts":5', '"ts":"__NORMALIZED_TIMESTAMP__"')


def test_deep_reader_equals_the_shallow_one():
    for text in (' {"a" : [1, -2.5e3, {"b":{}, "c":[ ]}, "x\\u00e9\\n"], "a":true} ', "[]", "3", '"s"', "[[null,false],[]]"):
        assert deep_json._parse(text) == json.loads(text)
    for text in ("", "[1,]", '{"a" 1}', "[1", '{"a":1,}', "[] []", "{1:2}", "]", '{"a":1]'):
        with pytest.raises(ValueError):
            deep_json._parse(text)


def test_no_task_takes_more_rows_when_a_table_grows(spark, tmp_path):
    for rows in (2_000, 20_000):
        path = str(tmp_path / str(rows))
        spark.range(rows).coalesce(1).write.parquet(path)
        dealt = spread(spark.read.parquet(path), 500).groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in dealt.collect()) <= 600
