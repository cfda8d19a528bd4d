"""Contract life cycle, documents to nodes, protobuf corpus, sources and sinks."""

from datetime import datetime

from pyspark.sql import functions as F

from driftlake.operators import contracts as C
from driftlake.operators import proto as P
from driftlake.sources import sinks as K
from driftlake.sources import traffic as T

CONTRACT = "id string, provider_id string, consumer_id string, endpoint string, version int, source string, status string, schema_json string"


def contract(id, version=1, source="manual", status="active", endpoint="/e"):
    return (id, "p", "c", endpoint, version, source, status, "{}")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), CONTRACT)


def test_latest_and_pairs(spark):
    t = table(
        spark, contract("a", 1), contract("b", 2), contract("c", 3, status="archived"), contract("d", 5, "inferred"),
        contract("e", 1, endpoint="/only-declared"),
    )
    assert {r["endpoint"]: r["id"] for r in C.latest(t).collect()} == {"/e": "d", "/only-declared": "e"}
    assert [(r["baseline_id"], r["inferred_id"]) for r in C.pairs(t).collect()] == [("b", "d")]


def test_import_versions(spark):
    t = table(spark, contract("a", 4), contract("old", 2, status="archived"))
    asked = spark.createDataFrame(
        [("n1", "p", "c", "/e", "{}"), ("n2", "p", "c", "/e", "{}"), ("n3", "p", "c", "/new", "{}"), ("bad", "p", "", "/e", "{}")],
        "id string, provider_id string, consumer_id string, endpoint string, schema_json string",
    ).withColumn("source", F.lit(None).cast("string"))
    got = {r["id"]: (r["version"], r["status"], r["source"]) for r in C.import_contracts(t, asked).collect()}
    assert got == {
        "a": (4, "superseded", "manual"), "old": (2, "archived", "manual"), "n1": (5, "superseded", "manual"),
        "n2": (6, "active", "manual"), "n3": (1, "active", "manual"),
    }


def test_archive_keeps_rows(spark):
    t = table(spark, contract("a"), contract("b"))
    got = {r["id"]: r["status"] for r in C.archive(t, t.filter("id = 'a'").select("id")).collect()}
    assert got == {"a": "archived", "b": "active"}


def test_nodes_of_odd_documents(spark):
    docs = spark.createDataFrame(
        [
            (1, '{"properties":{"l":{"type":"array","items":{"type":"array","items":{"type":"string"}}}}}'),
            (2, '{"properties":{"x":{"properties":{"y":{"type":"string"}},"type":"string"},"e":{"enum":[1,null,"a"]}}}'),
            (3, "not json"), (4, '{"type":"object"}'),
        ],
        "k int, schema_json string",
    )
    got = {(r["k"], r["path"]): (r["type"], r["enum_values"]) for r in C.contract_to_nodes(docs, ["k"]).collect()}
    assert got == {
        (1, "l"): ("array", []), (1, "l[]"): ("array", []), (2, "x"): ("string", []), (2, "x.y"): ("string", []),
        (2, "e"): ("object", ["1", "null", "a"]),
    }


def test_proto(spark):
    text = """
    // message Ghost { string no = 1; }
    message A {
      map<string, B> by_name = 1;
      map<string,int64> n = 2;
      repeated B bs = 3;
      oneof pick { B b = 4; Kind kind = 5; }
      message Inner { string s = 1; }
      Inner inner = 6;
      .google.protobuf.Any any = 7;
    }
    enum Kind { X = 0; Y = -1; }
    message B { optional A back = 1; }
    """
    nodes = P.proto_nodes(spark.createDataFrame([("f", text)], "file string, proto string"), ["file"])
    got = {(r["message"], r["path"]): r for r in nodes.collect()}
    assert {k for k in got} == {
        ("A", "by_name"), ("A", "n"), ("A", "bs"), ("A", "bs[]"), ("A", "b"), ("A", "kind"), ("A", "inner"), ("A", "any"),
        ("Inner", "s"), ("B", "back"),
    }
    assert got["A", "n"]["value_type"] == "integer" and got["A", "by_name"]["value_type"] == "object"
    assert got["A", "kind"]["enum_values"] == ["X", "Y"] and got["A", "kind"]["oneof"] == "pick"
    assert got["A", "bs[]"]["ref"] == "B" and got["A", "b"]["ref"] == "B" and got["Inner", "s"]["outer"] == "A"
    paths = {r["path"] for r in P.expand_refs(nodes, ["file"], "A", depth=2).collect()}
    assert {"bs[].back", "inner.s", "bs[].back.kind"} <= paths


def test_ndjson(spark):
    lines = ["", "  ", "{cut", '{"timestamp":"2024-01-01T00:00:07Z","source":"a","status_code":200,"request_headers":{"k":"v"}}', "[]"]
    got = T.parse_ndjson(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    assert [(r["source"], r["sampled_at"], r["request_headers"]) for r in got] == [("a", datetime(2024, 1, 1, 0, 0, 7), {"k": "v"})]


def test_envelope(spark):
    rows = spark.createDataFrame([({}, None, None), ({"service_id": "s", "method": "PUT"}, bytearray(b"k"), bytearray(b"{}"))],
                                 "headers map<string,string>, key binary, value binary")
    got = [tuple(r) for r in T.decode_envelope(rows).collect()]
    assert got == [("unknown", "/unknown", "GET", "{}"), ("s", "/unknown", "PUT", "{}")]


def test_raw_sample_replay_prunes_dates(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", "e", "GET", '{"a":1}', datetime(2024, 1, d, 3)) for d in range(1, 6)],
        "service_id string, endpoint string, method string, body string, sampled_at timestamp_ntz",
    )
    path = str(tmp_path / "raw")
    K.write_raw_samples(K.raw_samples(rows), path)
    start, end = F.lit("2024-01-02 03:00:00").cast("timestamp_ntz"), F.lit("2024-01-04 02:59:59").cast("timestamp_ntz")
    got = K.replay(K.read_raw_samples(spark, path), start, end)
    assert [r["ingested_at"].day for r in got.collect()] == [3, 2]
    assert "PartitionFilters: [isnotnull(ingest_date" in got._jdf.queryExecution().toString()
