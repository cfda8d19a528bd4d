"""Classifier rules, their precedence, and the hand-derived goldens."""

import json

import pytest

from driftlake.functions.nodes import TRAFFIC_KEYS, traffic_nodes
from driftlake.operators import contracts as C
from driftlake.operators import diff as D
from driftlake.operators import infer as I
from driftlake.operators import stats as S

KEYS = list(TRAFFIC_KEYS)
KEY = ("svc", "/e", "POST")
NODE = "path string, type string, required boolean, enum_values array<string>, format string, pattern string, nullable boolean"


def node(path="a", type="string", required=False, enum_values=(), format=None, pattern=None, nullable=False):
    return (path, type, required, list(enum_values), format, pattern, nullable)


def table(spark, *nodes):
    return spark.createDataFrame([(*KEY, *n) for n in nodes], f"service_id string, endpoint string, method string, {NODE}")


def verdict(spark, old, new):
    filler = node("zz")
    found = D.schema_diff(
        table(spark, filler, *([old] if old else [])), table(spark, filler, *([new] if new else [])), KEYS
    ).collect()
    return [(r["severity"], r["description"]) for r in found]


@pytest.mark.parametrize(
    "old, new, want",
    [
        (node(required=True), None, [("BREAKING", "Required field removed: a")]),
        (node(), None, [("WARNING", "Optional field removed: a")]),
        (None, node(required=True), [("BREAKING", "New required field added: a")]),
        (None, node(), [("ADDITIVE", "New optional field added: a")]),
        (node(required=True), node(), [("BREAKING", "Required field made optional: a")]),
        (node(), node(required=True), []),
        (node(type="integer"), node(type="number"), [("ADDITIVE", "Field type changed from integer to number: a")]),
        (node(type="number"), node(type="integer"), [("BREAKING", "Field type changed from number to integer: a")]),
        (node(type="boolean"), node(type="string"), [("BREAKING", "Field type changed from boolean to string: a")]),
        (node(enum_values="xy"), node(enum_values="x"), [("BREAKING", "Enum values removed: a")]),
        (node(enum_values="xy"), node(enum_values="xyz"), [("ADDITIVE", "Enum values added: a")]),
        (node(), node(enum_values="x"), [("ADDITIVE", "Enum values added: a")]),
        (node(enum_values="xy"), node(enum_values="yx"), []),
        (node(enum_values="xy"), node(enum_values="xz"), [("BREAKING", "Enum values removed: a")]),
        (node(format="date"), node(format="time"), [("BREAKING", "Format changed from date to time: a")]),
        (node(format="date"), node(), []),
        (node(pattern="^a"), node(pattern="^b"), [("BREAKING", "Pattern changed: a")]),
        (node(), node(nullable=True), [("WARNING", "Response schema now nullable: a")]),
        (node(nullable=True), node(), []),
        # the first rule that matches decides
        (node(required=True), node(type="integer"), [("BREAKING", "Required field made optional: a")]),
        (node(type="integer", enum_values="x"), node(type="number"), [("ADDITIVE", "Field type changed from integer to number: a")]),
        (node(enum_values="x", format="p"), node(enum_values="xy", format="q"), [("ADDITIVE", "Enum values added: a")]),
        (node(format="p", pattern="1"), node(format="q", pattern="2"), [("BREAKING", "Format changed from p to q: a")]),
        (node(pattern="1"), node(pattern="2", nullable=True), [("BREAKING", "Pattern changed: a")]),
    ],
)
def test_rules(spark, old, new, want):
    assert verdict(spark, old, new) == want


DEMO = {
    "type": "object", "required": ["order_id", "amount", "currency", "items", "user"],
    "properties": {
        "order_id": {"type": "string"}, "amount": {"type": "number"}, "currency": {"type": "string"},
        "items": {"type": "array", "items": {"type": "string"}},
        "user": {"type": "object", "required": ["name", "email"], "properties": {"name": {"type": "string"}, "email": {"type": "string"}}},
    },
}
LOOSE = {"properties": {k: DEMO["properties"][k] for k in ("order_id", "amount", "currency", "items")}}
GOOD = [{"order_id": f"ord_{i}", "amount": 100, "currency": "USD", "items": ["item1", "item2"], "user": {"name": "n", "email": "e"}} for i in range(1000)]
BAD = [{"order_id": f"ord_{i}", "amount": 100, "items": ["item1"]} for i in range(200)]
VALID = [{**g, "amount": 99.99 + i} for i, g in enumerate(GOOD[:100])]


def drift(spark, contract, bodies):
    docs = spark.createDataFrame([(*KEY, json.dumps(contract))], "service_id string, endpoint string, method string, schema_json string")
    rows = [(*KEY, json.dumps(b)) for b in bodies]
    samples = spark.createDataFrame(rows, "service_id string, endpoint string, method string, body string")
    inferred = I.schema_nodes(S.path_stats(traffic_nodes(samples, values=False)))
    compared = D.compare(C.contract_to_nodes(docs, KEYS), inferred, KEYS)
    row = D.drift_scores(compared, KEYS).first()
    return row["breaking"], row["warning"], row["additive"], row["drift_score"]


@pytest.mark.parametrize(
    "contract, bodies, want",
    [
        (DEMO, GOOD, (1, 0, 0, 100)),
        (DEMO, BAD, (5, 0, 0, 500)),
        (DEMO, GOOD + BAD, (3, 0, 0, 300)),
        ({**DEMO, "properties": {**DEMO["properties"], "amount": {"type": "integer"}}}, GOOD, (0, 0, 0, 0)),
        (LOOSE, [{**b, "amount": 1.5} for b in BAD], (0, 1, 0, 10)),
        (LOOSE, VALID, (3, 0, 0, 300)),
        ({"required": ["a"], "properties": {"a": {"type": "integer"}}}, [{"a": 1.5}], (0, 0, 1, 1)),
    ],
)
def test_goldens(spark, contract, bodies, want):
    assert drift(spark, contract, bodies) == want


def test_no_drift_against_itself_and_symmetry(spark):
    a = table(spark, node("p", required=True), node("q", enum_values="xy"), node("r"))
    b = table(spark, node("p", required=True), node("s"))
    assert D.schema_diff(a, a, KEYS).count() == 0
    removed = {r["path"] for r in D.paths_missing(a, b, KEYS).collect()}
    added = {r["path"] for r in D.paths_missing(b, a, KEYS).collect()}
    assert (removed, added) == ({"q", "r"}, {"s"})
    assert {r["path"] for r in D.path_union(a, b, KEYS).collect()} == {"p", "q", "r", "s"}


def test_key_on_one_side_is_skipped(spark):
    a = table(spark, node("p"))
    other = a.withColumn("service_id", a["method"])
    assert D.schema_diff(a, other, KEYS).count() == 0
    assert D.schema_diff(a, other, KEYS, require_both=False).count() == 2


def test_events_only_with_violations(spark):
    a, b = table(spark, node("p", required=True)), table(spark, node("q"))
    event = D.drift_events(D.schema_diff(a, b, KEYS), KEYS).collect()
    assert [(e["drift_score"], len(e["violations"])) for e in event] == [(101, 2)]
    assert D.drift_events(D.schema_diff(a, a, KEYS), KEYS).count() == 0


def test_doc_diff(spark):
    cols = "k int, path string, value_str string"
    old = spark.createDataFrame([(1, "a", "1"), (1, "b", None), (1, "c", "x")], cols)
    new = spark.createDataFrame([(1, "a", "2"), (1, "b", None), (1, "d", "y")], cols)
    lines = D.doc_diff(old, new, ["k"])
    assert {r["path"]: r["change"] for r in lines.collect()} == {"a": "changed", "b": "unchanged", "c": "removed", "d": "added"}
    assert D.doc_severity(lines, ["k"]).first()["severity"] == "BREAKING"
    assert D.doc_severity(lines.filter("change <> 'removed'"), ["k"]).first()["severity"] == "WARNING"
    assert D.doc_severity(lines.filter("change = 'unchanged'"), ["k"]).first()["severity"] == "ADDITIVE"
