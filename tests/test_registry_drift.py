"""The drift cycle: only changed pairs are evaluated, errors stay with their pair."""

from driftlake.operators import registry_drift as R
from driftlake.streaming.registry import current, drift_cycles

COLUMNS = "id string, provider_id string, consumer_id string, endpoint string, version int, source string, status string, schema_json string, changed_at long"
DOC = '{"required":["a"],"properties":{"a":{"type":"%s"}}}'


def row(id, key, version, source, schema, at, status="active"):
    return (id, key, "c", "/e", version, source, status, schema, at)


def test_errors_stay_with_their_pair(spark):
    rows = [row("b1", "p", 1, "manual", DOC % "string", 1), row("i1", "p", 1, "inferred", DOC % "integer", 1)]
    rows += [row("b2", "q", 1, "manual", "{", 1), row("i2", "q", 1, "inferred", DOC % "integer", 1), row("b3", "r", 1, "manual", None, 1), row("i3", "r", 1, "inferred", "[1]", 1)]
    violations, rejects = R.evaluate(R.document_pairs(spark.createDataFrame(rows, COLUMNS)))
    assert [(v.provider_id, v.path, v.severity) for v in violations.collect()] == [("p", "a", "BREAKING")]
    assert sorted((r.side, r.contract_id) for r in rejects.collect()) == [("baseline", "b2"), ("baseline", "b3"), ("inferred", "i3")]


def test_cycles(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / n) for n in ("source", "state", "checkpoint"))

    def cycle(rows):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(COLUMNS).parquet(source)
        job = drift_cycles(stream, folder, checkpoint, trigger={"availableNow": True})
        job.awaitTermination()
        last = job.lastProgress["batchId"]
        evaluated = {r.provider_id for r in spark.read.parquet(f"{folder}/changed/batch={last}").collect()}
        return evaluated, sorted((v.provider_id, v.baseline_id, v.severity) for v in current(spark, folder, last, "violations").collect())

    both = lambda key, kind, at: [row(f"b-{key}", key, 1, "manual", DOC % "string", at), row(f"i-{key}", key, 1, "inferred", DOC % kind, at)]
    assert cycle(both("p", "integer", 1) + both("q", "string", 1)) == ({"p", "q"}, [("p", "b-p", "BREAKING")])
    # the same documents again: nothing is evaluated, results stay
    assert cycle(both("p", "integer", 2)) == (set(), [("p", "b-p", "BREAKING")])
    # a new declared version of p; q's document changes under its old id
    assert cycle([row("b-p2", "p", 2, "manual", DOC % "integer", 3), row("i-q", "q", 1, "inferred", DOC % "number", 3)]) == ({"p", "q"}, [("q", "b-q", "BREAKING")])
    # p's new version is archived, so the old one counts again; q loses its inferred side
    assert cycle([row("b-p2", "p", 2, "manual", DOC % "integer", 4, "archived"), row("i-q", "q", 1, "inferred", DOC % "number", 4, "archived")]) == ({"p"}, [("p", "b-p", "BREAKING")])
