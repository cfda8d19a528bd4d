"""Record dumps and Avro records."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlake.sources import avro_wire as W
from driftlake.sources import record_dump as R

RECORD = "timestamp timestamp, key binary, value binary, headers array<struct<key:string,value:binary>>"


def records(spark, low, high):
    rows = spark.range(low, high).selectExpr(
        "timestamp_seconds(1704067200 + id) AS timestamp", "CASE WHEN id % 5 <> 0 THEN encode(concat('k', id % 7), 'UTF-8') END AS key",
        "encode(CAST(id AS STRING), 'UTF-8') AS value", "array(named_struct('key', 'n', 'value', encode(CAST(id AS STRING), 'UTF-8'))) AS headers",
    )
    return rows


def test_dump_in_batch(spark, tmp_path):
    path = str(tmp_path / "dump")
    R.write_dump(records(spark, 0, 500), path, 3, ["timestamp", "value"])
    back = R.read_dump(spark, path, recordsPerTask="40")
    assert back.rdd.getNumPartitions() > 3
    rows = back.collect()
    assert sorted(int(bytes(r.value)) for r in rows) == list(range(500)) and bytes(rows[0].headers[0].value) == bytes(rows[0].value)
    for p in {r.partition for r in rows}:
        mine = sorted((r.offset, r.timestamp) for r in rows if r.partition == p)
        assert [o for o, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)
    assert all(len({r.partition for r in rows if r.key == k}) == 1 for k in {r.key for r in rows})


def test_restarted_stream_repeats_nothing(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("dump", "out", "checkpoint"))

    def run():
        stream = R.stream_dump(spark, path, recordsPerTask="50").withColumn("n", F.col("value").cast("string").cast("long"))
        stream.select("n", "partition", "offset").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(out).collect())

    R.write_dump(records(spark, 0, 300), path, 2, ["timestamp", "value"])
    assert run() == list(range(300)) and run() == list(range(300))
    ends = {int(k): v for k, v in R._Segments(path).ends().items()}
    R.write_dump(records(spark, 300, 450), path, 2, ["timestamp", "value"], first=ends)
    assert run() == list(range(450))
    assert run() == list(range(450))


def test_empty_dump(spark, tmp_path):
    assert R.read_dump(spark, str(tmp_path / "none")).count() == 0


def reference_record(row):
    out = b""
    for item, (_, kind) in zip(row, W.FIELDS):
        raw = item.encode() if kind == "string" else b""
        n = len(raw) if kind == "string" else item
        n = (n << 1) ^ (n >> 63)
        n &= 2**64 - 1
        while n > 127:
            out += struct.pack("B", n & 127 | 128)
            n >>= 7
        out += struct.pack("B", n) + raw
    return out


def test_decoding_equals_encoding():
    rng = random.Random(1)
    rows = [tuple("".join(rng.choice("aé中😀 ") for _ in range(rng.randrange(90))) if k == "string" else rng.choice((0, -1, 1, rng.randrange(-(2**31), 2**31) if k == "int" else rng.randrange(-(2**63), 2**63))) for _, k in W.FIELDS) for _ in range(500)]
    columns, why = W.decode_batch(pa.array([reference_record(r) for r in rows]))
    assert why.null_count == len(rows)
    assert list(zip(*(columns[f].to_pylist() for f, _ in W.FIELDS))) == rows


@pytest.mark.parametrize("value, reason", [
    (None, "null"), (b"", "service_id is cut off"), (b"\x02", "service_id is cut off"), (b"\x01", "service_id is cut off"), (b"\xff" * 12, "service_id is cut off"),
    (b"\x02\xff" + b"\x00" * 7, "service_id is no UTF-8"), (b"\x00" * 5 + b"\xff\xff\xff\xff\x7f\x00\x00", "status_code is too large"), (b"\x00" * 9, "bytes left over"),
    (b"\x00" * 7, "sampled_at is cut off"), (b"\x00" * 8, None),
])
def test_bad_records(value, reason):
    good = reference_record(("a", "b", "c", "", "", 1, 2, 3))
    _, why = W.decode_batch(pa.array([good, value, good], pa.binary()))
    assert why.to_pylist() == [None, reason, None]


def test_defaults_framing_and_clashing_names(spark):
    short = [f for f in W.FIELDS if f[0] not in W.DEFAULTS]
    body = b"".join(b"\x02" + c for c in (b"s", b"e", b"m")) + b"\x90\x03" + b"\x80\xd0\x0f" * 2
    rows = spark.createDataFrame([(1, b"\0\0\0\0\7" + body, "x"), (2, body, "y"), (3, None, "z")], "id long, value binary, service_id string")
    good, bad = W.decode_avro(rows, keep=["id"], fields=short, framed=True)
    r, = good.collect()
    assert (r.id, r.service_id, r.captured_at.isoformat()) == (1, "s", "1970-01-01T00:02:08")
    assert r.request_schema_sample == "" and r.status_code == 200
    assert sorted((x.id, x.error) for x in bad.collect()) == [(2, "no schema number"), (3, "null")]
    with pytest.raises(ValueError):
        W.decode_avro(rows, fields=short[1:])


def test_dump_whose_readers_see_other_pieces(spark, tmp_path):
    conf = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        wide = records(spark, 0, 4000).withColumn("value", F.expr("encode(concat(value, repeat(md5(value), 8)), 'UTF-8')"))
        R.write_dump(wide, str(tmp_path / "dump"), 3, ["timestamp", "value"])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.parquet(str(tmp_path / "dump")).select("partition", "offset", "timestamp").collect()
    assert len(rows) == 4000
    for p in {r.partition for r in rows}:
        mine = sorted((r.offset, r.timestamp) for r in rows if r.partition == p)
        assert [o for o, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)
