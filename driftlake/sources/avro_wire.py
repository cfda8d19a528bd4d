"""Traffic samples as Avro records: field by field over all rows of a batch, without a per-row parser.

A value is the binary form of one record, or that behind the five bytes of a schema registry (a zero and the schema's
number). Fields are read as the writer's schema lists them; fields that it lacks get the reader's default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from driftlake.sources.traffic import from_millis

# Fields of the wire record in order, and the defaults of those that have one.
FIELDS = (
    ("service_id", "string"), ("endpoint", "string"), ("method", "string"), ("request_schema_sample", "string"),
    ("response_schema_sample", "string"), ("status_code", "int"), ("ts", "long"), ("sampled_at", "long"),
)
DEFAULTS = {"request_schema_sample": "", "response_schema_sample": ""}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_SQL = {"string": "string", "int": "int", "long": "bigint"}


def _varint(data: np.ndarray, at: np.ndarray, end: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag numbers, positions behind them, rows that have one) at the positions of the live rows."""
    value = np.zeros(len(at), np.uint64)
    at, ok, more = at.copy(), live.copy(), live.copy()
    for i in range(10):
        short = more & (at >= end)
        ok &= ~short
        more &= ~short
        byte = data[np.where(more, at, 0)].astype(np.uint64)
        if i == 9:
            # the tenth byte holds the last bit of 64
            ok &= ~(more & (byte > 1))
        value |= np.where(more, (byte & np.uint64(0x7F)) << np.uint64(7 * i), np.uint64(0))
        at += more
        more &= byte >= 0x80
        if not more.any():
            break
    ok &= ~more
    return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64), at, ok


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray, ok: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Strings of the rows that are fine, and which of these hold proper UTF-8."""
    size = np.where(ok, size, 0)
    bounds = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    index = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - at, size)
    body = pa.py_buffer(np.ascontiguousarray(data[index]))
    offsets = pa.py_buffer(bounds.astype(np.int32))
    out = pa.Array.from_buffers(pa.string(), len(at), [None, offsets, body])
    try:
        out.validate(full=True)
        return out, ok
    except pa.ArrowInvalid:
        rows = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, body]).to_pylist()
    good = np.array([_is_text(r) for r in rows], bool)
    return pa.array([r.decode() if g else "" for r, g in zip(rows, good, strict=True)], pa.string()), ok & good


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def decode_batch(values: pa.Array, fields: Sequence[tuple[str, str]] = FIELDS, framed: bool = False) -> tuple[dict[str, pa.Array], pa.Array]:
    """(a column per field of the writer, why a row is bad or null)."""
    n = len(values)
    values = pa.concat_arrays([values.cast(pa.large_binary())])
    offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1)
    raw = values.buffers()[2]
    data = np.concatenate([np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), np.zeros(1, np.uint8)])
    at, end = offsets[:-1].copy(), offsets[1:].copy()
    why = np.full(n, None, object)
    ok = ~np.asarray(values.is_null().to_numpy(zero_copy_only=False), bool)
    why[~ok] = "null"
    if framed:
        head = ok & (end - at >= 5) & (data[np.minimum(at, len(data) - 1)] == 0)
        why[ok & ~head] = "no schema number"
        ok, at = head, np.where(head, at + 5, at)
    columns: dict[str, pa.Array] = {}
    for name, kind in fields:
        number, behind, fine = _varint(data, at, end, ok)
        if kind == "string":
            fits = fine & (number >= 0) & (number <= end - behind)
            columns[name], text = _strings(data, behind, number, fits)
            why[ok & ~fits] = f"{name} is cut off"
            why[fits & ~text] = f"{name} is no UTF-8"
            at, ok = np.where(fits, behind + number, at), text
        else:
            inside = fine if kind == "long" else fine & (number >= -(1 << 31)) & (number < 1 << 31)
            why[ok & ~fine] = f"{name} is cut off"
            why[fine & ~inside] = f"{name} is too large"
            columns[name] = pa.array(np.where(inside, number, 0), pa.int64()).cast(_ARROW[kind])
            at, ok = behind, inside
    why[ok & (at < end)] = "bytes left over"
    return columns, pa.array(why.tolist(), pa.string())


def decode_avro(
    records: DataFrame, value: str = "value", keep: Sequence[str] = (), fields: Sequence[tuple[str, str]] = FIELDS, framed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected records with the reason in ``error``). ``keep`` names columns that go along; records are read once for each."""
    keep = list(keep)
    names = [f for f, _ in FIELDS]
    have = dict(fields)
    lacking = [f for f in names if f not in have and f not in DEFAULTS]
    if lacking:
        raise ValueError(f"no default for {', '.join(lacking)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, why = decode_batch(batch.column("avro_value"), fields, framed)
            parsed = [columns[f] if f in have else pa.array([DEFAULTS[f]] * batch.num_rows, pa.string()) for f in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), batch.column("avro_value"), *parsed, why], [*keep, "avro_value", *(f"avro_{f}" for f in names), "avro_error"])

    rows = records.select(*keep, F.col(value).alias("avro_value"))
    typed = [StructField(f"avro_{f}", StructType.fromDDL(f"x {_SQL[k]}")["x"].dataType) for f, k in FIELDS]
    read = rows.mapInArrow(run, StructType([*rows.schema.fields, *typed, StructField("avro_error", StringType())]))
    good = read.where(F.col("avro_error").isNull()).select(
        *keep, *[F.col(f"avro_{f}").alias(f) for f in names[:6]],
        from_millis("avro_ts").alias("captured_at"), from_millis("avro_sampled_at").alias("sampled_at"),
    )
    return good, read.where(F.col("avro_error").isNotNull()).select(*keep, F.col("avro_value").alias(value), F.col("avro_error").alias("error"))


def _zigzag(number: int) -> bytes:
    u = (number << 1) ^ (number >> 63)
    u &= (1 << 64) - 1
    out = bytearray()
    while u > 0x7F:
        out.append(u & 0x7F | 0x80)
        u >>= 7
    out.append(u)
    return bytes(out)


def encode_avro(samples: DataFrame, keep: Sequence[str] = (), schema_number: int | None = None) -> DataFrame:
    """``value``: each row (columns as in ``FIELDS``, times as epoch milliseconds) as one Avro record; null strings become ''."""
    keep = list(keep)
    head = b"" if schema_number is None else b"\0" + schema_number.to_bytes(4, "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(f"avro_{f}").to_pylist() for f, _ in FIELDS), strict=True):
                parts = [head]
                for item, (_, kind) in zip(row, FIELDS, strict=True):
                    if kind == "string":
                        raw = (item or "").encode()
                        parts += [_zigzag(len(raw)), raw]
                    else:
                        parts.append(_zigzag(item or 0))
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.binary())], [*keep, "value"])

    rows = samples.select(*keep, *[F.col(f).cast(_SQL[k]).alias(f"avro_{f}") for f, k in FIELDS])
    return rows.mapInArrow(run, StructType([*[rows.schema[k] for k in keep], *StructType.fromDDL("value binary").fields]))
