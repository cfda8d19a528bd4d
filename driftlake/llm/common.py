"""Shared folder, bounded Arrow batches and words as hashed codes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python step works on at a time (one longer document is taken alone).
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; where it names none, one in the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def ready(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded in rows and bytes, and a checkpoint folder where the cluster names none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(ready(spark))}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and gives the planner true sizes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    return int(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all values, offsets starting at 0)."""
    values = pa.concat_arrays([values])  # drops an offset left by a slice
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash64(value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(value)


def words(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lower-cased words, code of each word in order, first word of each text and the end).

    Words are the runs of bytes other than space and 0x09 to 0x0D; only A-Z are lower-cased.
    """
    data, offsets = raw_bytes(values)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space
    begins = inside[1:-1] & ~inside[:-2]
    # a text that ends in a word and one that begins with a word are not joined
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= ~space[firsts]
    ends = inside[1:-1] & ~inside[2:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] |= ~space[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    # white space takes no part: keep the words' bytes only
    kept = lowered[~space]
    bounds = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=bounds[1:])
    array = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(start, offsets)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.array([hash64(w) for w in distinct.to_pylist()], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
