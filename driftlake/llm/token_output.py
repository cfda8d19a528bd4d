"""Token ids as Arrow IPC files of fixed-size-list batches.

Documents are put in ascending order of (id, text hash) by a range partitioning; each task encodes its range and writes
it as one sequence file: record batches of fixed-size lists ``ids`` (uint16 if the vocabulary allows, else int32) and ``mask``
(bool), so that sequence ``i`` begins at entry ``i * length`` of its buffer and a memory map gives it without a copy. Only the last sequence of a
file is padded (id 0, mask false). Beside it lies an index file with the documents' ids, first position and number of
tokens. A file appears under its name only when it is whole, and a task that runs twice writes the same name, so lost
executors leave no partial or doubled data.

Null and empty texts give one token, the end id. Null ids come first. Rows that repeat an id are ordered by text; equal
rows each keep their own tokens. An empty table gives no files and no rows. Other columns are passed over.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import ready, shared_path, slices, texts
from driftlake.llm.token_counts import encoded, encoder

#: Ids of a sequence, sequences of a record batch, and the id that ends each document.
LENGTH, BATCH, END = 2048, 256, 0

_WRITTEN = "file string, part int, n_docs long, n_tokens long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _schema(length: int, narrow: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if narrow else pa.int32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Sequences:
    """Cuts a stream of ids into record batches of whole sequences."""

    def __init__(self, sink, length: int, narrow: bool):
        self.length, self.schema, self.kind = length, _schema(length, narrow), np.uint16 if narrow else np.int32
        self.writer, self.rest, self.total = ipc.new_file(sink, self.schema), np.zeros(0, self.kind), 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        step = self.length * BATCH
        while len(self.rest) >= step:
            self._write(self.rest[:step], step)
            self.rest = self.rest[step:]

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(ids)) < used)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if used := len(self.rest):
            self._write(np.concatenate([self.rest, np.zeros(-used % self.length, self.kind)]), used)
        self.writer.close()


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, length: int = LENGTH) -> DataFrame:
    """Write the files and return one row per file: file, part, n_docs, n_tokens. Runs when the result does."""
    spark = ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = pa.schema([("doc_id", pa.string() if kind == "string" else pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        store, base = _store(folder)
        name, temp = f"{base}/part-{part:06d}", f"{base}/_{uuid.uuid4().hex}"
        store.create_dir(base)
        n_docs = 0
        with store.open_output_stream(f"{temp}.arrow") as data, store.open_output_stream(f"{temp}.index") as marks:
            out, rows = _Sequences(data, length, enc.size <= 1 << 16), ipc.new_file(marks, index)
            for piece in slices((b for bs in ([first], batches) for b in bs), limit=8 << 20):
                ids, ends = encoded(enc, texts(piece))
                counts = np.diff(ends, prepend=0) + 1
                starts = out.total + np.cumsum(counts) - counts
                out.add(np.insert(ids, ends, END))
                rows.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id").cast(index.field(0).type), pa.array(starts), pa.array(counts)], schema=index))
                n_docs += piece.num_rows
            out.close()
            rows.close()
        # the index is moved last: where it is, both are whole
        store.move(f"{temp}.arrow", f"{name}.arrow")
        store.move(f"{temp}.index", f"{name}.index")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}"]), pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([out.total])], ["file", "part", "n_docs", "n_tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return spark.createDataFrame(ordered.mapInArrow(run, _WRITTEN).collect(), _WRITTEN)


class TokenFile:
    """Random access to one sequence file by memory map; arrays are views of the mapped bytes."""

    def __init__(self, name: str):
        store, path = _store(name)
        self.reader = ipc.open_file(pa.memory_map(f"{path}.arrow") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(f"{path}.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size
        with store.open_input_file(f"{path}.index") as f:
            self.index = ipc.open_file(f).read_all()

    def _batch(self, column: str, number: int) -> pa.Array:
        return self.reader.get_batch(number).column(column).flatten()

    def sequence(self, i: int) -> np.ndarray:
        at = i % BATCH * self.length
        return self._batch("ids", i // BATCH).to_numpy()[at : at + self.length]

    def mask(self, i: int) -> np.ndarray:
        at = i % BATCH * self.length
        return self._batch("mask", i // BATCH).slice(at, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids of one document, across sequences and batches."""
        step, out = self.length * BATCH, []
        while n > 0:
            at = start % step
            got = self._batch("ids", start // step).to_numpy()[at : at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int32)


def read_documents(spark: SparkSession, files: DataFrame, kind: str = "bigint") -> DataFrame:
    """Columns doc_id, start (in the order of all files), n_tokens, ids_crc32, file: read back by tasks, a file each."""
    ready(spark)
    listed = files.orderBy("part").collect()  # one row per file
    begin = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in listed], dtype=np.int64)])
    rows = [(r["file"], int(b)) for r, b in zip(listed, begin, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(name)
                for part in file.index.to_batches(max_chunksize=10_000):
                    start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(file.tokens(a, b).astype("<u4").tobytes()) for a, b in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pc.add(part.column("start"), offset), part.column("n_tokens"), pa.array(crc, pa.int64()), pa.array([name] * part.num_rows)],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                    )

    names = spark.createDataFrame(rows, "file string, begin long")
    if rows:
        names = names.repartition(len(rows), "file")
    return names.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, file string")


def write_and_read(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    kind = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "bigint"
    return read_documents(spark, write_tokens(docs, vocabulary, folder, length), kind)
