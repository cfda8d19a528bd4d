"""Keyed records with headers as a Spark data source, batch and stream.

A dump is a folder of Parquet segments under ``partition=<n>``, each row one record with its offset in the partition, as a
topic is backed up. The stream reader keeps one offset per partition; the checkpoint of the query holds them, so a
restarted query goes on behind the last batch. A batch of a partition is read by several tasks, cut by offsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from driftlake.session import materialize

FORMAT = "record_dump"
SCHEMA = "partition int, offset bigint, timestamp timestamp, key binary, value binary, headers array<struct<key:string,value:binary>>"
#: Offsets that one task reads.
TASK_RECORDS = 500_000


class _Range(InputPartition):
    def __init__(self, partition: int, start: int, end: int, files: list[str]):
        self.partition, self.start, self.end, self.files = partition, start, end, files


class _Segments:
    """Segments of a dump with their first and last offset, from the footers; each footer is read once."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.known: dict[str, tuple[int, int, int]] = {}

    def refresh(self) -> dict[str, tuple[int, int, int]]:
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if info.path in self.known or not info.path.endswith(".parquet") or not info.size:
                continue
            parts = [p for p in info.path.split("/") if p.startswith("partition=")]
            footer = pq.read_metadata(info.path, filesystem=self.fs)
            at = footer.schema.to_arrow_schema().get_field_index("offset")
            stats = [footer.row_group(i).column(at).statistics for i in range(footer.num_row_groups) if footer.row_group(i).num_rows]
            if parts and stats:
                self.known[info.path] = (int(parts[0].split("=")[1]), min(s.min for s in stats), max(s.max for s in stats))
        return self.known

    def ends(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for partition, _, last in self.refresh().values():
            out[str(partition)] = max(out.get(str(partition), 0), last + 1)
        return out

    def ranges(self, start: dict, end: dict, step: int) -> list[_Range]:
        out = []
        for name, stop in sorted(end.items()):
            for low in range(int(start.get(name, 0)), int(stop), step):
                high = min(low + step, int(stop))
                files = [f for f, (p, a, b) in self.known.items() if p == int(name) and a < high and b >= low]
                if files:
                    out.append(_Range(int(name), low, high, sorted(files)))
        return out


def _read(path: str, part: _Range) -> Iterator[pa.RecordBatch]:
    if part is None or not part.files:
        return
    fs = _Segments(path).fs
    names = ["offset", "timestamp", "key", "value", "headers"]
    for file in part.files:
        table = pq.read_table(file, columns=names, filesystem=fs, filters=[("offset", ">=", part.start), ("offset", "<", part.end)], partitioning=None)
        table = table.set_column(1, "timestamp", pc.cast(table.column("timestamp"), pa.timestamp("us", "UTC")))
        table = table.add_column(0, "partition", pa.array([part.partition] * table.num_rows, pa.int32()))
        yield from table.combine_chunks().to_batches(max_chunksize=20_000)


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("recordsPerTask", TASK_RECORDS))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> Sequence[InputPartition]:
        segments = _Segments(self.o.path)
        return segments.ranges({}, segments.ends(), self.o.step) or [_Range(0, 0, 0, [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.o.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o = _Options(options)
        self.segments = _Segments(self.o.path)
        self.done: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.segments.ends()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.segments.refresh()
        return self.segments.ranges(start, end, self.o.step) or [_Range(0, 0, 0, [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.o.path, partition)

    def commit(self, end: dict) -> None:
        # segments below the committed offsets are not asked for again
        self.done = end
        self.segments.known = {f: k for f, k in self.segments.known.items() if k[2] >= int(end.get(str(k[0]), 0)) - 1}


class RecordDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordDump)


def read_dump(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(path=path, **options).load()


def stream_dump(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of a dump from the earliest offset; new segments are taken up as they come."""
    register(spark)
    return spark.readStream.format(FORMAT).options(path=path, **options).load()


def write_dump(records: DataFrame, path: str, partitions: int, order: Sequence[Column | str], first: dict[int, int] | None = None) -> None:
    """Append records (timestamp, key, value, headers) to a dump: a key always goes to the same partition, offsets go up in ``order``.

    ``first`` gives the next offset of partitions that hold records already.
    """
    dealt = records.withColumn("partition", F.pmod(F.xxhash64(F.coalesce("key", F.lit(b""))), F.lit(partitions)).cast("int"))
    begin = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (first or {}).items() for x in kv]), F.col("partition")), F.lit(0)) if first else F.lit(0)
    # Numbered by pieces of the order, so that no task sorts a partition as a whole. The pieces are written down first: the
    # bounds of a range partitioning are sampled, and adaptive execution joins its pieces as it likes, so two readers of the
    # plan (counts and records) may see different ones, which loses records or gives them the same offset.
    pieces = materialize(dealt.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "dump-pieces")
    counts = pieces.groupBy("partition", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("partition").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("partition", "piece", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("partition", "piece").orderBy(*order))
    numbered = pieces.withColumn("at", inside).join(starts, ["partition", "piece"]).withColumn("offset", (begin + F.col("start") + F.col("at") - 1).cast("bigint"))
    columns = ["partition", "offset", "timestamp", "key", "value", "headers"]
    # a partition is written by as many tasks as hold its pieces; offsets go up inside a segment
    numbered.select(*columns).sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").parquet(path)
