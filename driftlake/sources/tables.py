"""The tables of the data model: typed reads and value checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.schemas import ALLOWED, TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(TABLES[name]).load(path)


def read_stream(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(TABLES[name]).options(**options).load(path)


def check_words(table: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the words each column may hold; null is allowed."""
    checks: list[Column] = [F.col(c).isNull() | F.col(c).isin(*words) for c, words in ALLOWED.get(name, {}).items()]
    ok = reduce(lambda a, b: a & b, checks, F.lit(True))
    return table.filter(ok), table.filter(~ok)
