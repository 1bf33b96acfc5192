"""Readers and writers: JSON lines, JSON documents, Parquet, row slices, upserts of contexts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.order import with_rank

_SLICE = re.compile(r"^(?P<path>.*)@\[(?P<start>-?\d*):(?P<end>-?\d*)\]$")


def parse_path(path: str) -> tuple[str, int | None, int | None]:
    """(path, start, end) of a path with an optional ``@[start:end]`` suffix."""
    m = _SLICE.match(path)
    if not m:
        return path, None, None
    number = lambda x: int(x) if x else None
    return m["path"], number(m["start"]), number(m["end"])


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, order: str | None = None) -> DataFrame:
    """JSON lines (malformed and blank lines are skipped) or Parquet, by suffix, with an optional row slice.

    A slice needs ``order``, an integer column that gives the row order;
    negative bounds count from the end. Another suffix is a ValueError.
    """
    base, start, end = parse_path(path)
    if base.endswith((".jsonl", ".jsonl.gz")):
        reader = spark.read.option("mode", "DROPMALFORMED")
        rows = (reader.schema(schema) if schema else reader).json(base)
    elif base.endswith(".parquet"):
        rows = spark.read.parquet(base)
    else:
        raise ValueError(f"unsupported suffix: {base}")
    return rows if start is None and end is None else slice_rows(rows, order, start, end)


def slice_rows(rows: DataFrame, order: str | None, start: int | None, end: int | None) -> DataFrame:
    """Rows ``start`` to ``end`` (excluded) by an integer order column."""
    if order is None:
        raise ValueError("a row slice needs an order column")
    if (start or 0) < 0 or (end or 0) < 0:
        n = rows.count()
        start = None if start is None else start + n if start < 0 else start
        end = None if end is None else end + n if end < 0 else end
    ranked = with_rank(rows, order).where(F.col("rank") >= max(0, start or 0))
    return (ranked if end is None else ranked.where(F.col("rank") < end)).drop("rank")


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Strict JSON lines: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites ``path``; the commit protocol makes the job atomic."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def unique_contexts(tables: list[DataFrame], key: str) -> DataFrame:
    """All tables' rows, equal duplicates merged; one key with different rows raises."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(
        F.count_distinct(F.xxhash64(*rest)).alias("_n"), *(F.first(c).alias(c) for c in rest)
    )
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string"))).cast("int"))
    return one.withColumn("_n", checked).where("_n is null").drop("_n").select(rows.columns)
