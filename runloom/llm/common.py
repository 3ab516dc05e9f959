"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from runloom.session import new_folder

# Rows and bytes of Python values that a task gathers before it hands a batch to Spark.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def durable(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in one folder per value of ``by``, and go on from there.

    Rows made by Python code, or whose identity depends on their placement, are read by
    more than one later step; a second evaluation would cost or differ.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "llm")
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


class Rows:
    """Gathers rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
        self.schema, self.rows, self.size = schema, rows, size
        self.values: list[tuple] = []
        self.bytes = 0

    def add(self, row: Sequence, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.values.append(tuple(row))
        self.bytes += size
        if len(self.values) >= self.rows or self.bytes >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.values:
            columns = zip(*self.values)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
            self.values, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def per_worker(key: tuple, make: Callable):
    """A value that a Python worker makes once and keeps for the tasks it is given later."""
    kept = sys.modules.setdefault("_runloom_kept", types.ModuleType("_runloom_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
