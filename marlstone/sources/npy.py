"""NumPy files of numbers as a Spark data source that splits them: spark.read.format("npy_rows").load(path).

The header is read once, where the query is planned; tasks get ranges of rows and read these bytes only. The path is one that
the driver and all executors see as a file; for files in other stores `readers.npy` reads each whole.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "pos long, value array<double>"
#: Bytes of a task's share, and rows of a batch.
SHARE, BATCH = 64 << 20, 4096


def header(path: str) -> tuple[int, tuple[int, ...], bool, np.dtype]:
    """(offset of the numbers, shape, whether columns come first, type)"""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if kind.hasobject:
            raise ValueError(f"{path} holds objects, not numbers")
        return f.tell(), shape, columns and len(shape) > 1, kind


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share
        self.offset, shape, self.columns, self.kind = header(path)
        self.rows = shape[0] if shape else 1
        self.width = math.prod(shape[1:])

    def partitions(self) -> Sequence[InputPartition]:
        each = max(1, self.share // max(1, self.width * self.kind.itemsize))
        return [Rows(a, min(a + each, self.rows)) for a in range(0, self.rows, each)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        size = self.kind.itemsize
        with open(self.path, "rb") as f:
            for at in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - at)
                if self.columns:  # a column's numbers stand together
                    some = np.empty((n, self.width), self.kind)
                    for c in range(self.width):
                        f.seek(self.offset + (c * self.rows + at) * size)
                        some[:, c] = np.fromfile(f, self.kind, n)
                else:
                    f.seek(self.offset + at * self.width * size)
                    some = np.fromfile(f, self.kind, n * self.width).reshape(n, self.width)
                ends = np.arange(0, (n + 1) * self.width, self.width, dtype=np.int32) if self.width else np.zeros(n + 1, np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(some.astype(float).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), values], ["pos", "value"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("share", SHARE)))


def local(path: str) -> str | None:
    """The path as the operating system knows it, if it is one."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return path if path.startswith("/") and os.path.isfile(path) else None


def load(spark: SparkSession, path: str, share: int = SHARE):
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_rows").option("path", path).option("share", str(share)).load()
