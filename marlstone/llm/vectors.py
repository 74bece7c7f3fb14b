"""What the two embedding operators share: which vectors take part, equal vectors as one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, without null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def cast(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch for each length of its vectors."""
    lens = np.asarray(pc.list_value_length(batch.column(column)))
    for n in np.unique(lens).tolist():
        yield n, batch.take(pa.array(np.flatnonzero(lens == n)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def array_of(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def unit(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(1, keepdims=True)
    m = m / top  # no overflow in the squares
    return m / np.sqrt((m * m).sum(1, keepdims=True))
