"""Helpers shared by the training-data operators: tables, staged results, word splitting."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_shared() -> str:
    return tempfile.mkdtemp(prefix="marlstone-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_local_shared()}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/marlstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any longer."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/marlstone/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Keep df in Spark's own block store, on disk, once it is computed: for what a few later jobs of one operator read, and
    what is cheaper to compute again where an executor is lost than to write to the shared folder, a file for each task."""
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release(*frames: DataFrame) -> None:
    """Let go of what is held: the frames given, or all of them."""
    for df in frames or tuple(_held):
        df.unpersist()
    _held[:] = [df for df in _held if frames and all(df is not f for f in frames)]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text), F.lit(modulus).cast("bigint"))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """The fold of what stands before each element of an array, by an associative `add`. An array grows by copies, so it is
    done within blocks and over the blocks' folds: for n values about n * block / 2 + (n / block) ** 2 / 2 copies."""

    def grown(seed: Column, some: Column) -> Column:
        return F.aggregate(some, F.array(seed), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def of(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
        part = lambda s: F.slice(v, s + 1, F.lit(block))
        sums = F.transform(starts, lambda s: F.aggregate(part(s), zero, add))
        inner = lambda base, s: let(grown(base, part(s)), lambda g: F.slice(g, F.lit(1), F.size(g) - 1))
        return let(grown(zero, sums), lambda bases: F.flatten(F.transform(starts, lambda s, i: inner(bases[i], s))))

    return let(values, of)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about `limit` bytes of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


@functools.cache
def _malloc_trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda n: 0)


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Say how to drop what the owner's tasks leave in a Python worker for the next ones of the same kind."""
    _kept[owner] = clear


def forget(but: str) -> None:
    for owner, clear in _kept.items():
        if owner != but:
            clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at a task's end what the allocators still hold goes back to the system: Python workers outlive their stage
    and stand beside those of the next. What tasks of another owner kept is dropped first."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _malloc_trim()(0)

    return whole


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased.

    Returns (offsets of each text in the word list, index of each word in the dictionary, dictionary).
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    lens = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        row = np.repeat(np.arange(len(lens)), lens)[full]
        lens = np.bincount(row, minlength=len(lens))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return offsets, np.asarray(coded.indices).astype(np.int64), coded.dictionary
