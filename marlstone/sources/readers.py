"""Readers and writers: corpora, query sets, scenario files, index tables."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import npy as npy_source

PAGE = "page_id bigint, title string, content string"
QUERY = "query_id string, query string, relevant_page_ids array<string>"
MANIFEST = "config struct<total_insert:bigint,total_delete:bigint,total_search:bigint>, dim int, operations array<struct<type:string,batch:string,ids:string,queries:string,gt:string>>"
MUTATION = "succeeded array<bigint>, failed array<bigint>"
BASELINE = "cache_version int, n_runs int, baseline_initial double, baseline_dynamic double, baseline_total double, baseline_time double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON files, a page each; `file` orders them. Raises if there is none."""
    pages = spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    pages = pages.select("*", F.col("_metadata.file_path").alias("file"))
    if pages.isEmpty():
        raise FileNotFoundError(f"no JSON pages in {path}")
    return pages


def clean_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, content[, file]): the id as a number, title and content stripped."""
    file = [c for c in pages.columns if c == "file"]
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), T.strip(F.col("title")).alias("title"), T.strip(F.col("content")).alias("content"), *file)


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("page_id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))


def documents_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pages(raw_documents(spark, sf_dir))


def raw_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY).option("multiLine", True).json(path)


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant array<bigint>), the relevant ids as a set of numbers."""
    return raw_queries(spark, path).select("query_id", "query", F.array_distinct(F.transform("relevant_page_ids", lambda x: x.cast("bigint"))).alias("relevant"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(totals, at least 1 each; operations with op_seq)."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    totals = m.select(*(F.greatest(F.coalesce(F.col(f"config.{c}"), F.lit(0)), F.lit(1)).alias(c) for c in ("total_insert", "total_delete", "total_search")), "dim")
    return totals, m.select(F.posexplode("operations").alias("op_seq", "op")).select("op_seq", "op.*")


def mutation_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MUTATION).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def insert_batch(spark: SparkSession, path: str) -> DataFrame:
    """(pos, vec_id, embedding) from Parquet of that form, or from a NumPy file of (id, vector) pairs; of a repeated id the
    last vector stays, at the place of the first."""
    rows = pairs(spark, path) if path.endswith(".npy") else spark.read.parquet(path)
    kept = rows.groupBy("vec_id").agg(F.min("pos").alias("pos"), F.max_by("embedding", "pos").alias("embedding"))
    return kept.select("pos", F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))


class _PlainArrays(pickle.Unpickler):
    """Loads arrays and numbers only: nothing in a file can name other code."""

    ALLOWED = {"_reconstruct", "scalar", "ndarray", "dtype", "_frombuffer"}

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in self.ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't an array or a number")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pos, vec_id, embedding) of a NumPy file of (id, vector) pairs, which NumPy keeps as pickled objects."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                f = io.BytesIO(content)
                major = np.lib.format.read_magic(f)[0]
                (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
                every = np.asarray(_PlainArrays(f).load(), object).reshape(-1, 2)
                for at in range(0, len(every), 4096):
                    some = every[at : at + 4096]
                    yield pd.DataFrame({"pos": np.arange(at, at + len(some)), "vec_id": [int(x) for x in some[:, 0]], "embedding": [np.asarray(x, np.float32) for x in some[:, 1]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "pos long, vec_id long, embedding array<float>")


def npy(spark: SparkSession, path: str) -> DataFrame:
    """A NumPy file of numbers, one or two dimensions (no pickled objects): (pos, value array<double>). A file that the system
    can open is read by ranges of rows, one in another store whole."""
    if own := npy_source.local(path):
        return npy_source.load(spark, own)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float)
                for at in range(0, len(a), 4096):
                    yield pd.DataFrame({"pos": np.arange(at, min(at + 4096, len(a))), "value": list(a[at : at + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "pos long, value array<double>")


def baseline_cache(spark: SparkSession, path: str, n_runs: int) -> DataFrame:
    """The cached baseline if it has as many runs and a version of 2 or more; otherwise no row."""
    return spark.read.schema(BASELINE).option("multiLine", True).json(path).where((F.col("n_runs") == n_runs) & (F.col("cache_version") >= 2))


def write_baseline(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
