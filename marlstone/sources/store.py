"""The engine's tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("chunk_meta", "vectors", "centroids", "lists", "postings", "bm25_stats")


class Store:
    """Parquet tables under one folder, which may be in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def missing(self, names: tuple[str, ...] = TABLES) -> list[str]:
        return [n for n in names if not self.exists(n)]

    def require(self, *names: str) -> None:
        if gone := self.missing(names or TABLES):
            raise RuntimeError(f"build the index first; missing: {', '.join(gone)}")

    def save(self, name: str, df: DataFrame, partition_by: str | None = None, mode: str = "overwrite") -> None:
        if partition_by:
            df = df.repartition(partition_by)
        w = df.write.mode(mode)
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        self.require(name)
        return self.spark.read.parquet(self.path(name))

    def save_chunk_meta(self, chunks: DataFrame) -> None:
        self.save("chunk_meta", chunks.drop("text"))
