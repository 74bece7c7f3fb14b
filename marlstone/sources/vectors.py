"""A collection of keyed vectors on disk that takes small changes: hash buckets of ids, deltas, compaction.

    root/base/version=<v>/bucket=<b>   vectors of a bucket (vec_id, embedding)
    root/delta/batch=<n>/bucket=<b>    what a batch changed (vec_id, embedding; null: gone)
    root/state/<s>                     a row for each bucket: its version, and the last batch that this version holds

A batch reads only the buckets of its ids, and writes only the ids that it changed. `compact` rewrites buckets that have
deltas, puts the new state beside the old one and then removes what no state names. A state is complete once Spark has marked
it as written, so a reader, or a run that broke off, finds the last complete one; a batch or a compaction that is run again
writes the same.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import stage

BUCKETS = 32
VECTORS = "vec_id bigint, embedding array<float>"
LOG = "op_seq bigint, pos bigint, op string, vec_id bigint, embedding array<float>"


@dataclasses.dataclass(frozen=True)
class State:
    number: int
    version: dict[int, int]  # of buckets that have one
    upto: dict[int, int]


class VectorStore:
    """The buckets' number is fixed when the store is made; their states, a row each, are all that the driver holds."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        known = self._numbers("state", done=True)
        if known:
            self.buckets = spark.read.parquet(f"{self.root}/state/{known[-1]}").count()
        else:
            self._write_state(State(0, {}, {}))

    def _path(self, *parts: object) -> object:
        return self.fs.Path("/".join([self.root, *map(str, parts)]))

    def _system(self) -> object:
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: object) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._system().listStatus(path)] if self._system().exists(path) else []

    def _numbers(self, *parts: object, done: bool = False) -> list[int]:
        names = [n for n in self._names(*parts) if not done or self._system().exists(self._path(*parts, n, "_SUCCESS"))]
        return sorted(int(n.rsplit("=", 1)[-1]) for n in names if n.rsplit("=", 1)[-1].isdigit())

    def _write_state(self, state: State) -> None:
        rows = [(b, state.version.get(b, -1), state.upto.get(b, -1)) for b in range(self.buckets)]
        self.spark.createDataFrame(rows, "bucket int, version int, upto bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/{state.number}")

    def state(self) -> State:
        number = self._numbers("state", done=True)[-1]
        rows = self.spark.read.parquet(f"{self.root}/state/{number}").collect()  # a row for each bucket
        return State(number, {r.bucket: r.version for r in rows if r.version >= 0}, {r.bucket: r.upto for r in rows if r.upto >= 0})

    def bucket(self, ids: str = "vec_id") -> object:
        return F.pmod(F.xxhash64(ids), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        schema = self.spark.createDataFrame([], VECTORS).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """(vec_id, embedding) of all buckets, or of some, as they were before a batch if one is given."""
        state, some = self.state(), set(range(self.buckets) if buckets is None else buckets)
        base = self._read([f"{self.root}/base/version={v}/bucket={b}" for b, v in sorted(state.version.items()) if b in some])
        parts = []
        for n in self._numbers("delta", done=True):
            if before is None or n < before:
                there = [b for b in self._numbers("delta", f"batch={n}") if b in some and n > state.upto.get(b, -1)]
                if there:
                    parts.append(self._read([f"{self.root}/delta/batch={n}/bucket={b}" for b in there]).withColumn("batch", F.lit(n)))
        if not parts:
            return base
        deltas = parts[0]
        for more in parts[1:]:
            deltas = deltas.union(more)
        last = deltas.groupBy("vec_id").agg(F.max_by(F.struct("embedding"), "batch")["embedding"].alias("embedding"))
        return base.join(last.select("vec_id"), "vec_id", "left_anti").union(last.where(F.col("embedding").isNotNull()))

    def apply(self, log: DataFrame, batch: int | None = None) -> DataFrame:
        """log (op_seq, pos, op, vec_id, embedding) of inserts and deletes -> staged (op_seq, pos, op, vec_id, ok). batch: the
        number under which the change is kept, the next one if none is given; the same number again replaces it."""
        batch = max([-1, *self._numbers("delta"), *self.state().upto.values()]) + 1 if batch is None else batch
        rows = stage(log.select("op_seq", "pos", "op", "vec_id", F.col("embedding").cast("array<float>").alias("embedding"), self.bucket().alias("bucket")), "vectors-batch")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        there = self.current(touched, batch).join(rows.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id")
        start = there.select(F.lit(-1).cast("bigint").alias("op_seq"), F.lit(0).cast("bigint").alias("pos"), F.lit("insert").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"), self.bucket().alias("bucket"))
        before = F.lag("op").over(Window.partitionBy("vec_id").orderBy("op_seq", "pos"))
        ok = F.when(F.col("op") == "insert", before.isNull() | (before == "delete")).otherwise(F.coalesce(before == "insert", F.lit(False)))
        done = stage(start.unionByName(rows).withColumn("ok", ok).where("op_seq >= 0"), "vectors-done")
        last = done.where("ok").groupBy("bucket", "vec_id").agg(F.max_by(F.struct("op", "embedding"), F.struct("op_seq", "pos")).alias("last"))
        changed = last.select("bucket", "vec_id", F.when(F.col("last.op") == "insert", F.col("last.embedding")).alias("embedding"))
        changed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/delta/batch={batch}")
        return done.select("op_seq", "pos", "op", "vec_id", "ok")

    def compact(self) -> list[int]:
        """Rewrite the buckets that have deltas, and those only, and remove what is then out of date. The buckets rewritten."""
        state, batches = self.state(), self._numbers("delta", done=True)
        due = sorted({b for n in batches for b in self._numbers("delta", f"batch={n}") if n > state.upto.get(b, -1)})
        if due:
            version = state.number + 1
            self.current(due).withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/version={version}")
            written = set(self._numbers("base", f"version={version}"))
            kept = {b: v for b, v in state.version.items() if b not in due} | {b: version for b in due if b in written}
            self._write_state(State(version, kept, state.upto | dict.fromkeys(due, batches[-1])))
        self._tidy()
        return due

    def _tidy(self) -> None:
        state = self.state()
        gone = [("state", n) for n in self._numbers("state") if n < state.number]
        gone += [("delta", f"batch={n}") for n in self._numbers("delta", done=True) if all(n <= state.upto.get(b, -1) for b in self._numbers("delta", f"batch={n}"))]
        for v in self._numbers("base"):
            old = [b for b in self._numbers("base", f"version={v}") if state.version.get(b) != v]
            whole = len(old) == len(self._numbers("base", f"version={v}"))
            gone += [("base", f"version={v}")] if whole else [("base", f"version={v}", f"bucket={b}") for b in old]
        for parts in gone:
            self._system().delete(self._path(*parts), True)
