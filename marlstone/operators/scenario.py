"""Replay of a scenario: a manifest's inserts, deletes and searches against an index, scored by its truth and its time.

Any object with the three calls of `Index` can be replayed. `BucketIndex` writes what a batch changes and compacts buckets now
and then; `LogIndex` keeps the log of operations and never rewrites a vector; `StoreIndex` rewrites its table at every change
and is the baseline that run times are compared with.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import runtime_multiplier
from ..sources import readers
from ..sources.stage import shared_dir, stage
from ..sources.vectors import VectorStore
from . import collection, metrics

#: Fixed values.
K, RUNS, VERSION, WALL_LIMIT, LATE = 10, 3, 2, 50.0, 0.5
SHARES = {"search": 0.5, "insert": 0.3, "delete": 0.2}
STATS = ("insert_score", "delete_score", "search_score", "functional_score", "initial_time", "dynamic_time", "total_time", "scenario_wall_time", "wall_timeout", "runtime_multiplier", "final_score", "baseline_time", "speed_ratio")


class Index(Protocol):
    """insert (pos, vec_id, embedding) and delete (pos, vec_id) return (pos, vec_id, ok); search (query_id, qvec) returns
    (query_id, rank, vec_id, score), min(k, vectors there) rows a query. What a call returns is computed."""

    def insert(self, batch: DataFrame) -> DataFrame: ...

    def delete(self, ids: DataFrame) -> DataFrame: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


Factory = Callable[[SparkSession, int], Index]


class LogIndex:
    """Appends every batch to a log; whether an id is there is what its last operation was."""

    def __init__(self, spark: SparkSession, dim: int):
        self.spark, self.dim, self.seq = spark, dim, 0
        self.log = spark.createDataFrame([], "op_seq bigint, pos bigint, op string, vec_id bigint, embedding array<float>")

    def _append(self, batch: DataFrame, op: str) -> DataFrame:
        rows = batch.select(F.lit(self.seq).cast("bigint").alias("op_seq"), F.col("pos").cast("bigint").alias("pos"), F.lit(op).alias("op"), F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("embedding") if op == "insert" else F.lit(None)).cast("array<float>").alias("embedding"))
        before = self.log
        new = stage(rows, "scenario-log")
        self.log, self.seq = before.unionByName(new), self.seq + 1
        last = before.join(new.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.max_by("op", F.struct("op_seq", "pos")).alias("op"))
        known = last.select(F.lit(-1).cast("bigint").alias("op_seq"), F.lit(0).cast("bigint").alias("pos"), "op", "vec_id", F.lit(None).cast("array<float>").alias("embedding"))
        done = collection.mutations(known.unionByName(new)).where(F.col("op_seq") >= 0)
        return stage(done.select("pos", "vec_id", "ok"), "scenario-done")

    def insert(self, batch: DataFrame) -> DataFrame:
        return self._append(batch, "insert")

    def delete(self, ids: DataFrame) -> DataFrame:
        return self._append(ids, "delete")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        there = collection.active(collection.mutations(self.log), self.seq)
        return stage(collection.top_k_blocked(there, queries, k), "scenario-hits")


class BucketIndex:
    """A vector store in buckets: a batch reads the buckets of its ids and writes the ids that it changes."""

    def __init__(self, spark: SparkSession, dim: int, root: str | None = None, compact_every: int = 16):
        self.dim, self.compact_every, self.batch = dim, compact_every, 0
        self.store = VectorStore(spark, root or f"{shared_dir(spark)}/marlstone/vectors-{uuid.uuid4().hex}")

    def _apply(self, batch: DataFrame, op: str) -> DataFrame:
        vector = (F.col("embedding") if op == "insert" else F.lit(None)).cast("array<float>").alias("embedding")
        rows = batch.select(F.lit(self.batch).cast("bigint").alias("op_seq"), F.col("pos").cast("bigint").alias("pos"), F.lit(op).alias("op"), F.col("vec_id").cast("bigint").alias("vec_id"), vector)
        if self.batch and self.batch % self.compact_every == 0:
            self.store.compact()
        done = self.store.apply(rows, self.batch)
        self.batch += 1
        return done.select("pos", "vec_id", "ok")

    def insert(self, batch: DataFrame) -> DataFrame:
        return self._apply(batch, "insert")

    def delete(self, ids: DataFrame) -> DataFrame:
        return self._apply(ids, "delete")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return stage(collection.top_k_blocked(self.store.current(), queries, k), "scenario-hits")


class StoreIndex:
    """A table of the vectors that are there, written anew at every change."""

    def __init__(self, spark: SparkSession, dim: int):
        self.dim = dim
        self.store = spark.createDataFrame([], "vec_id bigint, embedding array<float>")

    def insert(self, batch: DataFrame) -> DataFrame:
        there = self.store.select("vec_id", F.lit(True).alias("there"))
        done = stage(batch.join(there, "vec_id", "left").withColumn("ok", F.col("there").isNull()), "scenario-done")
        self.store = stage(self.store.unionByName(done.where("ok").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))), "scenario-store")
        return done.select("pos", "vec_id", "ok")

    def delete(self, ids: DataFrame) -> DataFrame:
        after, good, bad = collection.delete(self.store, ids)
        both = good.select(F.lit(0).cast("bigint").alias("pos"), "vec_id", F.lit(True).alias("ok")).union(bad.select(F.lit(0).cast("bigint"), "vec_id", F.lit(False)))
        done, self.store = stage(both, "scenario-done"), stage(after, "scenario-store")
        return done

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return stage(collection.top_k_blocked(self.store, queries, k), "scenario-hits")


@contextlib.contextmanager
def timed(label: str = "", say: Callable[[str], None] | None = None) -> Iterator[Callable[[], float]]:
    """Elapsed seconds as a function; said with the label at the end."""
    began, ended = time.perf_counter(), []
    try:
        yield lambda: (ended[0] if ended else time.perf_counter()) - began
    finally:
        ended.append(time.perf_counter())
        if say:
            say(f"{label}: {ended[0] - began:.3f} s")


T = TypeVar("T")


class Late(Exception):
    """The time that a call had was over before it was done."""


def limited(spark: SparkSession, call: Callable[[], T], seconds: float | None) -> T:
    """call(), whose Spark jobs are cancelled after so many seconds: those that run then, and any that it starts later."""
    if seconds is None:
        return call()
    sc, tag, done, late = spark.sparkContext, f"marlstone-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(max(0.0, seconds)):
            late.set()
            while True:
                sc.cancelJobsWithTag(tag)
                if done.wait(0.1):
                    return

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)  # else a cancelled task goes on to its end
    watcher.start()
    try:
        out = call()
    except Exception:
        if late.is_set():
            raise Late(f"stopped after {seconds:.1f} s") from None
        raise
    finally:
        done.set()
        watcher.join()
        sc.setInterruptOnCancel(False)
        sc.removeJobTag(tag)
    return out


def operations(spark: SparkSession, folder: str) -> tuple[dict[str, int], list]:
    """(totals and dim, operations in order): one row for each operation, whatever the size of its batch."""
    totals, ops = readers.manifest(spark, f"{folder}/manifest.json")
    return totals.first().asDict(), ops.orderBy("op_seq").collect()


def _agreement(done: DataFrame, truth: DataFrame) -> float:
    """Mean Jaccard index of the ids that succeeded and of those that failed."""
    said = collection.agreement(done.select(F.lit(0).alias("op_seq"), F.lit("").alias("op"), "vec_id", "ok"), truth.select(F.lit(0).alias("op_seq"), F.lit("").alias("op"), "vec_id", "ok")).first()
    return (said.ok + said.bad) / 2 if said else 1.0


def _truth(spark: SparkSession, path: str) -> DataFrame:
    t = readers.mutation_truth(spark, path)
    side = lambda name, ok: t.select(F.explode(name).alias("vec_id"), F.lit(ok).alias("ok"))
    return side("succeeded", True).union(side("failed", False))


def replay(spark: SparkSession, folder: str, factory: Factory, baseline_time: float | None, wall_limit: float | None = WALL_LIMIT) -> dict[str, float]:
    """Scores and times. The first insert is the initial phase, everything later the dynamic one that is compared with
    baseline_time. Batches are read outside the timers. An operation that runs at the wall limit is stopped; it and the rest
    score nothing, and the multiplier is the least."""
    if baseline_time is None:
        raise ValueError("baseline_time is needed: see `baseline`, or 1.0 to measure only")
    totals, ops = operations(spark, folder)
    index, scores, phases, late, initial = factory(spark, totals["dim"]), dict.fromkeys(SHARES, 0.0), {"initial": 0.0, "dynamic": 0.0}, False, True
    with timed() as wall:
        over = lambda: wall_limit is not None and wall() > wall_limit
        for op in ops:
            if late := over():
                break
            at = lambda name: f"{folder}/{name}"
            if op.type == "insert":
                batch = stage(readers.insert_batch(spark, at(op.batch)), "scenario-batch")
                call = lambda batch=batch: index.insert(batch)
            elif op.type == "delete":
                batch = stage(readers.npy(spark, at(op.ids)).select("pos", F.col("value")[0].cast("bigint").alias("vec_id")), "scenario-batch")
                call = lambda batch=batch: index.delete(batch)
            else:
                batch = stage(readers.npy(spark, at(op.queries)).select(F.col("pos").alias("query_id"), F.col("value").alias("qvec")), "scenario-batch")
                call = lambda batch=batch: index.search(batch, K)
            phase = "initial" if op.type == "insert" and initial else "dynamic"
            with timed() as spent:
                try:
                    out = limited(spark, call, None if wall_limit is None else wall_limit - wall())
                except Late:
                    late = True
            phases[phase] += spent()
            if late:
                break
            initial = initial and op.type != "insert"
            kind = op.type if op.type in SHARES else "search"
            part = batch.count() / totals[f"total_{kind}"]
            if kind == "search":
                truth = readers.npy(spark, at(op.gt)).select(F.col("pos").alias("query_id"), F.transform("value", lambda x: x.cast("bigint")).alias("truth"))
                lists = out.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l")).select("query_id", F.col("l.vec_id").alias("found"))
                pairs = truth.join(lists, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
                scores[kind] += part * (metrics.recall(pairs, K).agg(F.avg("recall")).first()[0] or 0.0)
            else:
                scores[kind] += part * _agreement(out, _truth(spark, at(op.gt)))
            if late := over():
                break
        late = late or over()
    functional = sum(SHARES[kind] * score for kind, score in scores.items())
    ratio = phases["dynamic"] / max(baseline_time, 1e-9)
    multiplier = LATE if late else spark.range(1).select(runtime_multiplier(F.lit(float(ratio)))).first()[0]
    values = (scores["insert"], scores["delete"], scores["search"], functional, phases["initial"], phases["dynamic"], phases["initial"] + phases["dynamic"], wall(), float(late), multiplier, functional * multiplier, baseline_time, ratio)
    return dict(zip(STATS, map(float, values), strict=True))


def stats_frame(spark: SparkSession, stats: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([tuple(stats[c] for c in STATS)], ", ".join(f"{c} double" for c in STATS))


def measure(spark: SparkSession, folder: str, factory: Factory = StoreIndex, n_runs: int = RUNS) -> dict[str, float]:
    """Mean times of n_runs replays without a wall limit."""
    runs = [replay(spark, folder, factory, 1.0, None) for _ in range(n_runs)]
    mean = lambda name: sum(r[name] for r in runs) / n_runs
    return {"baseline_initial": mean("initial_time"), "baseline_dynamic": mean("dynamic_time"), "baseline_total": mean("total_time"), "baseline_time": mean("dynamic_time")}


def baseline(spark: SparkSession, folder: str, factory: Factory = StoreIndex, n_runs: int = RUNS, recalibrate: bool = False) -> dict[str, float]:
    """The cached means if there are some of as many runs, else measured and cached."""
    path = f"{folder}/baseline_cache"
    if not recalibrate and readers.exists(spark, path) and (known := readers.baseline_cache(spark, path, n_runs).first()):
        return {k: v for k, v in known.asDict().items() if k.startswith("baseline_")}
    found = measure(spark, folder, factory, n_runs)
    row = (VERSION, n_runs, *(found[k] for k in ("baseline_initial", "baseline_dynamic", "baseline_total", "baseline_time")))
    readers.write_baseline(spark.createDataFrame([row], readers.BASELINE), path)
    return found
