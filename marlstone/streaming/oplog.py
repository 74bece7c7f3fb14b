"""The collection's log as a stream: outcomes from state kept by id, and a store that follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.vectors import VectorStore

LOG = "op_seq int, pos int, op string, vec_id bigint, embedding array<float>"
OUTCOME = "op_seq long, pos long, op string, vec_id long, ok boolean"
#: The only state store of Spark that keeps named state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge(store: DataFrame, batch: DataFrame) -> DataFrame:
    """store (vec_id, embedding) after a batch of the log."""
    start = store.select(F.lit(-1).alias("op_seq"), F.lit(0).alias("pos"), F.lit("insert").alias("op"), "vec_id", "embedding")
    order = Window.partitionBy("vec_id").orderBy("op_seq", "pos")
    before = F.lag("op").over(order)
    rows = start.unionByName(batch.select("op_seq", "pos", "op", "vec_id", "embedding")).withColumn("stores", (F.col("op") == "insert") & (before.isNull() | (before == "delete")))
    at = F.struct("op_seq", "pos")
    last = rows.groupBy("vec_id").agg(F.max_by("op", at).alias("op"), F.max_by("embedding", F.when(F.col("stores"), at)).alias("embedding"))
    return last.where(F.col("op") == "insert").select("vec_id", "embedding")


class _There(StatefulProcessor):
    """Whether an id is in the collection, which is all that the outcome of its next operation depends on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        there = bool(self.there.get()[0]) if self.there.exists() else False
        ops = pd.concat(rows).sort_values(["op_seq", "pos"], kind="stable")
        ok = []
        for op in ops["op"]:
            ok.append(there != (op == "insert"))
            there = op == "insert"
        if there:
            self.there.update((True,))
        else:
            self.there.clear()
        yield pd.DataFrame({"op_seq": ops["op_seq"], "pos": ops["pos"], "op": ops["op"], "vec_id": key[0], "ok": ok})

    def close(self) -> None:
        pass


def outcomes(log: DataFrame) -> DataFrame:
    """A stream of the log -> (op_seq, pos, op, vec_id, ok), a row for each insert and delete. State is a flag for each id that
    is there; operations of one id come in order from batch to batch, in any order within one. Vectors aren't moved."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = log.where(F.col("op").isin("insert", "delete")).select(F.col("op_seq").cast("long").alias("op_seq"), F.col("pos").cast("long").alias("pos"), "op", "vec_id")
    return rows.groupBy("vec_id").transformWithStateInPandas(statefulProcessor=_There(), outputStructType=OUTCOME, outputMode="Append", timeMode="None")


def follow(log: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep `root`/v<n> up to date; each batch writes a new version, so that a batch run again gives the same. For small
    collections: `keep_up` writes what a batch changes only."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        store = spark.read.parquet(f"{root}/v{n - 1}") if n else spark.createDataFrame([], "vec_id bigint, embedding array<float>")
        merge(store, batch.where(F.col("op").isin("insert", "delete"))).write.mode("overwrite").parquet(f"{root}/v{n}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_up(log: DataFrame, store: VectorStore, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Keep the store up to date: a batch writes what it changes under its own number, so that one run again gives the same.
    Now and then buckets are compacted, before a batch, so that they hold earlier ones only."""

    def step(batch: DataFrame, n: int) -> None:
        if n and n % compact_every == 0:
            store.compact()
        store.apply(batch.where(F.col("op").isin("insert", "delete")), n)

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
