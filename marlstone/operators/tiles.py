"""Queries against vectors by inner product, as a join of tiles.

Queries are dealt into tiles of bounded bytes, vectors into as many as there are shuffle partitions; every tile of queries
meets every tile of vectors in one group. A group is sorted with its queries first, so a task holds these as a matrix and
streams the vectors past them; what it keeps of them doesn't depend on their number. Nothing goes through the driver but how
many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries in a tile and their bytes, at most; results in a batch.
MOST_QUERIES, TILE_BYTES, STEP = 1 << 16, 64 << 20, 1 << 22
SLAB = 1 << 10  # queries, and vectors, whose scores are computed at once
DIGITS = 6

Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # places of queries, ids, scores


class Best:
    """Keeps the k best of each query, ties to the smaller id, as rows (place, id, score). Scores are computed `SLAB` by `SLAB`;
    of these only the ones that reach a query's k-th best so far are kept, and merged when they are many."""

    def __init__(self, queries: np.ndarray, k: int, more: np.ndarray | None = None):
        self.q, self.k = queries, k
        self.least = np.full(len(queries), -np.inf)
        self.held: Found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.new: list[Found] = []
        self.size = 0

    def see(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray | None = None) -> Iterator[Found]:
        """places: of the queries that these vectors are for, if not all."""
        every = np.arange(len(self.q)) if places is None else places
        for start in range(0, len(every), SLAB):
            rows = every[start : start + SLAB]
            for at in range(0, len(ids), SLAB):
                s = np.round(self.q[rows] @ vectors[at : at + SLAB].T, DIGITS)
                least = self.least[rows]
                if s.shape[1] > self.k and np.isneginf(least).any():  # none known so far: the k-th best of these scores
                    least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero(~(s < least[:, None]))
                self.new.append((rows[i], ids[at : at + SLAB][j], s[i, j]))
                self.size += len(i)
                if self.size > max(SLAB * SLAB, len(self.held[0])):
                    self.merge()
        return iter(())

    def merge(self) -> None:
        place, ids, score = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        key = np.where(np.isnan(score), -np.inf, -score)  # not a number is the highest, as in SQL
        order = np.lexsort((ids, key, place))
        place = place[order]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        nth = np.arange(len(place)) - np.repeat(starts, np.diff(starts, append=len(place)))
        last = np.flatnonzero(nth == self.k - 1)
        self.least[place[last]] = -key[order[last]]
        kept = order[nth < self.k]
        self.held, self.new, self.size = (place[nth < self.k], ids[kept], score[kept]), [], 0

    def end(self) -> Iterator[Found]:
        self.merge()
        yield self.held


class Above:
    """Emits all pairs with a score of the query's own limit or more."""

    def __init__(self, queries: np.ndarray, k: int, more: np.ndarray):
        self.q, self.least = queries, more

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[Found]:
        for start in range(0, len(self.q), SLAB):
            for at in range(0, len(ids), SLAB):
                s = self.q[start : start + SLAB] @ vectors[at : at + SLAB].T
                i, j = np.nonzero(s >= self.least[start : start + SLAB, None])
                yield start + i, ids[at : at + SLAB][j], s[i, j]

    def end(self) -> Iterator[Found]:
        return iter(())


def matrix(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten().cast(pa.float64()))
    return flat.reshape(len(lists), -1)


def tile_counts(asked: DataFrame, most_queries: int = MOST_QUERIES, tile_bytes: int = TILE_BYTES) -> tuple[int, int]:
    """asked (v, ...) -> into how many tiles queries go, and vectors."""
    n, size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    across = max(1, -(-n // max(1, min(most_queries, tile_bytes // max(8, 8 * (size or 1))))))
    return across, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def meet(store: DataFrame, queries: DataFrame, kind: Callable[..., Best | Above], k: int = 10, most_queries: int = MOST_QUERIES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """store (vec_id, embedding), queries (query_id, qvec[, least]) -> (query_id, vec_id, score), what `kind` keeps in each pair
    of tiles. Null vectors take no part."""
    least = F.col("least").cast("double") if "least" in queries.columns else F.lit(None).cast("double")
    asked = queries.where(F.col("qvec").isNotNull()).select(F.col("query_id").cast("long").alias("id"), F.col("qvec").cast("array<double>").alias("v"), least.alias("least"))
    across, down = tile_counts(asked, most_queries, tile_bytes)
    tile = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    rows = asked.select("*", tile(across).alias("a"), F.lit(0).alias("kind")).select("id", "v", "least", "kind", "a", every(down).alias("b"))
    held = store.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.lit(None).cast("double").alias("least"), F.lit(1).alias("kind"))
    held = held.select("id", "v", "least", "kind", tile(down).alias("b"), every(across).alias("a")).select("id", "v", "least", "kind", "a", "b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: tuple[int, int] | None = None
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        limits: list[np.ndarray] = []
        seeing: Best | Above | None = None
        names = np.empty(0, np.int64)

        def said(found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
            for i, vec, score in found:
                for at in range(0, len(i), STEP):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i[at : at + STEP]]), pa.array(vec[at : at + STEP]), pa.array(score[at : at + STEP])], ["query_id", "vec_id", "score"])

        for batch in batches:
            a, b, which = (np.asarray(batch.column(c)) for c in ("a", "b", "kind"))
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(which) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if start == end:
                    continue
                if (a[start], b[start]) != where:
                    if seeing:
                        yield from said(seeing.end())
                    where, ids, parts, limits, seeing = (a[start], b[start]), [], [], [], None
                part = batch.slice(start, end - start)
                own, vectors = np.asarray(part.column("id")), matrix(part.column("v"))
                if which[start] == 0:
                    ids.append(own)
                    parts.append(vectors)
                    limits.append(part.column("least").to_numpy(zero_copy_only=False))
                elif ids:
                    if seeing is None:
                        names = np.concatenate(ids)
                        seeing = kind(np.concatenate(parts), k, np.concatenate(limits))
                        parts = []
                    yield from said(seeing.see(own, vectors))
        if seeing:
            yield from said(seeing.end())

    dealt = rows.unionByName(held).repartition("a", "b").sortWithinPartitions("a", "b", "kind", "id")
    return dealt.mapInArrow(of, "query_id long, vec_id long, score double")


def meet_lists(listed: DataFrame, asked: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    """listed (list_id, part, vec_id, embedding), asked (nth, qvec), probes (nth, list_id, part) -> (nth, vec_id, score): what
    each tile of parts has as the k best of each query, among the parts that the query probes. A query goes once to each tile
    with a part of its; a task holds a tile's queries as a matrix and streams the parts past them, one after another."""
    asked = asked.where(F.col("qvec").isNotNull()).select(F.col("nth").alias("id"), F.col("qvec").cast("array<double>").alias("v"))
    across, down = tile_counts(asked)
    key = (F.col("list_id").cast("long") * (1 << 24) + F.col("part")).alias("key")
    tile, turn = F.pmod(F.xxhash64("key"), F.lit(down)).cast("int").alias("b"), F.pmod(F.xxhash64("id"), F.lit(across)).cast("int").alias("a")
    wanted = probes.select(F.col("nth").alias("id"), key).select("id", "key", tile).groupBy("id", "b").agg(F.collect_list("key").alias("keys"))
    rows = asked.join(wanted, "id").select("id", "v", "keys", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), turn, "b")
    held = listed.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.lit(None).cast("array<long>").alias("keys"), F.lit(1).alias("kind"), key)
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"), tile)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: tuple[int, int] | None = None
        waiting: list[pa.RecordBatch] = []
        seeing: Best | None = None
        names = places = keys = np.empty(0, np.int64)

        def said() -> Iterator[pa.RecordBatch]:
            for i, vec, score in seeing.end() if seeing else ():
                for at in range(0, len(i), STEP):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i[at : at + STEP]]), pa.array(vec[at : at + STEP]), pa.array(score[at : at + STEP])], ["nth", "vec_id", "score"])

        for batch in batches:
            a, b, which, key = (np.asarray(batch.column(c)) for c in ("a", "b", "kind", "key"))
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(which) != 0) | (np.diff(key) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if start == end:
                    continue
                if (a[start], b[start]) != where:
                    yield from said()
                    where, waiting, seeing = (a[start], b[start]), [], None
                part = batch.slice(start, end - start)
                if which[start] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    names = np.concatenate([np.asarray(x.column("id")) for x in waiting])
                    seeing = Best(np.concatenate([matrix(x.column("v")) for x in waiting]), k)
                    many = np.concatenate([x.column("keys").value_lengths().to_numpy() for x in waiting])
                    keys = np.concatenate([np.asarray(x.column("keys").flatten()) for x in waiting])
                    order = np.argsort(keys, kind="stable")
                    keys, places, waiting = keys[order], np.repeat(np.arange(len(names)), many)[order], []
                if seeing:
                    first, last = np.searchsorted(keys, [key[start], key[start] + 1])
                    seeing.see(np.asarray(part.column("id")), matrix(part.column("v")), places[first:last])
        yield from said()

    dealt = rows.unionByName(held).repartition("a", "b").sortWithinPartitions("a", "b", "kind", "key")
    return dealt.mapInArrow(of, "nth long, vec_id long, score double")
