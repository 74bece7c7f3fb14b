"""Approximate nearest neighbours by learned partitions.

A bounded hash sample of distinct vectors is turned into a neighbour graph; the graph is cut into many parts of equal size
(recursive halving along principal directions, then refinement by neighbours' votes under a capacity); a small classifier
(softmax regression) learns where a vector's graph neighbours are. It assigns every vector to a part and routes a query to
its `probes` most probable parts, where all vectors are compared exactly. `probes` is the least number that reaches
`recall` for held-out sample vectors whose true neighbours among all rows one pass finds.

Parts of successive numbers share a shard of bounded size; a large part is dealt to several, so no part is one task's. A
query goes once to each shard that it probes, with the names of its parts there; shards are read as a stream, vectors
first, so a task holds one shard and a batch of queries. A shard is copied once for every `query_block` queries.

Equal vectors are one entry with their few smallest ids: more can't be among a query's nearest.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors of different lengths have no cosine, so each length is searched by itself; an empty table gives an
empty result; a repeated row counts once; fewer candidates than k give fewer rows; ties go to the smaller id; other columns
are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors
from .components import meet


@dataclasses.dataclass(frozen=True)
class Settings:
    """part_rows: rows of a part where `most_parts` allows; asked: held-out vectors that `probes` is chosen by, an eighth of the
    sample at most; block: rows of a
    shard, 0 for a 64th of all within 1,024 and 65,536."""

    k: int = 5
    sample: int = 16384
    part_rows: int = 16
    most_parts: int = 1024
    graph: int = 10
    recall: float = 0.93
    asked: int = 256
    block: int = 0
    query_block: int = 1 << 20
    epochs: int = 8
    seed: int = 5


@dataclasses.dataclass
class Router:
    w: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return self.w.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    y = x.astype(np.float32)
    for at in range(0, len(x), 512):
        s = y[at : at + 512] @ y.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    """A part for each vector, at most 1.05 times the mean in any."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        c = x[rows] - x[rows].mean(0)
        way = rng.normal(size=x.shape[1])
        for _ in range(8):
            way = c.T @ (c @ way)
            way /= np.linalg.norm(way) + 1e-30
        rows = rows[np.argsort(c @ way, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(rows[:cut], first, n // 2), (rows[cut:], first + n // 2, n - n // 2)]
    cap, sizes = int(1.05 * len(x) / parts) + 1, np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            near, votes = np.unique(label[graph[i]], return_counts=True)
            own = votes[near == label[i]].sum()
            votes = np.where(sizes[near] < cap, votes, -1)
            best = int(near[votes.argmax()])
            if votes.max() > own:
                sizes[label[i]] -= 1
                sizes[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, targets: np.ndarray, label: np.ndarray, parts: int, s: Settings, rng: np.random.Generator) -> Router:
    """Softmax regression from the parts' mean directions, by Adam, towards the parts of each vector's neighbours."""
    w = np.zeros((parts, x.shape[1]))
    np.add.at(w, label, x)
    w = 10 * (w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-12)).T
    first, second, t, many = 0.0, 0.0, 0, targets.shape[1]
    for _ in range(s.epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            z = x[rows] @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            np.add.at(p, (np.repeat(np.arange(len(rows)), many), targets[rows].ravel()), -1 / many)
            g = x[rows].T @ p / len(rows)
            t += 1
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w = w - 0.02 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Router(w)


def fit(x: np.ndarray, total: int, s: Settings) -> Router:
    """x: unit vectors of the sample."""
    rng = np.random.default_rng(s.seed)
    parts = int(min(s.most_parts, max(1, total // s.part_rows), max(1, len(x) // 8)))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)))
    graph = neighbour_graph(x, s.graph)
    label = balanced_parts(x, graph, parts, rng)
    return train_router(x, label[np.concatenate([np.arange(len(x))[:, None], graph], 1)], label, parts, s, rng)


def shards(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """(first shard, number of shards) of each part: successive small parts share one, a large part has several."""
    out, shard, held = {}, -1, block
    for part, n in sorted(sizes.items()):
        if held + n > block:
            shard, held = shard + 1, 0
        many = -(-n // block)
        out[part] = (shard, many)
        shard, held = shard + many - 1, held + n if many == 1 else block
    return out


class Shard:
    """Vectors of a shard by part, compared with batches of queries."""

    def __init__(self, v: list[np.ndarray], ids: list[pa.Array], part: list[np.ndarray]):
        part_ = np.concatenate(part)
        order = np.argsort(part_, kind="stable")
        self.x = vectors.unit(np.concatenate(v))[order]
        self.ids = pa.concat_arrays(ids).take(pa.array(order))
        self.low = np.asarray(pc.list_element(self.ids, 0))
        self.parts, self.first = np.unique(part_[order], return_index=True)
        self.end = np.append(self.first[1:], len(order))

    def nearest(self, q: np.ndarray, probes: pa.Array, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the vector, cosine): the `keep` nearest of each query in the parts it probes."""
        asks = np.repeat(np.arange(len(q)), np.asarray(pc.list_value_length(probes)))
        wanted = np.asarray(probes.flatten())
        order = np.argsort(wanted, kind="stable")
        asks, wanted = asks[order], wanted[order]
        ask, hit, score = [], [], []
        for part, a, b in zip(self.parts, self.first, self.end, strict=True):
            own = asks[np.searchsorted(wanted, part) : np.searchsorted(wanted, part, side="right")]
            few = min(keep, b - a)
            for at in range(0, len(own), step := max(1, (1 << 22) // (b - a))):
                some = own[at : at + step]
                sims = q[some] @ self.x[a:b].T
                edge = np.partition(sims, b - a - few, axis=1)[:, b - a - few]
                i, j = np.nonzero(sims >= edge[:, None] - 1e-12)
                ask.append(some[i])
                hit.append(j + a)
        if not ask:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        ask_, hit_ = np.concatenate(ask), np.concatenate(hit)
        score_ = np.concatenate([(q[ask_[at : at + 65536]] * self.x[hit_[at : at + 65536]]).sum(1) for at in range(0, len(ask_), 65536)])
        order = np.lexsort((self.low[hit_], -score_, ask_))
        ask_, hit_, score_ = ask_[order], hit_[order], score_[order]
        start = np.concatenate([[True], ask_[1:] != ask_[:-1]])
        nth = np.arange(len(ask_)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        return ask_[nth < keep], hit_[nth < keep], score_[nth < keep]


def search(table: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose id is divisible by `every`."""
    s = settings or Settings()
    rows = vectors.cast(table, id_col, vector_col)
    rows = rows.where(vectors.usable(F.col("v")) & F.col("vec_id").isNotNull())
    asks = F.max(F.pmod("vec_id", F.lit(every)) == 0)
    lengths = [r.n for r in rows.groupBy(F.size("v").alias("n")).agg(asks.alias("asks")).orderBy("n").collect() if r.asks]
    found = [search_length(rows.where(F.size("v") == n), n, every, s) for n in lengths]
    return functools.reduce(DataFrame.union, found) if found else table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def search_length(rows: DataFrame, dim: int, every: int, s: Settings) -> DataFrame:
    """search among rows (vec_id, v) of one length."""
    spark, keep = rows.sparkSession, s.k + 1

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, ids = vectors.matrix(batch.column("v"), dim), np.asarray(batch.column("vec_id"))
            order = np.lexsort((ids, *m.T))
            m, ids = m[order], ids[order]
            new = np.concatenate([[True], (m[1:] != m[:-1]).any(1)])
            fresh = new | np.concatenate([[True], ids[1:] != ids[:-1]])
            m, ids, new = m[fresh], ids[fresh], new[fresh]
            starts = np.flatnonzero(new)
            nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            few = nth < keep
            sizes = np.add.reduceat(few.astype(np.int64), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids[few]))
            yield pa.RecordBatch.from_arrays([vectors.array_of(m[starts]), lists], ["v", "ids"])

    entries = rows.mapInArrow(smallest, "v array<double>, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    entries = common.stage(entries, "ann-entries")
    total = entries.count()
    share = int(min(1.0, s.sample / max(1, total)) * (1 << 30)) + 1
    sample = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).select("v").toArrow()  # about s.sample rows
    x = vectors.unit(np.array(sample["v"].to_pylist(), float)) if sample.num_rows else np.zeros((0, dim))
    x = x[np.lexsort(x.T)]
    away = np.zeros(len(x), bool)  # held out: the fit never sees them
    away[np.random.default_rng(s.seed).permutation(len(x))[: min(s.asked, len(x) // 8)]] = True
    router = fit(x[~away], total, s)
    shared = spark.sparkContext.broadcast(router)
    parts_of = lambda v: shared.value.logits(vectors.unit(vectors.matrix(v, dim)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(parts_of(batch.column("v")).argmax(1), pa.int32())], ["v", "ids", "part"])

    placed = common.stage(entries.mapInArrow(assign, "v array<double>, ids array<long>, part int"), "ann-placed")
    common.unstage(entries)
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    probes = needed_probes(placed, router, x[away], dim, s)
    where = shards(sizes, s.block or min(1 << 16, max(1 << 10, total >> 6)))
    plan = spark.createDataFrame([(p, first, many) for p, (first, many) in where.items()], "part int, first int, many int")  # a row for each part
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    unique = common.stage(asked.groupBy("v").agg(F.min("vec_id").alias("q"), F.count("*").alias("n")), "ann-queries")
    salts = max(1, -(-unique.count() // s.query_block))
    salt = F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("salt")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard, with the parts to probe there."""
        first, many = np.full(router.parts, -1), np.zeros(router.parts, np.int64)
        for p, (a, n) in where.items():
            first[p], many[p] = a, n
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                z = parts_of(part.column("v"))
                z[:, first < 0] = -np.inf
                best = np.argpartition(-z, min(probes, z.shape[1]) - 1, axis=1)[:, :probes].ravel()
                row = np.repeat(np.arange(len(z)), min(probes, z.shape[1]))
                row, best = row[first[best] >= 0], best[first[best] >= 0]
                row, best, n = np.repeat(row, many[best]), np.repeat(best, many[best]), many[best]
                shard = first[best] + np.arange(len(best)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((best, shard, row))
                row, best, shard = row[order], best[order], shard[order]
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])) if len(row) else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(best, pa.int32()))
                take = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([pa.array(shard[start], pa.int32()), part.column("salt").take(take), part.column("v").take(take), part.column("q").take(take), lists], ["shard", "salt", "v", "q", "parts"])

    routed = unique.select("v", "q", salt).mapInArrow(route, "shard int, salt int, v array<double>, q long, parts array<int>")
    own = placed.join(F.broadcast(plan), "part").select((F.col("first") + F.pmod(F.xxhash64("ids"), F.col("many"))).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "v", F.lit(None).cast("long").alias("q"), F.array("part").alias("parts"), "ids")
    both = own.unionByName(routed.withColumn("ids", F.lit(None).cast("array<long>")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and salt, vectors first."""
        at, held, shard = None, ([], [], []), None
        for batch in batches:
            key = np.asarray(batch.column("shard")).astype(np.int64) << 32 | np.asarray(batch.column("salt"))
            asks = np.asarray(batch.column("q").is_valid())
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(edges, np.append(edges[1:], len(key)), strict=True):
                some = batch.slice(a, b - a)
                if key[a] != at:
                    at, held, shard = key[a], ([], [], []), None
                v = vectors.matrix(some.column("v"), dim)
                if not asks[a]:
                    for into, x in zip(held, (v, some.column("ids"), np.asarray(some.column("parts").flatten())), strict=True):
                        into.append(x)
                    continue
                if shard is None and held[0]:
                    shard, held = Shard(*held), ([], [], [])
                if shard is None:
                    continue
                ask, hit, score = shard.nearest(vectors.unit(v), some.column("parts"), keep)
                yield pa.RecordBatch.from_arrays([some.column("q").take(pa.array(ask)), pa.array(score), shard.ids.take(pa.array(hit))], ["q", "score", "ids"])

    near = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("q").isNotNull()).select("shard", "salt", "v", "q", "parts", "ids").mapInArrow(common.tidy(compare), "q long, score double, ids array<long>")
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("nth") <= keep)
    best = best.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))))).alias("found"))
    best = common.stage(best, "ann-found")
    asks = meet(asked, unique, "v", unique.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select(F.col("vec_id").alias("query_id"), "q")
    five = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, s.k)
    return asks.join(best, "q").select("query_id", F.posexplode(five).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def needed_probes(placed: DataFrame, router: Router, asked: np.ndarray, dim: int, s: Settings) -> int:
    """The least number of probes that finds `recall` of the true neighbours, among all rows, of vectors that were held out;
    all parts if there are none."""
    if router.parts == 1 or not len(asked):
        return router.parts
    shared = placed.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, part = np.full((len(shared.value), s.k), -2.0), np.zeros((len(shared.value), s.k), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                sims = shared.value @ vectors.unit(vectors.matrix(some.column("v"), dim)).T
                sims[sims > 1 - 1e-12] = -2  # itself
                both = np.concatenate([score, sims], 1)
                home = np.concatenate([part, np.broadcast_to(np.asarray(some.column("part")), sims.shape)], 1)
                top = np.argpartition(-both, s.k - 1, axis=1)[:, : s.k]
                score, part = np.take_along_axis(both, top, 1), np.take_along_axis(home, top, 1)
        i = np.repeat(np.arange(len(score)), s.k)
        good = score.ravel() > -2
        yield pa.RecordBatch.from_arrays([pa.array(i[good], pa.int32()), pa.array(score.ravel()[good]), pa.array(part.ravel()[good], pa.int32())], ["i", "score", "part"])

    found = placed.select("v", "part").mapInArrow(nearest, "i int, score double, part int")
    best = Window.partitionBy("i").orderBy(F.desc("score"), "part")
    true = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= s.k).select("i", "part").toPandas()  # asked * k rows at most
    if not len(true):
        return router.parts
    rank = np.argsort(np.argsort(-router.logits(asked), axis=1), axis=1)
    needed = np.sort(rank[true["i"].to_numpy(), true["part"].to_numpy()])
    return int(needed[int(np.ceil(s.recall * len(needed))) - 1]) + 1


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
