"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

A unit vector x is s c + e with int8 codes c and a remainder e of known norm r. For two vectors
|x.y - s_x s_y c_x.c_y| <= r_x + r_y + r_x r_y, so a tile's integer product decides most pairs: below the threshold for
certain, or above it for certain. Tiles exchange codes, scales and remainders' norms only. (The products are taken in
floating point, where sums of products of codes are exact integers, since that is what matrix libraries are fast at.) Rows
that have a pair between are then fetched in double precision, tile pair by tile pair, and just those pairs are computed
again. All pairs of tiles are compared, so nothing is missed; a tile pair emits a count of links per vector and a spanning
forest, never all pairs.

Equal vectors are one entry with a count. Work grows with the square of the number of distinct vectors (as comparing
all rows does), in independent tasks of bounded memory; a vector's codes go out once for each tile, of up to TILE vectors and TILE_BYTES.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths have no cosine, so links are within a length; an empty table gives an empty result; every row is a vector of its
own, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors
from .components import components, least_of, meet

#: Vectors of a tile at most, of a product in it, and tiles where there are enough vectors for them (of LEAST each).
TILE, SUB, TILES, LEAST = 65536, 1024, 8, 2048
#: Bytes of a tile in double precision, at most.
TILE_BYTES = 64 << 20
SLACK = 1e-9  # over what rounding in double precision can add
#: (uid, codes as float32 or float64, scale, norm of the remainder, count)
Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tile_rows(dim: int) -> int:
    """Vectors of a tile at most, by their length."""
    return max(1, min(TILE, TILE_BYTES // (8 * dim)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and norms of the remainders of unit vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    rest = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes.astype(np.int8), scale, rest + SLACK


def products(a: Side, b: Side, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure): the pairs that may have a cosine of `least` or more, and whether they have it for certain. same: a and
    b are the same rows, and pairs come once, i < j."""
    for at in range(0, len(a[0]), SUB):
        x, sx, rx = (c[at : at + SUB] for c in a[1:4])
        for to in range(at if same else 0, len(b[0]), SUB):
            y, sy, ry = (c[to : to + SUB] for c in b[1:4])
            widest = rx.max() + ry.max() + rx.max() * ry.max() + 1e-5
            near = x @ y.T
            near *= sy[None, :].astype(x.dtype)
            i, j = np.nonzero(near >= ((least - widest) / sx)[:, None].astype(x.dtype))
            if same and at == to:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            exact = (x[i].astype(float) * y[j]).sum(1) if len(i) <= SUB else (x.astype(float) @ y.T.astype(float))[i, j]
            cosine, doubt = exact * sx[i] * sy[j], rx[i] + ry[j] + rx[i] * ry[j]
            may = cosine + doubt >= least
            yield i[may] + at, j[may] + to, (cosine - doubt >= least)[may]


class Links:
    """Counts of links and a spanning forest, as pairs come."""

    def __init__(self, a: Side, b: Side, same: bool):
        self.n, self.same = (a[4], b[4]), same
        self.names = a[0] if same else np.concatenate([a[0], b[0]])
        self.count = np.zeros(len(self.names), np.int64)
        self.label = np.arange(len(self.names))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        to = j if self.same else j + len(self.n[0])
        self.count += np.bincount(i, weights=self.n[1][j], minlength=len(self.names)).astype(np.int64)
        self.count += np.bincount(to, weights=self.n[0][i], minlength=len(self.names)).astype(np.int64)
        while len(i):
            u, v = self.label[i], self.label[to]
            apart = u != v
            i, to, u, v = i[apart], to[apart], u[apart], v[apart]
            if not len(i):
                break
            np.minimum.at(self.label, np.maximum(u, v), np.minimum(u, v))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, n): v is -1 with the links of u, else another vector of u's tree."""
        hit, moved = np.flatnonzero(self.count), np.flatnonzero(self.label != np.arange(len(self.label)))
        none = np.zeros(len(moved), np.int64)
        return np.concatenate([self.names[hit], self.names[moved]]), np.concatenate([np.full(len(hit), -1), self.names[self.label[moved]]]), np.concatenate([self.count[hit], none])


def sides(group: pa.Table, dim: int) -> tuple[Side, Side, bool]:
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products of codes stay exact
    codes = np.frombuffer(b"".join(group["codes"].to_pylist()), np.int8).reshape(-1, dim).astype(kind)
    whole = (group["uid"].to_numpy(), codes, group["scale"].to_numpy(), group["rest"].to_numpy(), group["n"].to_numpy())
    if group["a"][0] == group["b"][0]:
        return whole, whole, True
    left = group["left"].to_numpy()
    return tuple(c[left] for c in whole), tuple(c[~left] for c in whole), False


def near_duplicates(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, few: int = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of the table."""
    spark = table.sparkSession
    rows = vectors.cast(table, id_col, vector_col)
    part = vectors.usable(F.col("v"))
    valid = rows.where(part)
    entries = valid.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("uid", F.monotonically_increasing_id())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in vectors.by_length(batch, "v"):
                codes, scale, rest = quantise(vectors.unit(vectors.matrix(some.column("v"), dim)))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("uid", "v", "n", "least")), pa.array(np.full(len(codes), dim, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(rest)], ["uid", "v", "n", "least", "dim", "codes", "scale", "rest"])

    schema = "uid long, v array<double>, n long, least long, dim int, codes binary, scale double, rest double"
    entries = common.stage(entries.select("uid", "v", "n", "least").mapInArrow(code, schema), "dedup-entries")
    sizes = entries.groupBy("dim").agg(F.count("*").alias("many"), F.sum("n").alias("rows")).collect()  # a row for each length
    tiles = spark.createDataFrame([(r.dim, max(1, -(-r.many // min(tile, tile_rows(r.dim))), min(TILES, -(-r.many // few)))) for r in sizes], "dim int, tiles int")
    t = F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")
    placed = entries.join(F.broadcast(tiles), "dim").withColumn("t", t)
    dealt = placed.select("dim", "uid", "n", "codes", "scale", "rest", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pair = (F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b"), (F.col("t") <= F.col("other")).alias("left"))
    dealt = dealt.select("dim", *pair, "uid", "n", "codes", "scale", "rest")
    out = "dim int, a int, b int, left boolean, u long, v long, n long"

    def told(group: pa.Table, u: np.ndarray, v: np.ndarray, n: np.ndarray, left: np.ndarray) -> pa.Table:
        one = lambda c: pa.array(np.full(len(u), group[c][0].as_py(), np.int32))
        return pa.table({"dim": one("dim"), "a": one("a"), "b": one("b"), "left": pa.array(left), "u": pa.array(u.astype(np.int64)), "v": pa.array(v.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    def compare(group: pa.Table) -> pa.Table:
        """Counts and trees of the certain links; v is -2 for the rows that have an uncertain one."""
        a, b, same = sides(group, group["dim"][0].as_py())
        links, in_doubt = Links(a, b, same), (np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool))
        for i, j, sure in products(a, b, same, least):
            links.add(i[sure], j[sure])
            in_doubt[0][i[~sure]] = True
            in_doubt[1][j[~sure]] = True
        ask = (a[0][in_doubt[0] | in_doubt[1]], b[0][:0]) if same else (a[0][in_doubt[0]], b[0][in_doubt[1]])
        u, v, n = links.rows()
        more = len(ask[0]) + len(ask[1])
        left = np.concatenate([np.ones(len(u) + len(ask[0]), bool), np.zeros(len(ask[1]), bool)])
        return told(group, np.concatenate([u, *ask]), np.concatenate([v, np.full(more, -2)]), np.concatenate([n, np.zeros(more, np.int64)]), left)

    def settle(group: pa.Table) -> pa.Table:
        """The same for the uncertain pairs, in double precision."""
        dim = group["dim"][0].as_py()
        a, b, same = sides(group, dim)
        x = vectors.unit(vectors.matrix(group["v"].combine_chunks(), dim))
        left = group["left"].to_numpy()
        x, y = (x, x) if same else (x[left], x[~left])
        links = Links(a, b, same)
        for i, j, sure in products(a, b, same, least):
            i, j = i[~sure], j[~sure]
            above = np.concatenate([(x[i[at : at + 65536]] * y[j[at : at + 65536]]).sum(1) >= least for at in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            links.add(i[above], j[above])
        u, v, n = links.rows()
        return told(group, u, v, n, np.ones(len(u), bool))

    certain = common.stage(dealt.groupBy("dim", "a", "b").applyInArrow(compare, out), "dedup-found")
    asked = certain.where(F.col("v") == -2).select(F.col("u").alias("uid"), "a", "b", "left")
    again = asked.join(entries, "uid").select("dim", "a", "b", "left", "uid", "n", "codes", "scale", "rest", "v")
    settled = common.stage(again.groupBy("dim", "a", "b").applyInArrow(settle, out), "dedup-settled")
    found = certain.where(F.col("v") != -2).unionByName(settled)
    links = found.where(F.col("v") == -1).groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("links"))
    roots = components(found.where(F.col("v") >= 0).select("u", "v")).withColumnRenamed("node", "uid")
    near = common.stage(entries.select("uid", "least").join(roots, "uid"), "dedup-near")
    facts = entries.select("uid", "v", "n", "least").join(links, "uid", "left").join(least_of(near), "uid", "left").select("v", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    facts = common.stage(facts, "dedup-facts")
    common.unstage(entries, certain, settled, near)
    joined = meet(valid, facts, "v", sum(r.rows for r in sizes)).select("vec_id", "n_links", "component_id")
    alone = rows.where(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
