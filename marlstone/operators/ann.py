"""Clustered search: k-means lists, the nearest lists of a query, exact scores inside them; a bound that makes it exact; and
pluggable embedders.

Lists of over `MOST` vectors are split in parts by a hash of the id, so that no list is one task's. A part's mean and radius
bound what it can hold for a query: no vector x of it has q.x above q.mean + |q| * radius. `search_exact` probes the nearest
parts, takes the k-th best score found as a limit, and then probes just those others whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import raw_tokens
from ..functions.vector import dot, l2_normalize
from ..sources.stage import stage
from . import collection, tiles

NPROBE, DIM, MOST = 32, 384, 1 << 14
RECALL = 0.95  # aimed at on the sample, so that other queries reach 0.9


def list_count(n: int) -> int:
    return max(64, int(n**0.5))


def build(store: DataFrame, lists: int | None = None, seed: int = 1, sample: int = 200_000, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(centroids (list_id, centroid), staged store with list_id and part). The centroids are fitted on a sample of at most
    about `sample` rows; every row gets a list."""
    n = store.count()
    lists = min(lists or list_count(n), max(2, n))
    rows = store.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    fit = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    model = KMeans(k=lists, seed=seed, featuresCol="v", predictionCol="list_id", distanceMeasure="cosine", maxIter=10).fit(fit)
    centers = [(i, [float(x) for x in c / (np.linalg.norm(c) or 1)]) for i, c in enumerate(model.clusterCenters())]
    listed = stage(model.transform(rows).drop("v"), "ann-listed")
    return store.sparkSession.createDataFrame(centers, "list_id int, centroid array<double>"), parted(listed, most)


def parted(listed: DataFrame, most: int = MOST) -> DataFrame:
    """listed (list_id, vec_id, ...) with `part`, of which a list has one for each `most` of its vectors."""
    many = listed.groupBy("list_id").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")  # few: at most one for `most` vectors
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")
    return listed.join(F.broadcast(many), "list_id", "left").withColumn("part", part).drop("parts")


def bounds(listed: DataFrame) -> DataFrame:
    """(list_id, part, mean, radius, n) of each part."""

    def of(group: pa.Table) -> pa.Table:
        x = tiles.matrix(group["embedding"].combine_chunks())
        mean = x.mean(0)
        radius = float(np.sqrt(((x - mean) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-9
        return pa.table({"list_id": group["list_id"][:1].cast(pa.int32()), "part": group["part"][:1].cast(pa.int32()), "mean": pa.array([mean.tolist()], pa.list_(pa.float64())), "radius": [radius], "n": [len(x)]})

    return listed.where(F.col("embedding").isNotNull()).select("list_id", "part", "embedding").groupBy("list_id", "part").applyInArrow(of, "list_id int, part int, mean array<double>, radius double, n long")


def _numbered(queries: DataFrame) -> DataFrame:
    """queries with `nth`, a number for whatever their id is; staged, so that it stays the same."""
    return stage(queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).withColumn("nth", F.monotonically_increasing_id()), "ann-queries")


def _named(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    best = collection._first(hits.withColumnRenamed("nth", "query_id"), k).withColumnRenamed("query_id", "nth")
    return best.join(asked.select("nth", "query_id"), "nth").select("query_id", "rank", "vec_id", "score")


def search(centroids: DataFrame, listed: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = NPROBE) -> DataFrame:
    """queries (query_id, qvec): the nprobe nearest lists, then the k best of their members."""
    asked = _numbered(queries)
    near = tiles.meet(centroids.select(F.col("list_id").alias("vec_id"), F.col("centroid").alias("embedding")), asked.select(F.col("nth").alias("query_id"), "qvec"), tiles.Best, nprobe)
    near = collection._first(near, nprobe).select(F.col("query_id").alias("nth"), F.col("vec_id").cast("int").alias("list_id"))
    probes = near.join(listed.select("list_id", "part").distinct(), "list_id")
    return _named(tiles.meet_lists(listed, asked, probes, k), asked, k)


def probes_for(centroids: DataFrame, listed: DataFrame, k: int = 10, recall: float = RECALL, sample: int = 256) -> int:
    """How many of the nearest lists hold that part of the exact k best, by brute force over all vectors for `sample` of them
    as queries; `NPROBE` at least."""
    some = listed.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    asked = stage(some.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "ann-sample")
    lists = centroids.select(F.col("list_id").alias("vec_id"), F.col("centroid").alias("embedding"))
    near = collection._first(tiles.meet(lists, asked, tiles.Best, 1 << 30), 1 << 30).select("query_id", F.col("vec_id").cast("int").alias("list_id"), F.col("rank").alias("place"))
    truth = collection.top_k_blocked(listed, asked, k).select("query_id", "vec_id").join(listed.select("vec_id", "list_id"), "vec_id")
    found = truth.join(near, ["query_id", "list_id"]).groupBy("place").count().orderBy("place").collect()  # a row for each place of a list at most
    total, seen = sum(r["count"] for r in found), 0
    for r in found:
        seen += r["count"]
        if seen >= recall * total:
            return max(NPROBE, r.place)
    return NPROBE


def probes_exact(listed: DataFrame, asked: DataFrame, k: int = 10, nprobe: int = 4) -> DataFrame:
    """asked (nth, qvec) -> staged (nth, list_id, part): the nprobe parts of nearest means, and all that can hold one of the k best."""
    key = F.col("list_id").cast("long") * (1 << 24) + F.col("part")
    parts = stage(bounds(listed).withColumn("vec_id", key), "ann-bounds")
    split = lambda df: df.select("nth", F.floor(F.col("vec_id") / (1 << 24)).cast("int").alias("list_id"), F.pmod("vec_id", F.lit(1 << 24)).cast("int").alias("part"))
    q = asked.select(F.col("nth").alias("query_id"), "qvec")
    near = collection._first(tiles.meet(parts.select("vec_id", F.col("mean").alias("embedding")), q, tiles.Best, nprobe), nprobe)
    first = stage(split(near.withColumnRenamed("query_id", "nth")), "ann-near")
    found = collection._first(tiles.meet_lists(listed, asked, first, k).withColumnRenamed("nth", "query_id"), k)
    limit = found.where(F.col("rank") == k).select("query_id", (F.col("score") - 10.0**-collection.DIGITS).alias("least"))
    norm = F.sqrt(dot(F.col("qvec"), F.col("qvec")))
    longer = q.join(limit, "query_id", "left").select("query_id", F.concat("qvec", F.array(norm)).alias("qvec"), F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    able = tiles.meet(parts.select("vec_id", F.concat("mean", F.array("radius")).alias("embedding")), longer, tiles.Above)
    return stage(split(able.withColumnRenamed("query_id", "nth")).union(first).distinct(), "ann-probes")


def search_exact(listed: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 4) -> DataFrame:
    """As collection.top_k over the listed vectors (list_id, part, vec_id, embedding), from the parts that can hold a result."""
    asked = _numbered(queries)
    return _named(tiles.meet_lists(listed, asked, probes_exact(listed, asked, k, nprobe), k), asked, k)


def search_tiles(store: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same over a store (vec_id, embedding) without lists: every vector is compared, by matrix products. Where bounds would
    leave little out, fitting and writing lists costs more than they spare."""
    asked = _numbered(queries)
    near = tiles.meet(store, asked.select(F.col("nth").alias("query_id"), "qvec"), tiles.Best, k)
    return _named(near.withColumnRenamed("query_id", "nth"), asked, k)


def hashing_embedding(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """texts (text_id, text) -> (text_id, embedding): hashed token counts on the unit sphere; needs no model."""
    n = texts.select("text_id", F.explode_outer(raw_tokens(F.col("text"))).alias("t")).groupBy("text_id", F.pmod(F.xxhash64("t"), F.lit(dim)).cast("int").alias("at")).agg(F.count("t").alias("n"))
    by_id = n.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return by_id.select("text_id", vector.alias("v")).select("text_id", l2_normalize(F.col("v")).cast("array<float>").alias("embedding"))


def model_embedding(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 128) -> DataFrame:
    """The same with a model: load() gives a function from texts to a matrix, once for each Python worker's task."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                m = np.asarray(model(part.iloc[at : at + batch].fillna("").tolist()), float)
                out += list((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            yield pd.Series(out)

    return texts.select("text_id", embed("text").alias("embedding"))


def letter_model() -> Callable[[list[str]], np.ndarray]:
    """The least of models: how often each letter of A-Z, in either case, occurs. It needs no files, and SQL can say the same."""

    def counts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 26))
        for row, text in zip(out, texts, strict=True):
            seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
            row += seen[65:91] + seen[97:123]
        return out

    return counts
