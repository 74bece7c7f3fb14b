"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


HOT = 256


def meet(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """rows join keys on `key`. keys has each key once, with the number n of its rows; the n sum to `total` at most.

    Keys with over 1/HOT of the total, fewer than HOT of them whatever the size, are broadcast, so that their rows stay
    where they are; the rows of all others are dealt by their key.
    """
    hot = F.col("n") * HOT > total
    loud = F.broadcast(keys.where(hot).drop("n"))
    return rows.join(loud, key).unionByName(rows.join(loud.select(key), key, "left_anti").join(keys.where(~hot).drop("n"), key))


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return meet(both.where(F.col("v") > F.col("u")), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return meet(down, least, "u", n).select("v", "m").union(least.select(F.col("u").alias("v"), "m")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any integer type, no self loops -> (node, root): every node that has a link, with the least node it reaches.

    Each half of a round is written to the shared folder, so plans stay short and a lost executor redoes one half at most.
    """
    edges = common.stage(edges.where(F.col("u") != F.col("v")).distinct(), "links")
    seen, n = None, edges.count()
    while True:  # each round that changes anything shortens the trees
        turned = common.stage(_large(edges, n), "links")  # n rows again
        after = common.stage(_small(turned, n), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        common.unstage(edges, turned)
        edges = after
        if now == seen:
            root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return root.union(root.select("root").distinct().select(F.col("root").alias("node"), "root"))
        seen, n = now, now[0]


def least_of(linked: DataFrame) -> DataFrame:
    """(x, least, root) -> (x, component_id): the smallest `least` of the rows with the same root."""
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return meet(linked.drop("least"), ids, "root", linked.count()).drop("root")
