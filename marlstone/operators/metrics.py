"""Ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discount(rank: Column) -> Column:
    """Ranks 1 and 2 weigh 1, then 1 / log2(rank)."""
    return F.when(rank <= 1, 1.0).otherwise(1 / F.log2(rank))


def distinct_ranks(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, rank, page_id): a page's later places go and the others move up."""
    first = ranked.groupBy("query_id", "page_id").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).select("query_id", "page_id", "rank")


def ndcg(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) for each of queries (query_id); relevant (query_id, page_id). Without relevant pages: 0."""
    pages = distinct_ranks(ranked).where(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "page_id"])
    dcg = pages.groupBy("query_id").agg(F.sum(discount(F.col("rank"))).alias("dcg"))
    n = relevant.distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda acc, i: acc + discount(i))
    out = queries.select("query_id").join(n, "query_id", "left").join(dcg, "query_id", "left")
    return out.select("query_id", F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def mean_ndcg(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"))


def recall(lists: DataFrame, k: int = 10) -> DataFrame:
    """lists (query_id, found, truth) -> (query_id, recall); an empty truth counts 1."""
    truth = F.slice("truth", 1, k)
    hit = F.size(F.array_intersect(F.slice("found", F.lit(1), F.size(truth)), truth))
    return lists.select("query_id", F.when(F.size("truth") == 0, 1.0).otherwise(hit / F.size(truth)).alias("recall"))


def evaluate_run(run: Callable[[DataFrame], DataFrame], queries: DataFrame, k: int = 10) -> float:
    """Mean NDCG of run, which gets queries (query_id, query) and gives (query_id, page_ids); queries has `relevant` too."""
    lists = run(queries.select("query_id", "query"))
    check_lists(lists, queries)
    ranked = lists.select("query_id", F.posexplode("page_ids").alias("rank", "page_id")).withColumn("rank", F.col("rank") + 1)
    truth = queries.select("query_id", F.explode("relevant").alias("page_id"))
    return mean_ndcg(ndcg(queries, ranked, truth, k)).first()[0]


def check_lists(lists: DataFrame, queries: DataFrame) -> None:
    """One list for each query, or an error."""
    if dict(lists.dtypes).get("page_ids") != "array<bigint>":
        raise TypeError("page_ids must be lists of ids")
    a, b = lists.count(), queries.count()
    if a != b:
        raise ValueError(f"{a} lists for {b} queries")
