"""Build an index into a store, and search it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ann, blocks, bm25, fusion
from .operators.chunk import chunk_corpus
from .sources.stage import stage
from .sources.store import Store


def build(spark: SparkSession, pages: DataFrame, root: str, dense: bool = True, embed: Callable[[DataFrame], DataFrame] = ann.hashing_embedding) -> Store:
    """pages (page_id, title, content) -> chunk meta, postings in blocks, statistics and, if dense, vectors and their lists.
    embed: texts (text_id, text) -> (text_id, embedding)."""
    store = Store(spark, root)
    store.save("chunks", chunk_corpus(pages))
    return _indexed(store, dense, embed)


def append(spark: SparkSession, pages: DataFrame, root: str, embed: Callable[[DataFrame], DataFrame] = ann.hashing_embedding) -> Store:
    """More pages into a store: their chunks are numbered after those that are there, which keep their ids. Weights depend on
    all chunks, so postings are made anew; vectors are added, and dealt to lists anew, if the store has any."""
    store = Store(spark, root)
    start = store.load("chunk_meta").agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0]
    new = stage(chunk_corpus(pages, start), "chunks-more")
    store.save("chunks", new, mode="append")
    return _indexed(store, store.exists("vectors"), embed, new)


def _indexed(store: Store, dense: bool, embed: Callable[[DataFrame], DataFrame], new: DataFrame | None = None) -> Store:
    chunks = store.load("chunks")
    store.save_chunk_meta(chunks)
    index = bm25.build(chunks)
    store.save("postings", index.blocks().sortWithinPartitions("term", "block"))
    store.save("bm25_stats", index.stats)
    if dense:
        texts = (chunks if new is None else new).select(F.col("chunk_id").alias("text_id"), "text")
        store.save("vectors", embed(texts).withColumnRenamed("text_id", "vec_id"), mode="overwrite" if new is None else "append")
        centroids, listed = ann.build(store.load("vectors"))
        store.save("centroids", centroids)
        store.save("lists", listed, partition_by="list_id")
    return store


def run(queries: DataFrame, store: Store) -> DataFrame:
    """(query_id, rank, page_id, score); raises if the index isn't there."""
    store.require("postings", "chunk_meta", "bm25_stats")
    return fusion.search(queries, store.load("postings"), store.load("bm25_stats"), store.load("chunk_meta"))


def run_hybrid(queries: DataFrame, store: Store, k: int = 200, nprobe: int = ann.NPROBE, embed: Callable[[DataFrame], DataFrame] = ann.hashing_embedding) -> DataFrame:
    """`hybrid` over a store. nprobe 0: all lists that can hold a result, so that the search is exact."""
    store.require("postings", "bm25_stats", "chunk_meta", "centroids", "lists")
    lists = store.load("lists")
    near = lambda vectors: ann.search(store.load("centroids"), lists, vectors, k, nprobe) if nprobe else ann.search_exact(lists, vectors, k)
    return hybrid(queries, lambda terms: store.load("postings"), store.load("bm25_stats"), near, store.load("chunk_meta"), k, embed)


def hybrid(queries: DataFrame, index: Callable[[DataFrame], DataFrame], stats: DataFrame, near: Callable[[DataFrame], DataFrame], meta: DataFrame, k: int = 200, embed: Callable[[DataFrame], DataFrame] = ann.hashing_embedding) -> DataFrame:
    """The earlier three-way retriever: BM25 (weight 4), the query's vector and those of its hypothetical texts (1 each).
    index: terms (term) -> postings in blocks, theirs at least; near: vectors (query_id, qvec) -> (query_id, rank, vec_id), the k
    nearest chunks; embed: as these were embedded."""
    terms = stage(fusion.query_terms(queries.select("query_id", F.lit(0).cast("bigint").alias("stream_id"), F.lit(False).alias("years_only"), F.col("query").alias("text"))), "terms")
    sparse = blocks.query(index(terms), stats, terms, k).select("query_id", "stream_id", F.lit(4.0).alias("weight"), "chunk_id", "rank")
    texts = queries.select("query_id", F.lit(-1).alias("variant"), F.col("query").alias("text")).union(fusion.hypothetical_texts(queries))
    named = texts.select(F.struct("query_id", "variant").alias("text_id"), "text")
    found = near(embed(named).select(F.col("text_id").alias("query_id"), F.col("embedding").alias("qvec")))
    dense = found.select(F.col("query_id.query_id").alias("query_id"), (F.col("query_id.variant") + 2).cast("bigint").alias("stream_id"), F.lit(1.0).alias("weight"), F.col("vec_id").alias("chunk_id"), F.col("rank").cast("int").alias("rank"))
    return fusion.page_rank(fusion.rrf(sparse.unionByName(dense)), meta)
