"""From questions to ranked pages: streams, reciprocal-rank fusion, page pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import with_stem
from . import blocks, bm25

#: Fixed values.
RRF_K, SUMMARY_BOOST, HITS, PAGES = 60, 1.5, 200, 10
MAIN, FULL, YEAR = 8.0, 4.0, 4.0


def streams(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) -> (query_id, stream_id, weight, years_only, text): the sub-queries (or the query), then
    the full query if there are several, then the years of the full query."""
    parts = queries.select("query_id", "query", T.decompose(F.col("query")).alias("parts"))
    n = F.size("parts")
    one = lambda text, weight, years: F.struct(text.alias("text"), F.lit(weight).alias("weight"), F.lit(years).alias("years_only"))
    main = F.transform("parts", lambda p: one(p, MAIN, False))
    full = F.when(n > 1, F.array(one(F.col("query"), FULL, False))).otherwise(F.array().cast("array<struct<text:string,weight:double,years_only:boolean>>"))
    every = F.concat(main, full, F.array(one(F.col("query"), YEAR, True)))
    return parts.select("query_id", F.posexplode(every).alias("stream_id", "s")).select("query_id", F.col("stream_id").cast("bigint").alias("stream_id"), "s.weight", "s.years_only", "s.text")


def query_terms(parts: DataFrame) -> DataFrame:
    """streams -> (query_id, stream_id, term), distinct: years and decades as they are, other tokens with their stems."""
    raw = parts.select("query_id", "stream_id", "years_only", F.explode(T.raw_tokens(F.col("text"))).alias("raw")).distinct()
    years = raw.where(T.is_year_like(F.col("raw"))).select("query_id", "stream_id", F.explode(T.decade(F.col("raw"))).alias("term"))
    words = raw.where(~F.col("years_only") & ~T.is_year_like(F.col("raw")))
    stems = with_stem(words.select(F.col("raw").alias("term")).distinct()).withColumnRenamed("term", "raw")
    words = words.join(stems, "raw").select("query_id", "stream_id", F.explode(F.array("stem", "raw")).alias("term"))
    return years.union(words).distinct()


def weighted(found: DataFrame, parts: DataFrame) -> DataFrame:
    """The hits of streams, with the streams' weights."""
    return found.join(parts.select("query_id", "stream_id", "weight"), ["query_id", "stream_id"])


def rrf(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, stream_id, weight, chunk_id, rank from 1) -> (query_id, chunk_id, rrf, first)."""
    score = F.sum(F.col("weight") / (RRF_K + F.col("rank")))
    return ranked.groupBy("query_id", "chunk_id").agg(score.alias("rrf"), F.min(F.struct("stream_id", "rank")).alias("first"))


def page_rank(fused: DataFrame, meta: DataFrame, pages: int = PAGES) -> DataFrame:
    """The best boosted chunk of each page, and the first pages: (query_id, rank, page_id, score)."""
    boost = F.when(F.col("chunk_type") == "summary", SUMMARY_BOOST).otherwise(1.0)
    best = fused.join(meta.select("chunk_id", "page_id", "chunk_type"), "chunk_id").groupBy("query_id", "page_id").agg(F.round(F.max(F.col("rrf") * boost), 9).alias("score"), F.min("first").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "page_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pages).select("query_id", F.col("rank").cast("bigint").alias("rank"), "page_id", "score")


def search(queries: DataFrame, index: DataFrame, stats: DataFrame, meta: DataFrame, hits: int = HITS, pages: int = PAGES) -> DataFrame:
    """index: postings in blocks. All queries at once: (query_id, rank, page_id, score); a query without hits has no row."""
    parts = streams(queries)
    return page_rank(rrf(weighted(blocks.query(index, stats, query_terms(parts), hits), parts)), meta, pages)


def page_lists(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, page_ids): a row for each query, the list empty if nothing was found."""
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_id"))).alias("l"))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce(F.col("l.page_id"), F.array().cast("array<bigint>")).alias("page_ids"))


# ---- the earlier retriever: bigrams, repeated long tokens, a cut on frequent terms at query time, hypothetical texts


#: Fixed values.
TEMPLATES = (
    "This Wikipedia article answers the query '{query}'. It discusses the relevant facts, background, and key details.",
    "A Wikipedia page about {query} would describe the specific person, place, event, or concept involved.",
    "The answer to '{query}' can be found in a Wikipedia article covering the topic in detail.",
)


def hypothetical_texts(queries: DataFrame, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    texts = F.array(*(F.replace(F.lit(t), F.lit("{query}"), F.col("query")) for t in templates))
    return queries.select("query_id", F.posexplode(texts).alias("variant", "text"))


def early_tokens(texts: DataFrame) -> DataFrame:
    """texts (text_id, text) -> (text_id, tokens): decades spread, stems with words, pairs of neighbours, long or
    numeric tokens again."""
    spread = F.flatten(F.transform(T.raw_tokens(F.col("text")), T.decade))
    rows = texts.select("text_id", F.posexplode_outer(spread).alias("pos", "term"))
    stems = with_stem(rows.where(F.col("term").isNotNull()).select("term").distinct())
    rows = rows.join(stems, "term", "left")
    own = F.when(F.col("term") == F.col("stem"), F.array("term")).otherwise(F.array("stem", "term"))
    lists = rows.groupBy("text_id").agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("pos", "term", own.alias("own"))))).alias("l"))
    lists = lists.select("text_id", F.flatten(F.col("l.own")).alias("tokens"), F.filter(F.col("l.term"), lambda t: t.rlike("^[0-9]") | (F.length(t) > 6)).alias("again"))
    return lists.select("text_id", F.concat("tokens", T.bigrams(F.col("tokens")), "again").alias("tokens"))


def early_query(postings: DataFrame, df: DataFrame, stats: DataFrame, terms: DataFrame, k: int = HITS, most: float = 0.05) -> DataFrame:
    """As bm25.query, without the terms in more than that part of the chunks."""
    rare = bm25.vocabulary(df, stats, most).select("term")
    return bm25.query(postings.join(rare, "term", "left_semi"), terms, k)
