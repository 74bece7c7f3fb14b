"""Pages to chunks: a summary, and overlapping windows of the whole content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import clean_pages
from ..sources.stage import stage

WINDOW, STRIDE, LEAST = 200, 150, 20
SUMMARY_SENTENCES, SUMMARY_CHARS = 2, 300


def chunk_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, title, content[, file]) -> (page_id, pos, chunk_type, text[, file])."""
    file = [c for c in pages.columns if c == "file"]
    sents, words = T.sentences(F.col("content"), SUMMARY_SENTENCES), T.space_tokens(F.col("content"))
    head = F.concat("title", F.lit(". "))
    first = F.when(F.size("sents") > 0, F.array_join("sents", " ")).otherwise(F.substring("content", 1, SUMMARY_CHARS))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    windows = F.filter(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(WINDOW))), lambda w: F.size(w) >= LEAST)
    summary = F.struct(F.lit("summary").alias("chunk_type"), F.concat(head, first).alias("text"))
    bodies = F.transform(windows, lambda w: F.struct(F.lit("body").alias("chunk_type"), F.concat(head, F.array_join(w, " ")).alias("text")))
    parts = pages.select("page_id", "title", "content", sents.alias("sents"), words.alias("words"), *file)
    return parts.select("page_id", *file, F.posexplode(F.concat(F.array(summary), bodies)).alias("pos", "c")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "c.chunk_type", "c.text", *file)


def placed(pages: DataFrame) -> DataFrame:
    """(place, page_id, chunk_type, text), with places that rise by the page's file if pages has it, then page, then place in it.
    Pages are dealt by ranges of their files or ids, however these are spread, and then cleaned."""
    pages = pages.withColumn("page_id", F.col("page_id").cast("bigint"))
    by = [F.col(c).asc_nulls_last() for c in ("file", "page_id") if c in pages.columns]
    chunks = chunk_pages(clean_pages(pages.repartitionByRange(*by).sortWithinPartitions(*by)))
    return chunks.select(F.monotonically_increasing_id().alias("place"), "page_id", "chunk_type", "text")


def with_ids(rows: DataFrame, totals: DataFrame, start: int = 0) -> DataFrame:
    """rows (place, more) -> (chunk_id, more): dense ids from `start`. totals (range, total): how many places each range of
    them has. What a range starts from is a row for each."""
    bases = stage(totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total") + start).alias("base")), "chunk-bases")
    nth = F.col("place") - F.shiftleft("range", 33)
    with_range = rows.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(bases), "range")
    return with_range.select((F.col("base") + nth).cast("bigint").alias("chunk_id"), *(c for c in rows.columns if c != "place"))


def chunk_corpus(pages: DataFrame, start: int = 0) -> DataFrame:
    """(chunk_id, page_id, chunk_type, text): dense ids from `start`, in the order of `placed`. The chunks are written once, with
    places within a range."""
    chunks = stage(placed(pages), "chunks")
    return with_ids(chunks, chunks.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("total")), start)
