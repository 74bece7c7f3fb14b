"""Search for questions that are known before the texts are read.

Texts are counted for the questions' terms alone, in the stage that deals them by ranges of ids. A row holds all postings of these
terms in some `WIDTH` chunks, each of them whole, so rows are scored where they are, in any order: nothing but counts and
the best of each task is shuffled, and no text, no chunk and no other term is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import FEW, stage
from . import blocks, bm25
from .chunk import with_ids

WIDTH = bm25.WIDTH  # at most 2^16, since places are of 16 bits
ROW = "block long, tokens long, at array<int>, page_id array<long>, chunk_type array<string>, dl array<int>, term array<int>, n array<int>, places binary, counts binary"
HIT = "nth long, place long, page_id long, chunk_type string, score double"


def counts(chunks: DataFrame, terms: list[str], width: int = WIDTH) -> DataFrame:
    """chunks (chunk_id, page_id, chunk_type, text) -> a row for some chunks of a range: all of them (at: places; dl: lengths), the
    terms that they hold (by their numbers), how many of them hold each, and these by term and place, with the counts there."""
    wanted = chunks.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, block, held, texts in bm25.gathered(batches, width, wanted.value):
            at, page, kind = map(list, zip(*held, strict=True))
            term, place, tf, lengths = bm25.counted(known, at, texts, width, True)
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            row = [block, int(lengths.sum()), at, page, kind, lengths[at].tolist(), term[starts].tolist(), np.diff(starts, append=len(term)).tolist(), place.astype("<u2").tobytes(), tf.astype("<i4").tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in ROW.split(", ")])

    return bm25.lowered(chunks, "page_id", "chunk_type").mapInArrow(of, ROW)


def best(rows: DataFrame, streams: list[tuple[int, list[int]]], idf: list[float], avgdl: float, k: int, width: int = WIDTH) -> DataFrame:
    """Streams (nth, numbers of terms) -> HIT: the best k that each task finds for each. The k-th best so far is what a range must
    reach, as in `blocks`."""
    asked = rows.sparkSession.sparkContext.broadcast(([(nth, np.array(own)) for nth, own in streams], np.array(idf)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, idf = asked.value
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0), np.empty(0, np.int64), np.empty(0, object), np.empty(0, object))] * len(streams)
        least, sums, lengths = [0.0] * len(streams), np.zeros(width), np.zeros(width, np.int64)
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                if not row["term"]:
                    continue
                first, term, ends = row["block"] * width, np.array(row["term"]), np.append(0, np.cumsum(row["n"]))
                at, tf = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["counts"], "<i4")
                lengths[row["at"]] = row["dl"]
                weight = bm25.saturated(np.repeat(idf[term], row["n"]), tf, lengths[at], avgdl)
                most = np.maximum.reduceat(weight, ends[:-1])
                page, kind = np.full(width, None, object), np.full(width, None, object)
                page[row["at"]], kind[row["at"]] = row["page_id"], row["chunk_type"]
                where = np.full(len(idf), -1)
                where[term] = np.arange(len(term))
                for i, (_, own) in enumerate(streams):
                    own = where[own]
                    own = own[own >= 0]
                    if not len(own):
                        continue
                    hit, score, _ = blocks.scores(own[np.argsort(-most[own], kind="stable")], most, least[i], ends, at, weight, sums)
                    if not len(hit):
                        continue
                    both = [np.concatenate(x) for x in zip(found[i], (score, first + hit, page[hit], kind[hit]), strict=True)]
                    if len(both[0]) >= k:
                        order = np.lexsort((both[1], -both[0]))[:k]
                        both = [x[order] for x in both]
                        least[i] = both[0][-1] - blocks.ROOM
                    found[i] = tuple(both)
        for (nth, _), (score, place, page, kind) in zip(streams, found, strict=True):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), nth)), pa.array(place), pa.array(page, pa.int64()), pa.array(kind, pa.string()), pa.array(score)], ["nth", "place", "page_id", "chunk_type", "score"])

    return rows.select("block", "at", "page_id", "chunk_type", "dl", "term", "n", "places", "counts").mapInArrow(of, HIT)


def few(terms: DataFrame, most: int = FEW) -> bool:
    """Whether the streams' terms can go to every task."""
    return terms.count() <= most


def search(chunks: DataFrame, terms: DataFrame, k: int = 200, width: int = WIDTH) -> DataFrame:
    """chunks as `chunk.placed` gives them; terms (query_id, stream_id, term), staged and few -> what `blocks.query` finds in the
    index of the chunks with ids, and their pages: (query_id, stream_id, chunk_id, page_id, chunk_type, score, rank)."""
    asked = stage(terms.select(*blocks.GROUP, "term").distinct(), "scan-asked")
    streams = stage(asked.select(*blocks.GROUP).distinct().withColumn("nth", F.monotonically_increasing_id()), "scan-streams")
    names = sorted(r.term for r in asked.select("term").distinct().collect())
    rows = stage(counts(chunks.withColumnRenamed("place", "chunk_id"), names, width), "scan-counts")
    n = F.coalesce(F.sum(F.size("at")), F.lit(0))
    stats = stage(rows.agg(n.alias("n"), (F.coalesce(F.sum("tokens"), F.lit(0)) / F.greatest(n, F.lit(1))).alias("avgdl")), "scan-stats")
    df = rows.select(F.explode(F.arrays_zip("term", "n")).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("df"))
    facts = bm25.vocabulary(df, stats).crossJoin(F.broadcast(stats.select("n"))).select("term", bm25.idf(F.col("df"), F.col("n")).alias("idf"))
    idf = {r.term: r.idf for r in facts.collect()}
    number = {names[i]: i for i in idf}
    own: dict[int, list[int]] = {}
    for r in asked.join(streams, blocks.GROUP).select("nth", "term").collect():
        if r.term in number:
            own.setdefault(r.nth, []).append(number[r.term])
    hits = best(rows, sorted(own.items()), [idf.get(i, 0.0) for i in range(len(names))], stats.first().avgdl, k, width)
    totals = rows.groupBy(F.shiftright(F.col("block") * width, 33).alias("range")).agg(F.sum(F.size("at")).alias("total"))
    found = bm25.top(with_ids(hits, totals), k, "nth").join(streams, "nth")
    return stage(found.select(*blocks.GROUP, "chunk_id", "page_id", "chunk_type", "score", "rank"), "scan-found")
