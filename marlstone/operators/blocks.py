"""Postings in blocks, and search that leaves many of them unread.

A block is one row: a term's postings in a range of `WIDTH` chunk ids. It holds what their weights follow from (places in the
range, counts, chunk lengths: small integers, which Parquet packs into a few bits each), how many they are, and the highest
weight among them. Ranges are the same for all terms, so the blocks of a stream's terms in a range, dealt to one task, give
whole scores there: only the best of each range are shuffled, never a row for each posting or chunk.

A search of the best k scores twice. First, for each stream, some ranges where its terms have their highest weights: the k-th
best score there is a threshold that the result reaches. Then all ranges: one whose blocks' highest weights add up to less is
left out; in another, terms are added by falling highest weight, and once no chunk's sum can reach the threshold with what is
left the rest is left out. The result is that of `bm25.query`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import FEW, stage
from . import bm25

#: Chunk ids of a range; chunks of the first scoring for each of the k; keys (a stream's term) that meet a range in one group.
WIDTH, FIRST, KEYS = bm25.WIDTH, 16, 1 << 19
#: Bounds are compared with room for how sums are rounded before they are ranked.
ROOM = 10.0**-bm25.DIGITS
GROUP = ["query_id", "stream_id"]


def blocked(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows (term, chunk_id, tf, df, dl, score) -> (term, block, df, n, most, at, tf, dl), by ranges of terms and blocks: one
    shuffle both deals out the ranges and brings a block's postings together."""
    placed = rows.withColumn("block", F.floor(F.col("chunk_id") / width)).repartitionByRange("term", "block")
    each = F.array_sort(F.collect_list(F.struct((F.col("chunk_id") - F.col("block") * width).cast("int").alias("at"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))))
    held = placed.groupBy("term", "block").agg(F.first("df").alias("df"), F.count("*").alias("n"), F.max("score").alias("most"), each.alias("p"))
    return held.select("term", "block", "df", "n", "most", "p.at", "p.tf", "p.dl").sortWithinPartitions("term", "block")


def postings(blocks: DataFrame, stats: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks, with whatever other columns they have -> these and (chunk_id, score), a row for each posting."""
    more = [c for c in blocks.columns if c not in ("df", "n", "most", "at", "tf", "dl")]
    facts = F.broadcast(stats.select(F.col("n").alias("chunks"), "avgdl"))
    each = blocks.crossJoin(facts).select(*more, "avgdl", bm25.idf(F.col("df"), F.col("chunks")).alias("idf"), F.explode(F.arrays_zip("at", "tf", "dl")).alias("p"))
    return each.select(*more, (F.col("block") * width + F.col("p.at")).alias("chunk_id"), bm25.saturated(F.col("idf"), F.col("p.tf"), F.col("p.dl"), F.col("avgdl")).alias("score"))


def csr_offsets(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """As bm25.csr_offsets, from the blocks' counts alone."""
    return bm25.offsets(blocks.groupBy("term").agg(F.sum("n").alias("n")), ids)


def scores(own: np.ndarray, most: np.ndarray, least: float, ends: np.ndarray, at: np.ndarray, weight: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A stream's terms in a range, by falling highest weight -> (places of at least that score, their scores, how many postings
    were read); sums is room for a score for each place."""
    left, read = most[own][::-1].cumsum()[::-1].tolist(), 0  # the most that each term and those after it can add
    if left[0] >= least:
        sums[:] = 0
        for r, more in zip(own.tolist(), left, strict=True):
            if more < least and sums.max() + more < least:
                break
            i, j = ends[r], ends[r + 1]
            sums[at[i:j]] += weight[i:j]
            read += j - i
        else:
            hit = np.flatnonzero(sums >= max(least, 1e-300))
            return hit, np.round(sums[hit], bm25.DIGITS), read
    return np.empty(0, np.int64), np.empty(0), read


def _range(group: pa.Table, k: int, width: int, count: bool) -> pa.Table:
    """The blocks of one range, each with the streams that ask for its term -> the best k of each stream (or, if count, how many
    postings each reads)."""
    at, tf, dl, most, idf = (group[c].combine_chunks() for c in ("at", "tf", "dl", "most", "idf"))
    ends = np.asarray(at.offsets).astype(np.int64)
    at, tf, dl = (np.asarray(x.values) for x in (at, tf, dl))
    most = np.asarray(most)
    weight = bm25.saturated(np.repeat(np.asarray(idf), np.diff(ends)), tf, dl, group["avgdl"][0].as_py())
    streams = group["streams"].combine_chunks()
    row = np.repeat(np.arange(len(most)), np.diff(np.asarray(streams.offsets)))
    nth, theta = (np.asarray(streams.values.field(c)) for c in ("nth", "theta"))
    order = np.lexsort((-most[row], nth))
    row, nth, theta = row[order], nth[order], theta[order]
    cuts = np.flatnonzero(np.diff(nth) != 0) + 1
    first = group["block"][0].as_py() * width
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sums = np.zeros(width)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
        hit, score, read = scores(row[a:b], most, theta[a], ends, at, weight, sums)
        if len(hit) > k:
            best = np.argsort(-score, kind="stable")[:k]  # places rise, so that ties stay with the smaller
            hit, score = hit[best], score[best]
        if not count:
            out.append((np.full(len(hit), nth[a]), first + hit, score))
        if count:
            out.append((nth[a : a + 1], np.array([read], np.int64), np.zeros(1)))
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
    return pa.table(dict(zip(["nth", "chunk_id", "score"], found, strict=True)))


def _scored(blocks: DataFrame, stats: DataFrame, keys: DataFrame, on: list[str], tiles: int, k: int, width: int, count: bool = False, few: bool = False) -> DataFrame:
    """keys (nth, term, theta, and block where `on` has it) -> (nth, chunk_id, score), the best k of each range. If keys are few
    only the blocks that they meet are shuffled, once."""
    tile = F.pmod(F.xxhash64("nth"), F.lit(tiles)).cast("int").alias("tile")
    asking = keys.select(*on, tile, F.struct("nth", "theta").alias("stream")).groupBy(*on, "tile").agg(F.collect_list("stream").alias("streams"))
    asking = F.broadcast(asking) if few else asking
    facts = F.broadcast(stats.select(F.col("n").alias("chunks"), "avgdl"))
    rows = blocks.join(asking, on).crossJoin(facts).select("block", "tile", "at", "tf", "dl", "most", bm25.idf(F.col("df"), F.col("chunks")).alias("idf"), "avgdl", "streams")
    return rows.groupBy("block", "tile").applyInArrow(lambda group: _range(group, k, width, count), "nth long, chunk_id long, score double")


def asked(blocks: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms (*GROUP, term) -> staged: (*GROUP, nth), a number for each stream whatever its ids are; (nth, term, most, best), its
    distinct terms with the term's highest weight and the range that has it."""
    terms = stage(terms.select(*GROUP, "term").distinct(), "search-asked")  # a query's terms take a long chain of columns to find
    streams = stage(terms.select(*GROUP).distinct().withColumn("nth", F.monotonically_increasing_id()), "search-streams")
    facts = blocks.groupBy("term").agg(F.max("most").alias("most"), F.max_by("block", "most").alias("best"))
    rows = terms.join(streams, GROUP).select("nth", "term")
    return streams, stage(rows.join(facts, "term").select("nth", "term", "most", "best"), "search-terms")


def _first(k: int, width: int) -> int:
    """Ranges of a stream's first scoring."""
    return max(1, -(-FIRST * k // width))


def thresholds(blocks: DataFrame, stats: DataFrame, keys: DataFrame, tiles: int, k: int, width: int, few: bool = False) -> DataFrame:
    """(nth, theta): the k-th best score in the ranges where the stream's terms have their highest weights, of some `FIRST`
    times k chunks; streams with fewer than k chunks there have none."""
    best = keys.groupBy("nth", F.col("best").alias("block")).agg(F.max("most").alias("most"))
    place = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("most"), "block"))
    first = best.withColumn("place", place).where(F.col("place") <= _first(k, width)).select("nth", "block")
    hits = _scored(blocks, stats, keys.join(first, "nth").withColumn("theta", F.lit(0.0)), ["term", "block"], tiles, k, width, few=few)
    return bm25.top(hits, k, "nth").where(F.col("rank") == k).select("nth", (F.col("score") - ROOM).alias("theta"))


def _prepared(blocks: DataFrame, stats: DataFrame, terms: DataFrame, k: int, width: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """(streams, staged keys (nth, term, theta), how many tiles they are dealt to, whether they are few)"""
    streams, keys = asked(blocks, terms)
    n = keys.count()
    tiles, few = max(1, -(-n // KEYS)), n * _first(k, width) <= 4 * FEW  # the first scoring asks for a key in each of these ranges
    theta = thresholds(blocks, stats, keys, tiles, k, width, few)
    return streams, stage(keys.join(theta, "nth", "left").select("nth", "term", F.coalesce("theta", F.lit(0.0)).alias("theta")), "search-keys"), tiles, few


def query(blocks: DataFrame, stats: DataFrame, terms: DataFrame, k: int = 200, width: int = WIDTH) -> DataFrame:
    """blocks: stored or staged, for they are read several times; terms (query_id, stream_id, term). As bm25.query."""
    streams, keys, tiles, few = _prepared(blocks, stats, terms, k, width)
    best = bm25.top(_scored(blocks, stats, keys, ["term"], tiles, k, width, few=few), k, "nth")
    return best.join(streams, "nth").select(*GROUP, "chunk_id", "score", "rank")


def read(blocks: DataFrame, stats: DataFrame, terms: DataFrame, k: int = 200, width: int = WIDTH) -> tuple[int, int]:
    """Postings that the second scoring reads for all streams, and those of the streams' terms altogether."""
    _, keys, tiles, few = _prepared(blocks, stats, terms, k, width)
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    return total(_scored(blocks, stats, keys, ["term"], tiles, k, width, True, few), "chunk_id"), total(blocks.select("term", "n").join(keys, "term"), "n")
