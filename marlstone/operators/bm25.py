"""BM25: counts of terms in blocks of chunks, and what follows from them."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem, with_stem
from ..sources.stage import few, stage

K1, B, MOST_DF = 1.5, 0.75, 0.5
WIDTH, HELD = 1024, 1 << 21  # chunk ids of a block; words that a task gathers before it counts them, but for the last text
STEMS = 1 << 18  # words that a task remembers from block to block
APART = bytes(b if chr(b).isascii() and (chr(b).isdigit() or chr(b).islower()) else 32 for b in range(256))  # in UTF-8, all other letters are of bytes over 127
DIGITS = 6  # scores are rounded before they are ranked, so that the order of a sum doesn't decide ties


def stem_table(raw: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms of raw (term)."""
    return with_stem(raw.select("term").distinct())


class Words(dict[bytes, int]):
    """Words and their numbers, in the order in which they were met, with the numbers of their stems, and those that terms have
    in `wanted` (-1 for others)."""

    def __init__(self, wanted: dict[str, int] | None = None) -> None:
        self.names: list[str] = []
        self.roots: list[int] = []
        self.wanted, self.asked = wanted or {}, []

    def __missing__(self, word: bytes) -> int:
        name = word.decode()
        at = self[word] = len(self.names)
        self.names.append(name)
        self.roots.append(at)
        self.asked.append(self.wanted.get(name, -1))
        root = stem(name)
        if root != name:
            self.roots[at] = self[root.encode()]
        return at


def gathered(batches: Iterable[pa.RecordBatch], width: int, wanted: dict[str, int] | None = None) -> Iterator[tuple[Words, int, list[tuple], list[np.ndarray]]]:
    """A task's chunks (chunk_id, lower-case text as bytes, more) -> (words, block, [(place, *more)], the numbers of each text's
    words), whenever a range of ids ends or enough is held."""
    known, block, size = Words(wanted), None, 0
    held: list[tuple] = []
    texts: list[np.ndarray] = []
    for batch in batches:
        more = [c for c in batch.schema.names if c not in ("chunk_id", "text")]
        for chunk, text, *rest in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "text", *more)), strict=True):
            if chunk // width != block or size > HELD:
                if held:
                    yield known, block, held, texts
                block, size, held, texts = chunk // width, 0, [], []
                known = known if len(known) < STEMS else Words(wanted)
            words = (text or b"").translate(APART).split()
            held.append((chunk - block * width, *rest))
            texts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            size += len(words)
    if held:
        yield known, block, held, texts


def counted(known: Words, places: list[int], texts: list[np.ndarray], width: int, wanted: bool = False) -> tuple[np.ndarray, ...]:
    """(term, place, count) of each text's terms, by terms and places; texts' lengths by place. If wanted, terms are those that
    are, by their numbers there."""
    word, place = np.concatenate(texts), np.repeat(np.array(places, np.int64), [len(t) for t in texts])
    root = np.array(known.roots, np.int32)[word]
    other = root != word
    word, place = np.concatenate([word, root[other]]), np.concatenate([place, place[other]])
    lengths = np.bincount(place, minlength=width)
    if wanted:
        word = np.array(known.asked, np.int32)[word]
        word, place = word[word >= 0], place[word >= 0]
    key, tf = np.unique(word.astype(np.int64) * width + place, return_counts=True)
    return *np.divmod(key, width), tf, lengths


def lowered(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").cast("binary").alias("text"), *more)


def term_counts(chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """chunks (chunk_id, text) -> (term, block, n, total, at, tf, dl): the places of a term's chunks in a range of ids, its counts
    there and the chunks' lengths; how many there are, and the sum of the counts. Stems, and words that differ from their stem,
    are counted together. Texts are read where they are: nothing is shuffled. A block is whole if its chunks come one after
    another; otherwise it is several rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, block, held, texts in gathered(batches, width):
            term, at, tf, lengths = counted(known, [place for (place,) in held], texts, width)
            if not len(term):
                continue
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            bounds = pa.array(np.append(starts, len(term)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (at, tf, lengths[at])]
            columns = [pa.array([known.names[i] for i in term[starts].tolist()], pa.string()), *map(pa.array, (np.full(len(starts), block), np.diff(starts, append=len(term)), np.add.reduceat(tf, starts))), *listed]
            whole = pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "total", "at", "tf", "dl"])
            for i in range(0, len(whole), 1 << 14):
                yield whole.slice(i, 1 << 14)

    return lowered(chunks).mapInArrow(of, "term string, block long, n long, total long, at array<int>, tf array<int>, dl array<int>")


def spread(blocks: DataFrame, *more: str, width: int = WIDTH) -> DataFrame:
    """(*more, chunk_id, tf, dl), a row for each posting."""
    each = blocks.select(*more, "block", F.explode(F.arrays_zip("at", "tf", "dl")).alias("p"))
    return each.select(*more, (F.col("block") * width + F.col("p.at")).alias("chunk_id"), F.col("p.tf").cast("bigint").alias("tf"), F.col("p.dl").cast("bigint").alias("dl"))


def doc_freq(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("n").alias("df"))


def doc_len(counts: DataFrame) -> DataFrame:
    return spread(counts).groupBy("chunk_id").agg(F.max("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """One row (n, avgdl) over all chunks, those without tokens included."""
    n = chunks.agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return n.crossJoin(total).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))  # two rows of one


def vocabulary(df: DataFrame, stats: DataFrame, most: float = MOST_DF) -> DataFrame:
    """(term, df) of the terms in at most that part of the chunks."""
    return df.crossJoin(F.broadcast(stats)).where(F.col("df") <= F.floor(F.col("n") * F.lit(most))).select("term", "df")


def term_ids(vocab: DataFrame) -> DataFrame:
    """(term, term_id, df): lexicographic ids, numbered within and over first letters."""
    rows = vocab.withColumn("letter", F.substring("term", 1, 2))
    totals = rows.groupBy("letter").agg(F.count("*").alias("m"))
    bases = totals.select("letter", (F.sum("m").over(Window.orderBy("letter")) - F.col("m")).alias("base"))  # 1,332 rows at most
    nth = F.row_number().over(Window.partitionBy("letter").orderBy("term")) - 1
    return rows.withColumn("nth", nth).join(F.broadcast(bases), "letter").select("term", (F.col("base") + F.col("nth")).cast("bigint").alias("term_id"), "df")


def idf(df, n):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def saturated(idf, tf, dl, avgdl):
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weight(tf, df, dl, n, avgdl):
    return saturated(idf(df, n), tf, dl, avgdl)


@dataclasses.dataclass
class Index:
    counts: DataFrame  # in blocks
    stats: DataFrame
    most_df: float = MOST_DF

    @functools.cached_property
    def df(self) -> DataFrame:
        return stage(doc_freq(self.counts), "bm25-df")

    @property
    def tf(self) -> DataFrame:
        return spread(self.counts, "term")

    @property
    def dl(self) -> DataFrame:
        return doc_len(self.counts)

    @property
    def vocabulary(self) -> DataFrame:
        return vocabulary(self.df, self.stats, self.most_df)

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, block, df, n, most, at, tf, dl) of the vocabulary, or of those of its terms that are in terms (term); only
        these are counted then, and the blocks stay where they are if the terms are few."""
        c = F.col
        part = F.array_max(F.transform(F.arrays_zip("tf", "dl"), lambda p: saturated(F.lit(1.0), p["tf"], p["dl"], c("avgdl"))))
        if terms is None:
            vocab = self.vocabulary
        else:
            df = doc_freq(self.counts.join(few(stage(terms.select("term").distinct(), "bm25-terms")), "term", "left_semi"))
            vocab = few(stage(vocabulary(df, self.stats, self.most_df), "bm25-asked"))
        rows = self.counts.join(vocab, "term").crossJoin(F.broadcast(self.stats.select(c("n").alias("chunks"), "avgdl")))
        return rows.select("term", "block", "df", "n", (idf(c("df"), c("chunks")) * part).alias("most"), "at", "tf", "dl")

    @property
    def rows(self) -> DataFrame:
        """Postings with what their weights follow from."""
        c = F.col
        rows = spread(self.blocks(), "term", "df").crossJoin(F.broadcast(self.stats))
        return rows.select("term", "chunk_id", "tf", "df", "dl", weight(c("tf"), c("df"), c("dl"), c("n"), c("avgdl")).alias("score"))

    @property
    def postings(self) -> DataFrame:
        return self.rows.select("term", "chunk_id", "score")


def build(chunks: DataFrame, most_df: float = MOST_DF) -> Index:
    """Index of chunks (chunk_id, text). All parts follow from the counts, so these are written once to the shared folder."""
    counts = stage(term_counts(chunks), "bm25-counts")
    return Index(counts, stage(corpus_stats(chunks, counts), "bm25-stats"), most_df)


def csr_offsets(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """(term_id, n, first): where each term's postings would start in one array."""
    return offsets(postings.groupBy("term").agg(F.count("*").alias("n")), ids)


def offsets(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """counts (term, n) -> (term_id, n, first): running sums within ranges of ids, and over the ranges."""
    n = counts.join(ids, "term")
    bucket = F.floor(F.col("term_id") / 4096)
    n = n.withColumn("bucket", bucket).withColumn("inner", F.sum("n").over(Window.partitionBy("bucket").orderBy("term_id")) - F.col("n"))
    totals = n.groupBy("bucket").agg(F.sum("n").alias("total"))
    bases = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("base"))
    return n.join(bases, "bucket").select("term_id", "n", (F.col("base") + F.col("inner")).alias("first"))


def top(hits: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query(postings: DataFrame, terms: DataFrame, k: int = 200) -> DataFrame:
    """terms (query_id, stream_id, term) -> (query_id, stream_id, chunk_id, score, rank). Terms count once."""
    group = ["query_id", "stream_id"]
    hits = postings.join(terms.select(*group, "term").distinct(), "term").groupBy(*group, "chunk_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return top(hits.where(F.col("score") > 0), k, *group)
