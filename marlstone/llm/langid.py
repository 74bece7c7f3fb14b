"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded labelled text per language (`share` characters, filled evenly from windows of up to
`docs_per_lang` training documents chosen by a hash) gives longest-match lengths. Every language of the training rows is
learned; where there are more than GROUP, their automata are probed in groups. A whole text is parsed greedily, from left
to right and across words, into the longest phrases that occur in a language's training text; a character that the
language lacks is a phrase of its own. The language with the fewest phrases per character wins; ties go to the smaller
name. (Weighting a phrase by log2 of the training length would favour languages of which only a few words are known.)

A text is cut into segments that are parsed side by side, each as if a phrase began with it. Then the parse that comes
over a segment's edge is followed until it begins a phrase where the segment's own parse begins one: from there on both
are the same, so the counts are those of one parse of the whole text.

Edge cases: a text that is null or has no letter (marks alone are none), and any text when nothing could be learned, gets
`und` with score 0; training rows with a null lang or text are ignored; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
#: Languages whose automata are probed together.
GROUP = 16
#: Characters of a segment.
SEGMENT = 1024


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased words of letters and marks, apart by single spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")


class Automaton:
    """Suffix automaton of `size` states: from[i], by[i], to[i] are the moves, by state and code."""

    def __init__(self, codes: list[int]):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in moves[at]:
                moves[at][c] = new
                at = link[at]
            if at >= 0:
                to = moves[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(moves)
                    moves.append(dict(moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and moves[at].get(c) == to:
                        moves[at][c] = twin
                        at = link[at]
                    link[to] = link[new] = twin
            last = new
        self.size = len(moves)
        many = np.fromiter(map(len, moves), np.int64, len(moves))
        self.start = np.repeat(np.arange(len(moves)), many)
        self.by = np.fromiter((c for out in moves for c in out), np.int64, many.sum())
        self.to = np.fromiter((to for out in moves for to in out.values()), np.int64, many.sum())


class Group:
    """Phrase counts of texts under some languages at once. dense: a table of moves by state and code, else sorted moves.
    A move that isn't there leads, as its complement, to the state after the character alone."""

    def __init__(self, texts: dict[str, str], dense: bool):
        self.langs = sorted(texts)
        chars = sorted(set("".join(texts.values())) | {" "})
        self.alphabet = len(chars) + 1
        self.codes = np.full(max(map(ord, chars)) + 2, len(chars), np.int32)  # the last for all that no language has
        self.codes[[ord(c) for c in chars]] = np.arange(len(chars))
        made = [Automaton(self.coded(texts[x]).tolist()) for x in self.langs]
        sizes = [m.size for m in made]
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        key = np.concatenate([(m.start + r) * self.alphabet + m.by for m, r in zip(made, self.roots, strict=True)])
        to = np.concatenate([m.to + r for m, r in zip(made, self.roots, strict=True)]).astype(np.int32)
        # by language and code: the complement of the state after the character alone
        self.alone = np.repeat(~self.roots[:, None], self.alphabet, axis=1)
        for k, (m, r) in enumerate(zip(made, self.roots, strict=True)):
            first = m.start == 0
            self.alone[k, m.by[first]] = ~(m.to[first] + r).astype(np.int32)
        self.moves = None
        if dense and sum(sizes) * self.alphabet <= 1 << 25:
            self.moves = np.concatenate([np.tile(self.alone[k], n) for k, n in enumerate(sizes)])
            self.moves[key] = to
        else:
            order = np.argsort(key)
            self.key, self.to = key[order], to[order]

    def coded(self, text: str) -> np.ndarray:
        """Codes of the characters; one code stands for all that no language has."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return self.codes[np.minimum(points, np.uint32(len(self.codes) - 1))]

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lanes, languages] states after the codes [lanes], and whether a phrase begins with them."""
        if self.moves is not None:
            to = self.moves[state * np.int32(self.alphabet) + code[:, None]]
        else:
            key = state * np.int64(self.alphabet) + code[:, None]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            to = np.where(self.key[at] == key, self.to[at], self.alone[:, code].T)
        begins = (to < 0) | (state == self.roots)
        return to ^ (to >> 31), begins

    def phrases(self, texts: list[str], segment: int = SEGMENT) -> np.ndarray:
        """[texts, languages]: phrases of each whole text."""
        flat = self.coded("".join(texts))
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        parts = -(-lens // segment)
        first = np.cumsum(parts) - parts
        nth = np.arange(parts.sum()) - np.repeat(first, parts)
        starts = np.repeat(np.cumsum(lens) - lens, parts) + nth * segment
        size = np.minimum(np.repeat(lens, parts) - nth * segment, segment)
        count = np.zeros((len(starts), len(self.langs)), np.int64)
        last = np.empty((len(starts), len(self.langs)), np.int32)
        begins = np.zeros((len(flat), len(self.langs)), bool)
        order = np.argsort(-size, kind="stable")
        at, state = starts[order], np.tile(self.roots, (len(order), 1))
        some = np.zeros(state.shape, np.int32)
        for j, n in enumerate(np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")):
            state[:n], new = self.step(state[:n], flat[at[:n] + j])
            begins[at[:n] + j] = new
            some[:n] += new
        count[order], last[order] = some, state
        for k in range(1, int(parts.max(initial=0))):
            lanes = first[parts > k] + k
            state, met = last[lanes - 1].copy(), np.zeros((len(lanes), len(self.langs)), bool)
            for j in range(segment):
                open_ = ~met & (j < size[lanes])[:, None]
                rows = np.flatnonzero(open_.any(1))
                if not len(rows):
                    break
                place = starts[lanes[rows]] + j
                state[rows], new = self.step(state[rows], flat[place])
                own = begins[place]
                count[lanes[rows]] += np.where(open_[rows], new.astype(np.int64) - own, 0)
                met[rows] |= open_[rows] & new & own
            last[lanes] = np.where(met, last[lanes], state)
        out = np.zeros((len(lens), len(self.langs)), np.int64)
        np.add.at(out, np.repeat(np.arange(len(lens)), parts), count)
        return out


class Parser:
    """Every language, in groups."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.groups = [Group({x: texts[x] for x in self.langs[at : at + GROUP]}, len(texts) <= GROUP) for at in range(0, len(self.langs), GROUP)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([g.phrases(texts) for g in self.groups], 1)

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its language of fewest phrases, their number, and that of the next language (inf if none)."""
        said, least, second, first = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf), np.full(len(texts), np.inf), 0
        for g in self.groups:
            each = g.phrases(texts)
            for k in range(len(g.langs)):
                cost = each[:, k].astype(float)
                less = cost < least
                second = np.where(less, least, np.minimum(second, cost))
                said[less], least = first + k, np.where(less, cost, least)
            first += len(g.langs)
        return said, least, second


_parsers: dict[tuple, Parser] = {}
common.keeps("langid", _parsers.clear)


def parser(texts: dict[str, str]) -> Parser:
    """Built once in each Python worker."""
    key = tuple(sorted(texts.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(texts)
    return _parsers[key]


def fill(texts: list[str], share: int) -> str:
    """At most `share` characters of whole words, as evenly from all texts as their lengths allow."""
    found, left = {}, share - 1
    for many, i in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=lambda i: len(texts[i])), strict=True):
        take = left // many - 1
        found[i] = texts[i] if len(texts[i]) <= take else texts[i][: max(take, 0) + 1].rpartition(" ")[0]
        left -= len(found[i]) + 1
    return f" {' '.join(x for _, x in sorted(found.items()) if x)} "


def training_texts(docs: DataFrame, docs_per_lang: int = 48, share: int = 32768) -> dict[str, str]:
    """Bounded sample of labelled training text for each language. A document gives a window at a place that its hash
    chooses, of twice its part of the share."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    some = known.join(F.broadcast(sizes), "lang").where(F.pmod("hash", F.lit(1 << 30)) * F.col("n") <= F.lit(2 * docs_per_lang << 30))
    size = F.ceil(F.lit(2 * share) / F.least("n", F.lit(docs_per_lang))).cast("int")
    start = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int")
    ranked = some.select("lang", "hash", F.substring("text", start + 1, size).alias("text"), (start > 0).alias("cut"))
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))).where(F.col("nth") <= docs_per_lang)
    texts: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r.nth)):
        words = letters(pa.array([r.text]))[0].as_py()
        texts.setdefault(r.lang, []).append(" ".join((words.partition(" ")[2] or words if r.cut else words).split()))
    found = {k: fill([x for x in v if x], share) for k, v in texts.items()}
    return {k: v for k, v in found.items() if v.strip()}


def predict(docs: DataFrame, texts: dict[str, str], *carry: str, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (text, *carry) -> (*carry, lang_pred, score), the last two named by `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser(texts) if texts else None
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                said, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                some = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False)))
                if parse and len(some):
                    texts_ = [f" {x.strip()} " for x in letters(part.column("text").take(pa.array(some))).to_pylist()]
                    best, least, second = parse.best(texts_)
                    said[some], score[some] = best, 1 - least / np.where(second > 0, second, 1)
                names = pa.array([parse.langs[k] if k >= 0 else UNKNOWN for k in said] if parse else [UNKNOWN] * part.num_rows, pa.string())
                score = np.nan_to_num(score)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), names, pa.array(score, pa.float64())], [*carry, *out])

    schema = T.StructType([*docs.select(*carry).schema, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    needed = [*carry, *(() if "text" in carry else ("text",))]
    return docs.select(*needed).mapInArrow(common.tidy(run, "langid"), schema)


def training_rows(docs: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    return docs.where(common.remainder(F.col("doc_id"), modulus) != held).select("doc_id", "lang", "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    texts = training_texts(training_rows(docs))
    return predict(docs.select("doc_id", "text", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out")), texts, "doc_id", "held_out")
