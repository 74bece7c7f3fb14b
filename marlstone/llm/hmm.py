"""Hidden Markov language model over whole texts.

A token's emission probability factors through a class g of the token:
P(w | z) = B[z, g(w)] * (c(w) + 1) / (S_g + 1), where c are corpus counts over the training texts, S_g sums
c + 1 over the known words of the class, and the + 1 leaves room for one unknown word per class. The most
frequent words have a class of their own; every other word falls into a class by its first two and last three
characters. States start from counts of successive frequent words over all training texts, whose singular vectors are
clustered. Then every round of Baum-Welch computes expected counts per partition over all whole training texts, and Spark
sums them. The score is the exact log10 likelihood of the token sequence by the scaled forward recursion.

Long texts are cut into segments: a segment's product of transition and emission matrices takes a forward vector over it
in one step (and a backward vector back), so segments run side by side and memory doesn't grow with a text. The result is
that of one run over the whole text.

Edge cases: a null text is empty and holds only the end token; an empty table gives an empty result; without any
training text every count is 0 and the model is uniform over classes; repeated rows are scored one by one; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = 0


@dataclasses.dataclass(frozen=True)
class Settings:
    """own: words with a class of their own at most; affixes: classes of the others; head: words whose counts are
    broadcast at most (each of 256 bytes at most, the rest are joined); near: most frequent words whose successions the
    states start from; rounds: Baum-Welch passes over all training texts; segment: tokens."""

    states: int = 8
    own: int = 4096
    affixes: int = 4096
    head: int = 1 << 18
    near: int = 255
    rounds: int = 3
    segment: int = 2048
    block: int = 250_000
    gather: int = 1_500_000
    seed: int = 7

    @property
    def classes(self) -> int:
        return 1 + self.own + self.affixes


def classes_of(words: pa.Array, head: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word, and its place in the head (-1: not there)."""
    at = np.asarray(pc.fill_null(pc.index_in(words, value_set=head), -1)).astype(np.int64)
    key = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, 2), pc.utf8_slice_codeunits(words, -3), "|").dictionary_encode()
    bucket = np.array([zlib.crc32(k.encode()) % s.affixes for k in key.dictionary.to_pylist()] or [0], np.int64)
    affix = 1 + s.own + bucket[np.asarray(key.indices)]
    return np.where((at >= 0) & (at < s.own), 1 + at, affix), at


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over whole texts; the null token is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 24 << 20):
                _, index, words = common.words_of(part.column("text"))
                n = np.bincount(index, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.append(n, part.num_rows), pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(common.tidy(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclasses.dataclass
class Vocabulary:
    total: int
    distinct: int
    head: pa.Array  # by falling count
    head_counts: np.ndarray
    end_count: int
    class_sums: np.ndarray


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """What the driver needs of the counts: totals, the bounded head, a sum for each class."""
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = counts.groupBy(F.col("token").isNull().alias("end"), step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in steps), sum(r.n for r in steps)
    end_count = sum(r.c for r in steps if r.end)
    held, least = 0, None
    for r in sorted((r for r in steps if not r.end), key=lambda r: -r.step):
        held += r.n
        if held > s.head:
            break
        least = r.step
    top = counts.where(F.col("token").isNotNull() & (step >= F.lit(least if least is not None else 1 << 30)) & (F.octet_length("token") <= 256)).select("token", "c").toArrow()
    top = top.sort_by([("c", "descending"), ("token", "ascending")])
    head = pa.concat_arrays([c.cast(pa.string()) for c in top["token"].chunks]) if top.num_rows else pa.array([], pa.string())

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words = np.zeros(s.classes), shared.value
        for batch in batches:
            token = batch.column("token")
            known = token.is_valid()
            c = np.asarray(batch.column("c").filter(known)) + 1
            g, _ = classes_of(token.filter(known).cast(pa.string()), words, s)
            sums += np.bincount(g, weights=c, minlength=s.classes)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].astype(np.int64), pa.int64())], ["g", "n"])

    shared = counts.sparkSession.sparkContext.broadcast(head)
    sums = np.zeros(s.classes)
    for r in counts.mapInArrow(by_class, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        sums[r.g] = r.n
    sums[END] = end_count + 1 if end_count else 0
    shared.unpersist()
    return Vocabulary(total, distinct, head, np.asarray(top["c"]).astype(np.int64), end_count, sums)


@dataclasses.dataclass
class Model:
    start: np.ndarray  # [states]
    move: np.ndarray  # [states, states]
    emit: np.ndarray  # [classes, states]


class Block:
    """Segments by falling length side by side: position t of all of them is one run, so a step is one small product.

    prior: of a segment's first state; before: forward vector of the text's segment before (0 if there is none); tail: what
    follows, as a backward vector of any length."""

    def __init__(self, codes: list[np.ndarray], prior: np.ndarray, before: np.ndarray, tail: np.ndarray):
        lens = np.array([len(c) for c in codes])
        self.prior, self.before, self.tail, self.n = prior, before, tail, len(codes)
        self.active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # lens fall
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(len(codes)), lens)
        t = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        self.codes = np.empty(lens.sum(), np.int32)
        self.codes[self.start[t] + doc] = np.concatenate(codes)

    def likelihood(self, m: Model) -> np.ndarray:
        """Natural log of each segment's likelihood from its prior."""
        like, a = np.zeros(self.n), self.prior
        for t, n in enumerate(self.active):
            a = m.emit[self.codes[self.start[t] : self.start[t] + n]] * (a[:n] @ m.move if t else a[:n])
            c = a.sum(1)
            a /= c[:, None]
            like[:n] += np.log(c)
        return like

    def expect(self, m: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Add the expected counts of one Baum-Welch step."""
        e = m.emit[self.codes]
        alpha, scale, a = np.empty_like(e), np.empty(len(e)), self.prior
        for t, n in enumerate(self.active):
            at = slice(self.start[t], self.start[t] + n)
            a = e[at] * (a[:n] @ m.move if t else a[:n])
            c = a.sum(1)
            a /= c[:, None]
            alpha[at], scale[at] = a, c
        pairs, beta = np.zeros_like(m.move), None
        for t in range(len(self.active) - 1, -1, -1):
            n, at = self.active[t], slice(self.start[t], self.start[t + 1])
            k = 0 if beta is None else len(beta)
            now = np.empty((n, m.move.shape[0]))
            if k:
                ahead = slice(self.start[t + 1], self.start[t + 1] + k)
                later = e[ahead] * beta / scale[ahead][:, None]
                pairs += alpha[at][:k].T @ later
                now[:k] = later @ m.move.T
            if k < n:  # the last position of these segments
                now[k:] = self.tail[k:n] / (alpha[at][k:] * self.tail[k:n]).sum(1, keepdims=True)
            beta = now
            if t == 0:
                start += (alpha[at] * beta)[~self.before.any(1)].sum(0)
                pairs += self.before.T @ (e[at] * beta / scale[at][:, None])
            alpha[at] *= beta
        move += pairs * m.move
        for z in range(emit.shape[1]):
            emit[:, z] += np.bincount(self.codes, weights=alpha[:, z], minlength=len(emit))


def transfers(codes: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """[segments, states, states]: from each first state to each last one, and the log of the factor taken out."""
    k = len(m.start)
    order = np.argsort([-len(c) for c in codes], kind="stable")
    lens = np.array([len(codes[i]) for i in order])
    made, logs = np.empty((len(codes), k, k)), np.zeros(len(codes))
    grid = np.zeros((len(codes), lens[0]), np.int32)
    for row, i in enumerate(order):
        grid[row, : lens[row]] = codes[i]
    for t, n in enumerate(np.searchsorted(-lens, -np.arange(lens[0]), side="left")):
        e = m.emit[grid[:n, t]]
        made[:n] = np.eye(k)[None] * e[:, None, :] if t == 0 else (made[:n].reshape(-1, k) @ m.move).reshape(n, k, k) * e[:, None, :]
        c = made[:n].sum((1, 2))
        made[:n] /= c[:, None, None]
        logs[:n] += np.log(c)
    back = np.argsort(order, kind="stable")
    return made[back], logs[back]


def chained(texts: list[np.ndarray], m: Model, size: int, lanes: int = 1024) -> list[tuple]:
    """Of each long text its segments with prior, before and tail of each, and the log of its likelihood. The segments of
    all texts go side by side, so that a step has many of them."""
    cuts = [[text[at : at + size] for at in range(0, len(text), size)] for text in texts]
    flat = [c for cut in cuts for c in cut]
    parts = [transfers(flat[at : at + lanes], m) for at in range(0, len(flat), lanes)]
    made, logs = (np.concatenate([x[i] for x in parts]) if parts else np.empty(0) for i in range(2))
    first = np.cumsum([0, *map(len, cuts)])
    return [chain(cut, made[a : a + len(cut)], logs[a : a + len(cut)], m) for cut, a in zip(cuts, first, strict=False)]


def chain(cut: list[np.ndarray], made: np.ndarray, logs: np.ndarray, m: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, float]:
    prior, before, tail = np.empty((len(cut), len(m.start))), np.zeros((len(cut), len(m.start))), np.ones((len(cut), len(m.start)))
    at, like = m.start, 0.0
    for i in range(len(cut)):
        prior[i] = at
        a = at @ made[i]
        like += np.log(a.sum()) + logs[i]
        if i + 1 < len(cut):
            before[i + 1] = a / a.sum()
            at = before[i + 1] @ m.move
    for i in range(len(cut) - 1, 0, -1):
        b = m.move @ (made[i] @ tail[i])
        tail[i - 1] = b / b.sum()
    return cut, prior, before, tail, like


def blocks(codes: list[np.ndarray], m: Model, s: Settings) -> Iterator[Block]:
    """All texts in segments by falling length, about s.block tokens in a block."""
    k = len(m.start)
    short = [c for c in codes if len(c) <= s.segment]
    long = chained([c for c in codes if len(c) > s.segment], m, s.segment)
    every = short + [c for x in long for c in x[0]]
    prior = np.concatenate([np.tile(m.start, (len(short), 1)), *(x[1] for x in long)])
    before = np.concatenate([np.zeros((len(short), k)), *(x[2] for x in long)])
    tail = np.concatenate([np.ones((len(short), k)), *(x[3] for x in long)])
    for took in dealt([len(c) for c in every], s.block):
        yield Block([every[i] for i in took], prior[took], before[took], tail[took])


def dealt(lens: list[int], limit: int) -> Iterator[np.ndarray]:
    """Places by falling length, with lengths of about `limit` together."""
    order = np.argsort(-np.array(lens, np.int64), kind="stable")
    took: list[int] = []
    size = 0
    for i in order:
        if took and size + lens[i] > limit:
            yield np.array(took)
            took, size = [], 0
        took.append(i)
        size += lens[i]
    if took:
        yield np.array(took)


def likelihoods(codes: list[np.ndarray], m: Model, s: Settings) -> np.ndarray:
    """Natural log of each whole text's likelihood."""
    like = np.empty(len(codes))
    short = np.array([i for i, c in enumerate(codes) if len(c) <= s.segment], np.int64)
    for took in dealt([len(codes[i]) for i in short], s.block):
        k = np.zeros((len(took), len(m.start)))
        like[short[took]] = Block([codes[i] for i in short[took]], np.tile(m.start, (len(took), 1)), k, k).likelihood(m)
    long = [i for i, c in enumerate(codes) if len(c) > s.segment]
    like[long] = [x[-1] for x in chained([codes[i] for i in long], m, s.segment)]
    return like


def encoded(docs: DataFrame, head, s: Settings) -> DataFrame:
    """docs (text) -> (codes): the classes of a whole text's tokens as little-endian integers, found once for all passes."""
    kind = code_type(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                offsets, index, words = common.words_of(part.column("text"))
                g = classes_of(words.cast(pa.string()), head.value, s)[0].astype(kind)[index]
                rows = [np.append(g[a:b], kind.type(END)).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["codes"])

    return docs.select("text").mapInArrow(common.tidy(run), "codes binary")


def code_type(s: Settings) -> np.dtype:
    return np.dtype("<i2" if s.classes < 1 << 15 else "<i4")


def gathered(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[list[np.ndarray]]:
    """Class sequences of whole texts, until they hold about s.gather tokens."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for x in batch.column("codes"):
            held.append(np.frombuffer(x.as_buffer(), code_type(s)).astype(np.int32))
            size += len(held[-1])
            if size >= s.gather:
                yield held
                held, size = [], 0
    if held:
        yield held


def normalised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """The M step; a little of the corpus-wide class distribution keeps every class possible in every state."""
    k = len(start)
    start, move = start + 1 / k, move + 1 / k
    emit = emit + (0.02 * emit.sum(0) + 1)[None] * prior[:, None] * 0.05
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def _rows(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> pa.RecordBatch:
    """Expected counts as rows (g, w0..): class g, or -1 for the start, -2 - z for the moves out of z."""
    used = np.flatnonzero(emit.any(1))
    g = np.concatenate([used, [-1], -2 - np.arange(len(move))])
    w = np.concatenate([emit[used], start[None], move])
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), *(pa.array(w[:, z], pa.float64()) for z in range(w.shape[1]))], ["g", *(f"w{z}" for z in range(w.shape[1]))])


def successions(codes: list[np.ndarray], near: int) -> np.ndarray:
    """[near + 1, near + 1] counts of successive tokens of the classes up to `near`."""
    flat, first = np.concatenate(codes).astype(np.int64), np.cumsum([0, *(len(c) for c in codes)])[:-1]
    good = (flat[:-1] <= near) & (flat[1:] <= near)
    good[first[1:] - 1] = False
    return np.bincount(flat[:-1][good] * (near + 1) + flat[1:][good], minlength=(near + 1) ** 2)


def first_model(counts: np.ndarray, prior: np.ndarray, s: Settings) -> Model:
    """States from clusters of words that come before and after alike: singular vectors of the normalised counts."""
    rng, k = np.random.default_rng(s.seed), s.states
    c = counts + 1e-3
    u, d, v = np.linalg.svd(c / np.sqrt(c.sum(1)[:, None] * c.sum(0)[None, :]))
    x = np.concatenate([u[:, :k] * d[:k], v[:k].T * d[:k]], 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    weight = np.sqrt(counts.sum(0) + counts.sum(1) + 1.0)
    centers = x[[int(weight.argmax())]]
    while len(centers) < k:  # the word farthest from those taken
        centers = np.concatenate([centers, x[[int((weight * (1 - (x @ centers.T).max(1))).argmax())]]])
    for _ in range(20):
        label = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, x * weight[:, None])
        centers = np.where(sums.any(1, keepdims=True), sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-12), centers)
    emit = prior[:, None] * rng.uniform(0.8, 1.2, (s.classes, k))
    own = np.full((len(x), k), 0.3)
    own[np.arange(len(x)), label] = 3.0
    own[END] = 1.0
    emit[: len(x)] *= own[: s.classes]
    hot = np.eye(k)[label]
    move = hot.T @ counts @ hot
    move = move / np.maximum(move.sum(1, keepdims=True), 1) + 0.1 / k + 0.1 * np.eye(k)
    return Model(np.full(k, 1 / k), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(docs: DataFrame, vocab: Vocabulary, s: Settings) -> Model:
    spark, k = docs.sparkSession, s.states
    prior = (vocab.class_sums + 1) / (vocab.class_sums + 1).sum()
    schema = "g int, " + ", ".join(f"w{z} double" for z in range(k))
    head = spark.sparkContext.broadcast(vocab.head)
    near = min(s.near, s.own)
    texts = common.stage(encoded(docs, head, s), "hmm-codes")

    def succeed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((near + 1) ** 2, np.int64)
        for codes in gathered(batches, s):
            found += successions(codes, near)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], ["at", "n"])

    counts = np.zeros((near + 1) ** 2)
    for r in texts.mapInArrow(common.tidy(succeed), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # (near + 1) ** 2 at most
        counts[r["at"]] = r.n
    model = first_model(counts.reshape(near + 1, near + 1), prior, s)
    for _ in range(s.rounds):
        now = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            found = np.zeros(k), np.zeros((k, k)), np.zeros((s.classes, k))
            for codes in gathered(batches, s):
                for b in blocks(codes, now.value, s):
                    b.expect(now.value, *found)
            yield _rows(*found)

        sums = texts.mapInArrow(common.tidy(expect), schema).groupBy("g").agg(*(F.sum(f"w{z}").alias(f"w{z}") for z in range(k)))
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((s.classes, k))
        for r in sums.collect():  # a row for each class and state
            if r.g >= 0:
                emit[r.g] = r[1:]
            elif r.g == -1:
                start = np.array(r[1:])
            else:
                move[-2 - r.g] = r[1:]
        model = normalised(start, move, emit, prior)
        now.unpersist()
    head.unpersist()
    common.unstage(texts)
    return model


def score_texts(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model, s: Settings) -> DataFrame:
    """docs (doc_id, held_out, text) -> the same without text, with n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    room = np.log10(vocab.class_sums + 1)
    known = spark.sparkContext.broadcast((vocab.head, np.log10(vocab.head_counts + 1.0), vocab.end_count, room, model))
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "counts_log", "model_log", "token", "rids"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs, ends, room, m = known.value
        row = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            codes = [x[-1] for x in held]
            like = likelihoods(codes, m, s) / np.log(10) - np.array([room[c].sum() for c in codes])
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array([len(c) for c in codes], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64()), pa.array(like, pa.float64()), pa.nulls(len(codes), pa.string()), pa.nulls(len(codes), pa.list_(pa.int64()))], names)

        for batch in batches:
            for part in common.slices(batch, "text"):
                offsets, index, words = common.words_of(part.column("text"))
                words = words.cast(pa.string())
                g, at = classes_of(words, head, s)
                in_head = at >= 0
                gain = np.where(in_head, logs[at] if len(logs) else 0.0, 0.0)
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                n_known = np.bincount(doc, weights=in_head[index], minlength=part.num_rows) + (ends > 0)
                total = np.bincount(doc, weights=gain[index], minlength=part.num_rows) + np.log10(ends + 1.0)
                rare = np.flatnonzero(~in_head[index])
                if len(rare):
                    rare = rare[np.argsort(index[rare], kind="stable")]
                    which, first = np.unique(index[rare], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rare)), pa.int32()), pa.array(row + doc[rare], pa.int64()))
                    n = len(which)
                    none = lambda t, n=n: pa.nulls(n, t)
                    yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), words.take(pa.array(which)), lists], names)
                g = g.astype(np.int32)[index]
                ids, out = part.column("doc_id").to_pylist(), part.column("held_out").to_pylist()
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    held.append((row + i, ids[i], out[i], int(n_known[i]), float(total[i]), np.append(g[a:b], np.int32(END))))
                row += part.num_rows
                size += len(g)
                if size >= s.gather:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, counts_log double, model_log double, token string, rids array<long>"
    both = common.stage(docs.mapInArrow(common.tidy(score), schema), "hmm-scores")
    rare = both.where(F.col("token").isNotNull()).select("token", "rids").join(counts.where(F.col("token").isNotNull()), "token")
    rare = rare.select(F.explode("rids").alias("rid"), F.log10(F.col("c") + 1).alias("gain")).groupBy("rid").agg(F.sum("gain").alias("gain"), F.count("*").alias("more"))
    slots = F.log10(F.lit(float(vocab.total + vocab.distinct + 1)))
    whole = both.where(F.col("token").isNull()).drop("token", "rids").join(rare, "rid", "left")
    counted = F.col("counts_log") + F.coalesce("gain", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (counted - F.col("n_tokens") * slots).alias("base_score"), (counted + F.col("model_log")).alias("score"))


def hmm_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, settings: Settings | None = None) -> DataFrame:
    """Train on the texts whose id doesn't fall to the held-out remainder, score all."""
    s = settings or Settings()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"), (common.remainder(F.col(id_col), modulus) == held).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = common.stage(token_counts(training), "hmm-counts")
    vocab = vocabulary(counts, s)
    return score_texts(docs, counts, vocab, train(training, vocab, s), s)


def op1_hmm_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(spark, common.table(spark, sf_dir, "documents"))
