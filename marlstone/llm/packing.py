"""Vector best-fit packing of whole documents into sequences.

Every piece asks for tokens, one place among the sequence's documents and an attention cost (its length squared). The
pieces are packed by falling length; each goes to the open sequence that it leaves with the smallest weighted norm of
residual capacities, under all three capacities (so sequences with the same room for tokens are told apart by their
documents and attention). Pieces of a length are alike, so the plan is made on the driver from
the number of pieces of each length (at most `tokens` numbers) for whole runs of equal sequences at a time: its size
doesn't grow with the input. Spark numbers the pieces of a length (split over as many salts as its pieces need, so that a
frequent length isn't one task's) and each looks up its sequence and offset. No piece is dropped, however many there are.

Ids are those of the tokenizer as its file sets it up: the strings of its special tokens become special ids.

Edge cases: a null or blank text is one piece with only the end id; an empty table gives an empty result; repeated rows
are packed one by one; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclasses.dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for documents and attention cost are those that the token limit implies."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Ids of words seen, by tokenizer and word.
_seen: dict[str, dict[str, bytes]] = {}
common.keeps("packing", _seen.clear)


#: Words that are one piece for the tokenizer, unchanged by its normalisation: basic and Latin-1 small letters.
PLAIN = "[a-z\u00df-\u00f6\u00f8-\u00ff]"
#: Marks that end a word after such a letter; the apostrophe isn't one of them, as it may take letters with it.
MARKS = r"[!-&(-/:-@\[-`{-~]"
#: Begins the string of a special token, which is case-sensitive and one piece with its marks.
SPECIAL = "<|"


def encode_words(words: list[str], path: str) -> list[bytes]:
    """Ids of single words as little-endian uint32; a word's ids don't depend on its neighbours, since the tokenizer
    drops white space and never joins across it."""
    t, cache = _tokenizer(path), _seen.setdefault(path, {})
    if len(cache) > 250_000:
        cache.clear()
    new = pa.array([w for w in words if w not in cache], pa.string())
    plain = pc.match_substring_regex(new, f"^{PLAIN}{{1,64}}$")
    whole = new.filter(plain).to_pylist()
    for at in range(0, len(whole), 4_000):
        some = whole[at : at + 4_000]
        e = t.encode(" ".join(some), add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        cache.update((w, ids[a:b]) for w, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    rest = new.filter(pc.invert(plain)).to_pylist()
    long: dict[str, bytes] = {}
    for at in range(0, len(rest), 4_000):
        some = rest[at : at + 4_000]
        for w, e in zip(some, t.encode_batch_fast(some, add_special_tokens=False), strict=True):
            (cache if len(w) <= 64 else long)[w] = np.array(e.ids, "<u4").tobytes()
    return [cache[w] if w in cache else long[w] for w in words]


def gather(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs of `flat` that `index` names, end to end; run i is at begin[i] and lens[i] long."""
    n = lens[index]
    return flat[np.repeat(begin[index] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words end to end, number of ids of each). Marks at a word's end are encoded apart, as the tokenizer
    itself does, so that a word is looked up once whatever follows it."""
    words = words.cast(pa.string())
    apart = pc.extract_regex(pc.if_else(pc.match_substring(words, SPECIAL), pa.scalar("", pa.string()), words), f"^(?P<head>(?s:.*){PLAIN})(?P<tail>{MARKS}+)$")
    both = pa.concat_arrays([pc.coalesce(pc.struct_field(apart, "head"), words), pc.coalesce(pc.struct_field(apart, "tail"), pa.scalar(""))]).dictionary_encode()
    each = encode_words(both.dictionary.to_pylist(), path)
    lens = np.fromiter(map(len, each), np.int64, len(each)) // 4
    index = np.asarray(both.indices).astype(np.int64).reshape(2, -1)
    return gather(np.frombuffer(b"".join(each), "<u4"), np.cumsum(lens) - lens, lens, index.T.ravel()), lens[index].sum(0)


def pieces(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, *carry) -> (uid, doc_id, piece, start, length, ids, *carry): whole texts as ids, an end id
    after each, cut into pieces of `size` only where longer. ids: little-endian uint32; carry: longs."""
    path = path or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        stop = np.array([end_id], "<u4")
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                special = pc.any(pc.match_substring(part.column("text"), SPECIAL)).as_py()
                offsets, index, words = common.words_of(part.column("text"), lower=not special)
                flat, lens = word_ids(words, path)
                begin = np.cumsum(lens) - lens
                rows = []
                for d, doc in enumerate(part.column("doc_id").to_pylist()):
                    ids = np.append(gather(flat, begin, lens, index[offsets[d] : offsets[d + 1]]), stop)
                    rows += [(doc, k, k * size, ids[k * size : (k + 1) * size], d) for k in range(-(-len(ids) // size))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(rows))), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array([len(x) for x in cols[3]], pa.int64()), pa.array([x.tobytes() for x in cols[3]], pa.binary()), *(part.column(x).take(pa.array(cols[4])) for x in carry)], ["uid", "doc_id", "piece", "start", "length", "ids", *carry])
                uid += len(rows)

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    return docs.mapInArrow(common.tidy(run, "packing"), "uid long, doc_id long, piece int, start long, length long, ids binary" + "".join(f", {x} long" for x in carry))


def plan(counts: dict[int, int], c: Capacity) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): pieces of `length` from that rank on go to the sequences from
    that one on, one each, until the next row of the length. Lengths by falling size."""
    room = np.empty((0, 3))  # residual capacities of each run of alike sequences
    first, many = np.empty(0, np.int64), np.empty(0, np.int64)
    scale = np.array(c.weights) / np.array([c.tokens, c.documents, c.attention], float) ** 2
    out, sequences = [], 0
    least = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > [c.tokens, c.documents, c.attention]).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        while left:
            after = room - need
            fits = (after >= 0).all(1)
            if not fits.any():
                # as many new sequences as these pieces would fill if only they came
                per = int(min(c.tokens // length, c.documents, c.attention // (length * length)))
                n = -(-left // per)
                room = np.vstack([room, [c.tokens, c.documents, c.attention]])
                first, many = np.append(first, sequences), np.append(many, n)
                sequences += n
                continue
            norm = np.where(fits, after**2 @ scale, np.inf)
            k = int(norm.argmin())
            n = min(left, int(many[k]))
            out.append((length, rank, int(first[k]), int(c.tokens - room[k, 0])))
            left, rank = left - n, rank + n
            if n < many[k]:
                room, first, many = np.vstack([room, room[k]]), np.append(first, first[k] + n), np.append(many, many[k] - n)
            room[k], many[k] = after[k], n
        open_ = (room[:, 0] >= least) & (room[:, 1] >= 1)
        room, first, many = room[open_], first[open_], many[open_]
    return np.array(out, np.int64).reshape(-1, 4)


def pack(items: DataFrame, capacity: Capacity | None = None, rows: int = 1 << 16) -> DataFrame:
    """items (uid unique, length, ...) -> the same with sequence_id and offset; a task numbers about `rows` of a length.
    items is read three times: stage it before."""
    c = capacity or Capacity()
    spark = items.sparkSession
    many = [(r.length, -(-r["count"] // rows)) for r in items.groupBy("length").count().collect()]  # tokens rows at most
    salts = spark.createDataFrame(many, "length long, salts long")
    items = items.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int")).drop("salts")
    held = items.groupBy("length", "salt").count().toArrow().to_pandas().sort_values(["length", "salt"])  # a row for each task above
    made = plan(held.groupby("length")["count"].sum().to_dict(), c)
    order = np.lexsort((made[:, 1], made[:, 0]))
    bases = {(r.length, r.salt): b for r, b in zip(held.itertuples(), held.groupby("length")["count"].cumsum() - held["count"], strict=True)}
    shared = spark.sparkContext.broadcast((made[order], bases))
    columns = [x for x in items.columns if x != "salt"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bases = shared.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length = np.asarray(batch.column("length"))
            base = np.array([bases[x] for x in zip(length.tolist(), batch.column("salt").to_pylist(), strict=True)], np.int64)
            rank = base + np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], [*columns, "sequence_id", "offset"])

    kinds = dict(items.dtypes)
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1)
    return ranked.mapInArrow(common.tidy(place), ", ".join(f"`{x}` {kinds[x]}" for x in columns) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: Capacity | None = None, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    c = capacity or Capacity()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = pieces(docs, path, c.tokens, end_id)
    held = common.stage(cut.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")
    return pack(held, c).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `part` and `at`, the places of its rows: Spark's number of the file and the row in it where docs is a
    table as read (readers take files in any order, writers number them by partition), else partition and row."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
        return docs.select("doc_id", "text", F.coalesce(number, F.lit(0)).cast("long").alias("part"), F.col("_metadata.row_index").cast("long").alias("at"))
    place = F.monotonically_increasing_id()
    return docs.select("doc_id", "text", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))


def place_run(part: pa.Table, c: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence from 0, offset) of the pieces (at, piece, length) of a run; sequences are numbered by their first place."""
    at, piece, length = (np.asarray(part[x]).astype(np.int64) for x in ("at", "piece", "length"))
    sizes, counts = np.unique(length, return_counts=True)
    made = plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), c)
    made = made[np.lexsort((made[:, 1], made[:, 0]))]
    order = np.lexsort((piece, at, length))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.searchsorted((made[:, 0] << 44) + made[:, 1], (length << 44) + rank, side="right") - 1
    sequence = made[row, 2] + rank - made[row, 1]
    first = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, sequence, at)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first, kind="stable")] = np.arange(len(first))
    return number[sequence], made[row, 3]


def pack_in_order(docs: DataFrame, path: str | None = None, capacity: Capacity | None = None, end_id: int = 0, run: int = 1024) -> DataFrame:
    """As pack_documents, in the order of docs: a sequence holds documents of one run of `run` successive rows (less at a
    file's end), and sequence ids follow the runs, so that successive sequences hold what stands together in docs. The
    driver gets one number for each run."""
    c = capacity or Capacity()
    docs = in_order(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "part", F.floor(F.col("at") / run).cast("long").alias("run"), "at")
    cut = pieces(docs, path, c.tokens, end_id, ("part", "run", "at"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held = common.stage(cut.withColumn("ids_crc32", F.crc32("ids")).select(*own, "part", "run", "at"), "pack-pieces")

    def place(part: pa.Table) -> pa.Table:
        sequence, offset = place_run(part, c)
        return part.drop_columns(["at"]).append_column("nth", pa.array(sequence)).append_column("offset", pa.array(offset))

    placed = common.stage(held.groupBy("part", "run").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, run long, nth long, offset long"), "pack-runs")
    bases, many = [], 0
    for r in sorted(placed.groupBy("part", "run").agg(F.max("nth").alias("last")).collect()):
        bases.append((r.part, r.run, many))
        many += r["last"] + 1
    base = docs.sparkSession.createDataFrame(bases, "part long, run long, base long")
    return placed.join(F.broadcast(base), ["part", "run"]).select(*own, (F.col("base") + F.col("nth")).alias("sequence_id"), "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
