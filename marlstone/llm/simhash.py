"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits over three-word shingles; two documents are linked at `distance` (3) differing bits or fewer.
The bits form a ring of four segments of 16. By the pigeonring principle some start i has, for every chain length l,
at most l * 3 / 4 differences in the l segments from i: 0, then 1, then 2, then 3. So a fingerprint lives under one
key per start, made of segments i and i + 1 (32 bits), and visits the keys that have one of its set bits in segment
i + 1 cleared: of two fingerprints that differ in one bit there, just one visits the other. Under a key the chain of
three segments is checked, then the full distance. Rows grow in proportion to the number of distinct fingerprints
(36 each on average), and a key emits a spanning forest of its links, never all pairs. The fingerprints of a key under which
more than `LARGE` live are dealt once more, by the third segment of the chain: each lives under its own and visits those within two
bits of it, which is all that the chain allows; so a task has as many as one fourth segment tells apart, 65,536, and visitors.

Edge cases: a null or blank text has fingerprint 0, linked like any other; equal texts share a fingerprint and are one
node; an empty table gives an empty result; a null doc_id never becomes a component's id unless all its ids are null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, least_of, meet

SEED = 42
SEGMENT, SEGMENTS, DISTANCE = 16, 4, 3
#: Fingerprints that may live under a key and be compared as they are; keys that were dealt by a third segment have the bit THIRD.
LARGE, THIRD = 1 << 13, 1 << 60


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit b is set if over half of the shingles' hashes have it; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps[: len(gaps) - shingle + 1] + 1]).tolist()
    ends = np.concatenate([gaps[shingle - 1 :], [len(joined)]]).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        some = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)], ">u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp), fp the fingerprint's bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((x.as_py() or "").encode(), shingle) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(common.tidy(of), "doc_id long, fp long")


def keyed(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which fingerprints (uint64) live or visit: key, index of the fingerprint, whether it lives there."""
    keys, index, home = [], [], []
    every = np.arange(len(fps))
    for i in range(SEGMENTS):
        first = (fps >> np.uint64(SEGMENT * i)) & np.uint64(0xFFFF)
        second = (fps >> np.uint64(SEGMENT * ((i + 1) % SEGMENTS))) & np.uint64(0xFFFF)
        base = (np.uint64(i) << np.uint64(32)) | (first << np.uint64(16))
        keys.append(base | second)
        index.append(every)
        home.append(np.ones(len(fps), bool))
        for b in range(SEGMENT):
            has = np.flatnonzero(second >> np.uint64(b) & np.uint64(1))
            keys.append(base[has] | (second[has] ^ np.uint64(1 << b)))
            index.append(has)
            home.append(np.zeros(len(has), bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(index), np.concatenate(home)


def keyed_again(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for fingerprints under large keys, by the third segment of their chain too. Of two that differ there in one or
    two bits, just one visits the other: the one that has the lowest of these bits set."""
    start = keys >> 32
    third = (fps >> (SEGMENT * ((start + 2) % SEGMENTS)).astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
    base = np.int64(THIRD) | keys << np.int64(SEGMENT)
    every = np.arange(len(fps))
    out, index, home = [base | third], [every], [np.ones(len(fps), bool)]
    for b in range(SEGMENT):
        has = np.flatnonzero(third >> b & 1)
        for flip in (1 << b, *(1 << b | 1 << c for c in range(b + 1, SEGMENT))):
            out.append((base | third ^ flip)[has])
            index.append(has)
            home.append(np.zeros(len(has), bool))
    return np.concatenate(out), np.concatenate(index), np.concatenate(home)


def start_of(key: int) -> int:
    """The segment that a key's chain begins with."""
    return key >> (32 + SEGMENT) & 3 if key & THIRD else key >> 32


def forest(key: int, lives: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints under a key: a spanning forest of pairs that are linked themselves, arrays u, v."""
    start = np.uint64(SEGMENT * start_of(key))
    ring = lambda x: (x >> start) | (x << ((np.uint64(64) - start) & np.uint64(63))) if start else x
    chain = np.uint64((1 << 3 * SEGMENT) - 1)
    every = np.concatenate([lives, visits])
    turned = ring(every)
    label = np.arange(len(every))
    us, vs = [], []
    rows = max(1, (1 << 21) // len(every))
    for at in range(0, len(lives), rows):
        own = np.arange(at, min(at + rows, len(lives)))
        x = turned[own, None] ^ turned[None, :]
        near = np.bitwise_count(x & chain) <= 2
        near &= np.bitwise_count(x) <= DISTANCE
        near[np.arange(len(own)), own] = False
        for i in own[near.any(1)]:
            to = np.flatnonzero(near[i - at])
            other = to[label[to] != label[i]]
            if len(other):
                trees, first = np.unique(label[other], return_index=True)
                us += [i] * len(first)
                vs += other[first].tolist()
                label[np.isin(label, trees) | (label == label[i])] = min(label[i], trees[0])
    return every[np.array(us, np.int64)], every[np.array(vs, np.int64)]


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """(fp) distinct -> (u, v): pairs that are linked, enough to connect what is connected."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = np.asarray(batch.column("fp")).view(np.uint64)
            for at in range(0, len(all_fps), 1 << 13):
                fp = all_fps[at : at + (1 << 13)]
                key, index, home = keyed(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[index].view(np.int64)), pa.array(home)], ["key", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

        def groups(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            key, fp, home = cols
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(key)))
            homes = np.add.reduceat(home.astype(np.int64), starts) if len(key) else sizes
            us, vs = [], []
            for g in np.flatnonzero((sizes > 1) & (homes > 0)):
                at = slice(starts[g], starts[g] + sizes[g])
                own = fp[at].view(np.uint64)
                u, v = forest(int(key[starts[g]]), own[home[at]], own[~home[at]])
                us.append(u)
                vs.append(v)
            if not us:
                return None
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            new = [np.asarray(batch.column("key")), np.asarray(batch.column("fp")), batch.column("home").to_numpy(zero_copy_only=False)]
            cols = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            rest = [c[cut:] for c in cols]
            if cut and (found := groups([c[:cut] for c in cols])) is not None:
                yield found
        if len(rest[0]) and (found := groups(rest)) is not None:
            yield found

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 11):
                part = batch.slice(at, 1 << 11)
                fp = np.asarray(part.column("fp")).view(np.uint64)
                key, index, home = keyed_again(np.asarray(part.column("key")), fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[index].view(np.int64)), pa.array(home)], ["key", "fp", "home"])

    kind = "key long, fp long, home boolean"
    dealt = fps.select("fp").mapInArrow(common.tidy(deal), kind)
    segment = lambda i: F.shiftrightunsigned("fp", SEGMENT * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    own = F.array(*(F.lit(i << 32).cast("long").bitwiseOR(F.shiftleft(segment(i), SEGMENT)).bitwiseOR(segment(i + 1)) for i in range(SEGMENTS)))
    big = fps.select(F.explode(own).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large)
    big = common.stage(big.select("key"), "simhash-large")
    if not big.isEmpty():
        few = F.broadcast(big) if big.count() <= 1 << 18 else big
        once = dealt.join(few, "key", "left_anti")
        dealt = once.unionByName(dealt.join(few, "key", "left_semi").select("key", "fp").distinct().mapInArrow(common.tidy(again), kind))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(common.tidy(meet), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = common.stage(fingerprints(docs), "simhash-prints")
    nodes = common.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    linked = common.stage(nodes.select("fp", "least").join(roots, "fp"), "simhash-linked")
    ids = common.stage(nodes.join(least_of(linked), "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-ids")
    common.unstage(nodes, linked)
    return meet(prints, ids, "fp", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(common.table(spark, sf_dir, "documents"))
