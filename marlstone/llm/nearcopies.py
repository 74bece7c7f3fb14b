"""Near copies by SimHash, completed to a Jaccard similarity of sets of five-word shingles.

Candidates come from op8's operator with five words: pairs that its pigeonring keys find within three bits. Three of 64
bits tell only the nearest: of the pairs at a similarity of 0.8 to 0.95 in the given documents they find almost none (the
README has figures), and keys for the ten bits by which such pairs differ would not prune. So candidates also meet under
keys of MinHash values: BANDS keys of ROWS values each, so that a pair at similarity s shares no key with probability
(1 - s ** ROWS) ** BANDS, 3 in a million at 0.8. Every candidate is then compared by the whole sets of 64-bit shingle
hashes; links are between texts at `least` similarity or more, and groups are the links' connected components.

Under a key with WINDOW + 1 texts at most all pairs meet. The texts of a larger one are ordered by their next key, so that the
most alike are neighbours, and each meets the one before it only: a pair for each text and key, however large the group.
Larger groups whose texts aren't all connected by then are compared in a second pass, all with all and tile by tile: a pair of
tiles has the whole sets of its texts, and emits a spanning forest of their links, never pairs.

Edge cases: a text of less than five words is one shingle; null and blank texts are alike; a null doc_id never becomes a
component's id unless all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components, least_of, meet as meet_keys

SEED, SHINGLE, LEAST = 42, 5, 0.8
BANDS, ROWS, WINDOW = 24, 4, 8
#: Texts of a key in one tile of the second pass, and hashes of their sets.
TILE, TILE_HASHES = 1024, 1 << 20
_random = np.random.default_rng(SEED)
TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps[: len(gaps) - size + 1] + 1]).tolist()
    ends = np.concatenate([gaps[size - 1 :], [len(joined)]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(len(TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * TIMES[:, None] + PLUS[:, None]).min(1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ (column >> np.uint64(29))) * FOLD + column
    return out


def prints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, node, text) -> (doc_id, node, fp, keys, size), fp as op8's, keys as little-endian uint64, size that of the set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, size, found = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.int32), []
            for i, x in enumerate(batch.column("text")):
                text = (x.as_py() or "").encode()
                fp[i] = simhash.fingerprint(text, SHINGLE)
                own = shingles(text)
                size[i] = len(own)
                found.append(keys(own).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(fp.view(np.int64)), pa.array(found, pa.binary()), pa.array(size)], ["doc_id", "node", "fp", "keys", "size"])

    return docs.mapInArrow(common.tidy(of), "doc_id long, node long, fp long, keys binary, size int")


def dealt(nodes: DataFrame) -> DataFrame:
    """nodes (node, keys) -> (key, next, node), a row for each band."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                key = np.frombuffer(b"".join(part.column("keys").to_pylist()), "<i8").reshape(-1, BANDS)
                node = np.repeat(np.asarray(part.column("node")), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.roll(key, -1, 1).ravel()), pa.array(node)], ["key", "next", "node"])

    return nodes.select("node", "keys").mapInArrow(common.tidy(deal), "key long, next long, node long")


def candidates(nodes: DataFrame, window: int = WINDOW) -> DataFrame:
    """nodes (node, keys) -> (u, v) distinct, u < v: all pairs of keys with window + 1 texts at most, next neighbours of others.
    The others' keys are rows too, u the key and v null."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = node = np.empty(0, np.int64)  # rows of the key that the last batch ended in: all, or enough to show that it is large
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key, node = np.concatenate([key, np.asarray(batch.column("key"))]), np.concatenate([node, np.asarray(batch.column("node"))])
            if not len(key):
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.append(starts, len(key)))
            large = np.repeat(sizes > window + 1, sizes)
            whole = ~large & ((key != key[-1]) | (batch is None))
            us, vs = [key[starts[sizes > window + 1]]], [np.empty(0, np.int64)]
            for back in range(1, min(window, len(key) - 1) + 1):
                later = np.arange(back, len(key))
                later = later[(key[later] == key[later - back]) & (whole[later] | large[later] & (back == 1))]
                us.append(np.minimum(node[later], node[later - back]))
                vs.append(np.maximum(node[later], node[later - back]))
            v = pa.concat_arrays([pa.nulls(len(us[0]), pa.int64()), pa.array(np.concatenate(vs))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), v], ["u", "v"])
            rest = max(int(starts[-1]), len(key) - window - 2)
            key, node = key[rest:], node[rest:]

    return dealt(nodes).repartition("key").sortWithinPartitions("key", "next", "node").mapInArrow(common.tidy(meet), "u long, v long").distinct()


def forest(hashes: list[np.ndarray], left: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts, and of others that they are connected with: a spanning forest of the links of left texts with the
    others (of all with all if same). Intersections of sets are products of incidence matrices, some hashes at a time."""
    sizes = np.array([len(x) for x in hashes], np.float64)
    _, code, many = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(hashes)), sizes.astype(np.int64))
    shared = many[code] > 1
    number = np.cumsum(many > 1) - 1
    code, text = number[code[shared]], text[shared]
    order = np.argsort(code, kind="stable")
    code, text = code[order], text[order]
    x, y = (np.arange(len(hashes)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    both = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        a, b = np.searchsorted(code, [at, at + 2048])
        held = np.zeros((len(hashes), 2048), np.float32)
        held[text[a:b], code[a:b] - at] = 1
        both += held[x] @ held[y].T
    i, j = np.nonzero(both >= least * (sizes[x][:, None] + sizes[y][None, :] - both))
    i, j = x[i], y[j]
    label = np.arange(len(hashes))
    while len(i):
        u, v = label[i], label[j]
        i, j, u, v = i[u != v], j[u != v], u[u != v], v[u != v]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def apart(nodes: DataFrame, docs: DataFrame, large: DataFrame, roots: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v): links that connect the texts under a key of large (key) wherever roots (node, root) doesn't connect them all."""
    few = large.count() <= 1 << 16
    named = nodes.select("node", "size").join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    held = common.stage(dealt(nodes).select("key", "node").join(F.broadcast(large) if few else large, "key").join(named, "node"), "near-large")
    mixed = held.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key", "n")
    own = common.stage(meet_keys(held.select("key", "node", "size"), mixed.withColumn("m", F.col("n")), "key", held.count()).select("key", "node", "size"), "near-mixed")
    sets = hashed(own.select("node").distinct(), docs)
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_HASHES)).cast("int").alias("tiles")
    per_key = own.groupBy("key").agg(tiles, F.count("*").alias("n"))
    dealt_out = meet_keys(own, per_key, "key", own.count()).withColumn("t", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt_out = dealt_out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt_out = dealt_out.select("key", F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b"), (F.col("t") <= F.col("other")).alias("left"), "node")

    def compare(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        sets_ = [np.asarray(x.values) for x in group["hashes"]]
        u, v = forest(sets_, group["left"].to_numpy(), group["a"][0] == group["b"][0], least)
        return pa.table({"u": node[u], "v": node[v]})

    return dealt_out.join(sets, "node").groupBy("key", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def hashed(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, hashes), held: the set of each of the members' (node) texts in docs (node, text)."""
    texts = docs.select("node", "text").join(members, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                found = [shingles((x.as_py() or "").encode()).view(np.int64) for x in part.column("text")]
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "hashes"])

    return common.hold(texts.mapInArrow(common.tidy(sets), "node long, hashes array<long>"))


def fitting(pairs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Of the pairs (u, v) those whose sets' sizes, in nodes (node, size), allow so much similarity, held."""
    size = lambda x, n: nodes.select(F.col("node").alias(x), F.col("size").alias(n))
    sized = pairs.join(size("u", "an"), "u").join(size("v", "bn"), "v")
    return common.hold(sized.where(F.least("an", "bn") >= least * F.greatest("an", "bn")).select("u", "v"))


def alike(pairs: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Of the pairs (u, v) those whose texts in docs (node, text) are at least so similar, staged."""
    held = hashed(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs)
    both = pairs.join(held.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    size, shared = F.size("a") + F.size("b"), F.size(F.array_intersect("a", "b"))  # in the JVM, pair by pair: a batch of pairs of whole sets would be large
    links = common.stage(both.select("u", "v", size.alias("size"), shared.alias("shared")).where(F.col("shared") >= least * (F.col("size") - F.col("shared"))).select("u", "v"), "near-links")
    common.release(pairs, held)
    return links


def near_components(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id), a row for each row of docs, to be read before `common.release`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("node"), F.col("text").cast("string").alias("text"))
    made = common.hold(prints(docs))
    nodes = common.stage(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("keys").alias("keys"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.count("*").alias("n")), "near-nodes")
    by_print = nodes.groupBy("fp").agg(F.min("node").alias("first"))  # texts with one fingerprint meet its first one
    bits = simhash.links(by_print.select("fp")).join(by_print.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(by_print.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    same = nodes.select("node", "fp").join(by_print, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = bits.union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    met = common.stage(near.union(candidates(nodes, window)).distinct(), "near-pairs")
    links = alike(fitting(met.where("v is not null"), nodes), docs)
    roots = common.stage(components(links), "near-roots")
    large = met.where("v is null").select(F.col("u").alias("key"))
    if not large.isEmpty():
        more = common.stage(apart(nodes, docs, large, roots), "near-more")
        if not more.isEmpty():
            roots = common.stage(components(links.union(more)), "near-roots")
    linked = common.stage(nodes.select("node", "least").join(roots, "node"), "near-linked")
    ids = common.stage(nodes.join(least_of(linked), "node", "left").select("node", "n", F.coalesce("component_id", "least").alias("component_id")), "near-ids")
    common.unstage(nodes, met, links, roots, linked)
    return meet_keys(made.select("doc_id", "node"), ids, "node", made.count()).select("doc_id", "component_id")
