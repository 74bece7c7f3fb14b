"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in the order of a hash of their id, are cut into blocks of `block_chars` characters (a document
belongs to the block in which it starts). Weights are integer shares, so a source with share a of a total of Q gets its
i-th block (from 1) a release at floor((i - 1) Q / a) and a deadline at ceil(i Q / a); earliest deadline first over the
released blocks gives every stream, at every slot, less than one block more or less than its weight's part. The order
repeats every Q slots, so the driver makes one period and each block computes its slot. When a source runs out, the
others go on by their shares: a new phase with a new period. Nothing is dropped or repeated.

Every source is scheduled. Those with a given share and the `streams` largest are streams of their own. If there are more,
the others are dealt by a hash to at most `streams` groups; a group is one stream with the sum of its sources' weights,
and its own blocks are dealt to its sources by Pfair once more, so that such a source has less than two blocks (not one) more
or less than its part. The driver holds one row per source.
Prefix sums are taken within (source, bucket of the hash) and then over the buckets, of which there are as many as the
largest source needs, so a large source is spread; the hash is of the id and the text, so a repeated id is spread too.

Edge cases: a null source is a source of its own, a null text has no characters but still counts one, null and repeated
ids are ordered by their text, rows that repeat an id and its text in any order; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
import math
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Buckets of a source at least, and its rows in one of them, about.
BUCKETS, BUCKET_ROWS = 256, 1 << 18
#: Sources that are streams of their own, besides those with a given share; the driver's work grows with the square.
STREAMS = 512
OWN = "__mix_"


def period(shares: dict[int, int]) -> list[int]:
    """Streams by slot over one period: earliest deadline first among released blocks, ties to the smaller stream."""
    total = sum(shares.values())
    waiting = sorted((((i - 1) * total) // a, -((-i * total) // a), s) for s, a in shares.items() for i in range(1, a + 1))
    ready: list[tuple[int, int]] = []
    out, at = [], 0
    for slot in range(total):
        while at < len(waiting) and waiting[at][0] <= slot:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        out.append(heapq.heappop(ready)[1])
    return out


def phases(blocks: dict[int, int], shares: dict[int, int]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """Rows (stream, first block, end block, first slot, period, slots of the stream in a period)."""
    done, out, slot = dict.fromkeys(blocks, 0), [], 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        unit = math.gcd(*(shares[s] for s in left))
        order = period({s: shares[s] // unit for s in left})
        places: dict[int, list[int]] = {s: [] for s in left}
        for i, s in enumerate(order):
            places[s].append(i)
        size = len(order)
        lasts = {s: (n - 1) // len(places[s]) * size + places[s][(n - 1) % len(places[s])] + 1 for s, n in left.items()}
        length = min(lasts.values())
        for s in left:
            n = length // size * len(places[s]) + sum(p < length % size for p in places[s])
            if n:
                out.append((s, done[s], done[s] + n, slot, size, places[s]))
            done[s] += n
        slot += length
    return out


def default_shares(chars: dict[int, int], total: int = 1000) -> dict[int, int]:
    """In proportion to the root of the size: small sources weigh more than their part."""
    return shares_of({s: math.sqrt(c) for s, c in chars.items()}, total)


def shares_of(weights: dict[int, float], total: int = 1000) -> dict[int, int]:
    return {s: max(1, round(total * w / sum(weights.values()))) for s, w in weights.items()}


def whole_shares(weights: dict[int, float], total: int) -> dict[int, int]:
    """The same with the sum `total` exactly, which is the number of weights at least."""
    part = {s: (total - len(weights)) * w / sum(weights.values()) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in part.items()}
    for s in sorted(part, key=lambda s: (int(part[s]) - part[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, block_chars: int = 1 << 16, streams: int = STREAMS) -> DataFrame:
    """docs (doc_id, text, source, ...) with __mix_block and __mix_slot: their block in the source, and its slot. shares:
    target weights of sources by name (None is the null source), 1 if it isn't there; "*" is that of all grouped sources
    together. Without shares a source weighs the root of its size."""
    spark = docs.sparkSession
    columns = docs.columns
    source = F.struct(F.col("source").cast("string").alias("name"))
    cost = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.select(source.alias("source"), cost.alias("cost")).groupBy("source").agg(F.sum("cost").alias("chars"), F.count("*").alias("rows")).collect()  # a row for each source
    buckets = max(BUCKETS, *(-(-r.rows // BUCKET_ROWS) for r in sizes), 1)
    every = sorted(((r.source.name, r.chars) for r in sizes), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    own = [n for i, (n, _) in enumerate(every) if i < streams or shares and n in shares]
    rest = [x for x in every if x[0] not in set(own)]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    name = lambda n: "" if n is None else f"s{n}"
    groups: dict[int, list[int]] = {}
    many = min(streams, -(-len(rest) // streams))
    for i, (n, _) in enumerate(rest):
        groups.setdefault(len(own) + zlib.crc32(name(n).encode()) % many, []).append(i)
    ceil = lambda c: (c - 1) // block_chars + 1
    # streams of the upper level, and within a group the places of its sources
    sized = dict(every)
    blocks = {i: ceil(sized[n]) for i, n in enumerate(own)} | {g: sum(ceil(rest[i][1]) for i in x) for g, x in groups.items()}
    roots = {g: sum(math.sqrt(rest[i][1]) for i in x) for g, x in groups.items()}
    if shares:
        scale = 1000 if groups else 1
        given = {i: scale * shares.get(n, 1) for i, n in enumerate(own)} | (whole_shares(roots, scale * shares.get("*", 1)) if groups else {})
    else:
        given = shares_of({i: math.sqrt(sized[n]) for i, n in enumerate(own)} | roots, max(1000, 8 * (len(own) + len(roots))))
    made = phases(blocks, given)
    within = [(name(n), i, 0, blocks[i], 0, 1, [0]) for i, n in enumerate(own)]
    for g, x in sorted(groups.items()):
        inner = phases({i: ceil(rest[i][1]) for i in x}, default_shares({i: rest[i][1] for i in x}))
        within += [(name(rest[i][0]), g, *row) for i, *row in inner]

    hashed = F.xxhash64("doc_id", "text")
    rows = docs.select("*", key.alias(f"{OWN}key"), hashed.alias(f"{OWN}hash"), F.pmod(hashed, F.lit(buckets)).cast("int").alias(f"{OWN}bucket"), cost.alias(f"{OWN}cost"), F.xxhash64("text").alias(f"{OWN}tie"))
    sums = rows.groupBy(f"{OWN}key", f"{OWN}bucket").agg(F.sum(f"{OWN}cost").alias(f"{OWN}chars"))
    up_to = Window.partitionBy(f"{OWN}key").orderBy(f"{OWN}bucket").rowsBetween(Window.unboundedPreceding, 0)
    base = sums.withColumn(f"{OWN}base", F.sum(f"{OWN}chars").over(up_to) - F.col(f"{OWN}chars")).drop(f"{OWN}chars")
    base = F.broadcast(base) if len(every) * buckets <= 1 << 16 else base
    inner = Window.partitionBy(f"{OWN}key", f"{OWN}bucket").orderBy(f"{OWN}hash", "doc_id", f"{OWN}tie")
    rows = rows.withColumn(f"{OWN}inner", F.sum(f"{OWN}cost").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(base, [f"{OWN}key", f"{OWN}bucket"])
    rows = rows.withColumn(f"{OWN}block", F.floor((F.col(f"{OWN}base") + F.col(f"{OWN}inner") - F.col(f"{OWN}cost")) / block_chars))

    def placed(rows: DataFrame, plan: DataFrame, by: str, at: str, out: str) -> DataFrame:
        """rows with the slot `out` of their block `at` by the plan of their `by`."""
        p = plan.withColumnRenamed(by, f"{OWN}by")
        rows = rows.join(F.broadcast(p), (F.col(by) == F.col(f"{OWN}by")) & (F.col(at) >= F.col(f"{OWN}first")) & (F.col(at) < F.col(f"{OWN}end")))
        nth, size = F.col(at) - F.col(f"{OWN}first"), F.size(f"{OWN}places")
        slot = F.col(f"{OWN}from") + F.floor(nth / size) * F.col(f"{OWN}period") + F.element_at(f"{OWN}places", (nth % size + 1).cast("int"))
        return rows.withColumn(out, slot.cast("long")).drop(f"{OWN}by", f"{OWN}first", f"{OWN}end", f"{OWN}from", f"{OWN}period", f"{OWN}places")

    kinds = f"{OWN}first long, {OWN}end long, {OWN}from long, {OWN}period long, {OWN}places array<long>"
    rows = placed(rows, spark.createDataFrame(within, f"{OWN}key string, {OWN}stream int, {kinds}"), f"{OWN}key", f"{OWN}block", f"{OWN}nth")
    rows = placed(rows, spark.createDataFrame(made, f"{OWN}stream int, {kinds}"), f"{OWN}stream", f"{OWN}nth", f"{OWN}slot")
    return rows.select(*columns, F.col(f"{OWN}block").cast("long").alias(f"{OWN}block"), f"{OWN}slot", f"{OWN}hash")


def mixed_order(docs: DataFrame, **settings) -> DataFrame:
    """docs, sorted by slot."""
    return mix(docs, **settings).orderBy(f"{OWN}slot", f"{OWN}hash").select(*docs.columns)


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", F.col(f"{OWN}block").alias("block"), F.col(f"{OWN}slot").alias("slot"))
