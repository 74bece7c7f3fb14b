"""Blocks of postings, tiles, bounds, the bucketed store, the log's state, cancellation, split files: against plain statements."""

import json
import os
import random
import re
import time
import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import stem, text
from marlstone.operators import ann, blocks, bm25, collection, scan, scenario, tiles
from marlstone.operators.chunk import chunk_corpus, placed
from marlstone.plans import catalog
from marlstone.sources import npy, readers
from marlstone.sources.stage import shared_dir, stage
from marlstone.sources.vectors import VectorStore
from marlstone.streaming import oplog


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# --- blocks


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(3000)]
    i = bm25.build(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    return stage(i.rows, "rows"), stage(i.stats, "stats")


@pytest.fixture(scope="module")
def terms(spark, index):
    rng = random.Random(5)
    vocabulary = sorted(r.term for r in index[0].select("term").distinct().collect())
    rows = [(q, s, t) for q in range(12) for s in range(2) for t in rng.sample(vocabulary, rng.choice([1, 2, 6]))]
    return spark.createDataFrame([*rows, *rows[:5], (99, 0, "absent")], "query_id long, stream_id long, term string")


def test_blocks_hold_the_postings(spark, index):
    rows, stats = index
    for width in (1, 64, 1 << 20):
        b = stage(blocks.blocked(rows, width), "blocks")
        got = rows_of(blocks.postings(b, stats, width).select("term", "chunk_id", "score"))
        assert got == rows_of(rows.select("term", "chunk_id", "score"))
        ids = bm25.term_ids(rows.select("term", "df").distinct())
        assert rows_of(blocks.csr_offsets(b, ids)) == rows_of(bm25.csr_offsets(rows, ids))
    assert blocks.blocked(rows.where("false")).count() == 0


@pytest.mark.parametrize(("k", "width"), [(3, 16), (10, 64), (200, 512), (5000, 64)])
def test_search_in_blocks_is_exact(spark, index, terms, k, width):
    rows, stats = index
    b = stage(blocks.blocked(rows, width), "blocks")
    want = bm25.query(rows.select("term", "chunk_id", "score"), terms, k)
    got = blocks.query(b, stats, terms, k, width)
    assert rows_of(got.select("query_id", "stream_id", "chunk_id", "score", "rank")) == rows_of(want.select("query_id", "stream_id", "chunk_id", "score", "rank"))
    read, every = blocks.read(b, stats, terms, k, width)
    assert every == rows.join(terms.distinct(), "term").count()
    assert read < 0.75 * every if k == 3 else read <= every


def test_search_in_blocks_without_hits(spark, index, terms):
    rows, stats = index
    b = stage(blocks.blocked(rows), "blocks")
    assert blocks.query(b, stats, terms.where("term = 'absent'")).count() == 0
    assert blocks.query(b.where("false"), stats, terms).count() == 0


def test_counts_are_made_where_the_texts_are(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Running", "run", "boxes", "sky", "modernized", "1820s", "a1", "-"], k=rng.randint(0, 30))) for _ in range(200)]
    chunks = spark.createDataFrame([*enumerate(texts), (200, None)], "chunk_id long, text string")
    counts = bm25.term_counts(chunks.repartition(3), 16)  # out of order: blocks in several rows
    assert "Exchange" not in bm25.term_counts(chunks)._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, text in enumerate(texts):
        for word in re.findall("[a-z0-9]+", text.lower()):
            for term in {word, stem.stem(word)}:
                want[term, i] = want.get((term, i), 0) + 1
    got = rows_of(bm25.spread(counts, "term", width=16))
    assert [r[:3] for r in got] == sorted((t, i, n) for (t, i), n in want.items())
    lengths = {i: sum(n for (_, j), n in want.items() if j == i) for _, i in want}
    assert all(dl == lengths[i] for _, i, _, dl in got)
    assert counts.agg(F.sum("n"), F.sum("total")).first() == (len(want), sum(want.values()))


def test_stem_of_a_word_is_the_columns_stem(spark):
    rng = random.Random(8)
    ends = [a for a, _ in stem.SECOND + stem.THIRD] + stem.FOURTH + ["ed", "ing", "eed", "s", "sses", "ies", "y", "e", "ll", "at", "bl", "iz"]
    words = {"".join(rng.choices("aeioubcdlstyz1", k=rng.randint(0, 6))) + "".join(rng.choices(ends, k=rng.randint(1, 3))) for _ in range(5000)}
    rows = stem.with_stem(spark.createDataFrame([(w,) for w in sorted(words)], "term string")).collect()
    assert [r for r in rows if stem.stem(r.term) != r.stem] == []


# --- tiles and bounds


def test_tiles_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (300, 5)).astype(float)  # many ties
    store = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(7, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(-i, v.tolist()) for i, v in enumerate(x[:50])] + [(5, None)], "query_id long, qvec array<double>")
    want = []
    for i, q in enumerate(x[:50]):
        s = x @ q
        want += [(-i, n + 1, int(j) * 3, s[j]) for n, j in enumerate(np.lexsort((np.arange(300), -s))[:7])]
    for most in (1, 9, 1 << 16):
        assert rows_of(collection.top_k_blocked(store, queries, 7, most)) == sorted(want)
    assert collection.top_k_blocked(store, queries.where("false"), 7).count() == 0
    assert rows_of(collection.top_k_blocked(store, queries, 1000)) == rows_of(collection.top_k(store.where("embedding is not null"), queries.where("qvec is not null"), 1000))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(1000, 16))
    x = np.repeat(centers, 6, 0) + 0.05 * rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return stage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "clustered")


def test_search_with_a_bound_is_exact(spark, clustered):
    queries = clustered.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    centroids, listed = ann.build(clustered, lists=1000, most=4)
    assert listed.agg(F.max("part")).first()[0] > 0
    want = rows_of(collection.top_k_blocked(clustered, queries))
    assert rows_of(ann.search_exact(listed, queries)) == want
    asked = ann._numbered(queries)
    probed, every = ann.probes_exact(listed, asked).count(), asked.count() * listed.select("list_id", "part").distinct().count()
    assert probed < 0.8 * every
    near = {r[:1] + r[2:3] for r in rows_of(ann.search(centroids, listed, queries, nprobe=32))}
    assert np.mean([r[:1] + r[2:3] in near for r in want]) >= 0.9  # 32 of 1,000 lists
    loose = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")  # not of unit length
    two = loose.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    assert rows_of(ann.search_exact(ann.build(loose, lists=5)[1], two, 3)) == rows_of(collection.top_k(loose, two, 3))


# --- the store and the stream


def some_log(rng, batches, ids=40):
    rows = []
    for seq in range(batches):
        op = rng.choice(["insert", "delete"])
        rows.append([(seq, pos, o, rng.randrange(ids), [float(seq), float(pos)] if o == "insert" else None) for pos, o in enumerate(rng.choices([op, op, "insert", "delete"], k=6))])
    return rows


def sequential(batches):
    there, done = {}, []
    for batch in batches:
        for seq, pos, op, i, v in batch:
            ok = (i in there) == (op == "delete")
            done.append((seq, pos, op, i, ok))
            if ok and op == "insert":
                there[i] = v
            elif ok:
                del there[i]
    return done, there


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_store_against_sequential(spark, tmp_path):
    batches = some_log(random.Random(9), 8)
    store = VectorStore(spark, str(tmp_path / "v"), buckets=8)
    got = []
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, oplog.LOG)
        if n == 4:
            store.compact()
        got += [tuple(r) for r in store.apply(df, n).collect()]
        if n == 5:  # run again
            got[-len(batch) :] = [tuple(r) for r in store.apply(df, n).collect()]
    done, there = sequential(batches)
    assert sorted(got) == sorted(done)
    now = lambda s: {r.vec_id: r.embedding for r in s.current().collect()}
    assert now(store) == there == now(VectorStore(spark, str(tmp_path / "v")))
    store.compact()
    assert now(store) == there and store.compact() == [] and not list((tmp_path / "v/delta").glob("batch=*"))
    before = files(tmp_path / "v/base")
    store.apply(spark.createDataFrame([(100, 0, "insert", 1000, [1.0])], oplog.LOG))
    assert files(tmp_path / "v/base") == before  # a batch rewrites nothing
    due = store.compact()
    after = files(tmp_path / "v/base")
    kept = [p for p in before if p in after]
    assert len(due) == 1 and all(before[p] == after[p] for p in kept) and len(before) - len(kept) <= 1 and len(set(after) - set(before)) == 1
    assert now(store) == there | {1000: [1.0]}
    assert rows_of(store.apply(spark.createDataFrame([], oplog.LOG))) == []


def test_outcomes_of_a_stream(spark, tmp_path):
    batches = some_log(random.Random(11), 6)
    source, target, point = (str(tmp_path / x) for x in ("log", "out", "point"))
    for half in (batches[:3], batches[3:]):  # the second run goes on from the state of the first
        spark.createDataFrame([r for b in half for r in b] + [(half[0][0][0], 99, "search", 1, None)], oplog.LOG).coalesce(1).write.mode("append").parquet(source)
        out = oplog.outcomes(spark.readStream.schema(oplog.LOG).parquet(source))
        out.writeStream.option("checkpointLocation", point).trigger(availableNow=True).start(target, "parquet", "append").awaitTermination()
    assert rows_of(spark.read.schema(oplog.OUTCOME).parquet(target)) == sorted(sequential(batches)[0])


def test_a_store_that_follows_a_stream(spark, tmp_path):
    batches = some_log(random.Random(12), 6)
    source, store = str(tmp_path / "log"), VectorStore(spark, str(tmp_path / "v"), buckets=4)
    for part in (batches[:2], batches[2:4], batches[4:]):
        spark.createDataFrame([r for b in part for r in b] + [(part[0][0][0], 99, "search", 1, None)], oplog.LOG).coalesce(1).write.mode("append").parquet(source)
        oplog.keep_up(spark.readStream.schema(oplog.LOG).parquet(source), store, str(tmp_path / "point"), compact_every=2).awaitTermination()
    assert {r.vec_id: r.embedding for r in store.current().collect()} == sequential(batches)[1]
    assert [p.name for p in (tmp_path / "v/delta").glob("batch=*")] == ["batch=2"]  # earlier ones are compacted


@pytest.mark.parametrize("compact_every", [1, 16])
def test_bucket_index_calls(spark, compact_every):
    index = scenario.BucketIndex(spark, 2, compact_every=compact_every)
    done = index.insert(spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "pos long, vec_id long, embedding array<float>"))
    assert rows_of(done) == [(0, 1, True), (1, 2, True)]
    assert rows_of(index.delete(spark.createDataFrame([(0, 2), (1, 2), (2, 9)], "pos long, vec_id long"))) == [(0, 2, True), (1, 2, False), (2, 9, False)]
    assert rows_of(index.insert(spark.createDataFrame([(0, 1, [5.0, 5.0]), (1, 2, [2.0, 2.0])], "pos long, vec_id long, embedding array<float>"))) == [(0, 1, False), (1, 2, True)]
    found = index.search(spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, qvec array<double>"), 5)
    assert rows_of(found) == [(0, 1, 2, 4.0), (0, 2, 1, 1.0)]


# --- cancellation


def test_a_slow_operation_is_stopped(spark):

    def sleepy(frames):
        for f in frames:
            time.sleep(20)
            yield f

    slow = lambda: [spark.range(1).count(), spark.range(4).mapInPandas(sleepy, "id long").count()]
    spark.range(1).count()
    start = time.perf_counter()
    with pytest.raises(scenario.Late):
        scenario.limited(spark, slow, 1.5)
    assert time.perf_counter() - start < 2.5
    assert scenario.limited(spark, lambda: spark.range(5).count(), 60.0) == 5  # what comes after runs
    with pytest.raises(ValueError):
        scenario.limited(spark, lambda: int("x"), 60.0)


# --- NumPy files


@pytest.mark.parametrize("shape", [(0, 3), (1,), (1000,), (1000, 7), (10, 0)])
@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2"])
def test_npy_by_ranges_of_rows(spark, tmp_path, shape, kind):
    x = np.arange(int(np.prod(shape))).reshape(shape).astype(kind)
    for name, a in (("rows", x), ("columns", np.asfortranarray(x))):
        np.save(tmp_path / f"{name}.npy", a)
        df = npy.load(spark, str(tmp_path / f"{name}.npy"), share=512)
        want = [(i, [float(v) for v in np.atleast_1d(r)]) for i, r in enumerate(x)]
        assert rows_of(df) == want == rows_of(readers.npy(spark, str(tmp_path / f"{name}.npy")))
        if x.nbytes > 2000:
            assert df.rdd.getNumPartitions() >= x.nbytes // 512


# --- pages in the order of their files, and more of them


def test_ids_go_by_file_and_are_kept_when_pages_are_added(spark, tmp_path):
    from marlstone import engine

    def write(folder, names):
        (tmp_path / folder).mkdir()
        for name, page in names.items():
            (tmp_path / folder / f"{name}.json").write_text(json.dumps({"page_id": page, "title": f"p{page}", "content": f"The page {page} is old. It stands. " + "stone " * (30 * page)}))
        return readers.corpus(spark, str(tmp_path / folder))

    first, more = write("a", {"b": 1, "a": 9, "c": 4}), write("z", {"y": 2, "x": 7})
    root = str(tmp_path / "index")
    store = engine.build(spark, first, root)
    before = {r.chunk_id: r.page_id for r in store.load("chunk_meta").collect()}
    assert list(dict.fromkeys(before[i] for i in sorted(before))) == [9, 1, 4] and sorted(before) == list(range(len(before)))
    store = engine.append(spark, more, root)
    after = {r.chunk_id: r.page_id for r in store.load("chunk_meta").collect()}
    assert list(dict.fromkeys(after[i] for i in sorted(after))) == [9, 1, 4, 7, 2] and sorted(after) == list(range(len(after)))
    assert {i: after[i] for i in before} == before and store.load("vectors").count() == len(after) == store.load("lists").count()
    whole = engine.build(spark, first.unionByName(more), str(tmp_path / "whole"))
    asked = spark.createDataFrame([("q", "old page 7"), ("r", "stands 1")], "query_id string, query string")
    assert rows_of(engine.run(asked, store)) == rows_of(engine.run(asked, whole))


def test_passages_without_inner_words_are_found_without_a_nested_loop(spark):
    from marlstone.operators import passages

    docs = spark.createDataFrame([(1, "an old stone tower"), (2, "stonework"), (3, ""), (4, None)], "page_id long, text string")
    items = spark.createDataFrame([("a", "stone"), ("b", "stone"), ("c", "d s"), ("d", ""), ("e", "tower bridge"), ("f", None)], "query_id string, item string")
    found = passages.holding(docs, items)
    assert rows_of(found) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("d", 2), ("d", 3)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(passages._short(docs, items.where("item is not null"), most=20)) == rows_of(found)  # several automata


def test_white_space_runs_are_linear(spark):
    from marlstone.functions import text as T

    x = "a" + " " * 300_000 + "b\n" + "  " * 1000
    start = time.perf_counter()
    got = spark.createDataFrame([(x,), (" \t",), ("",), ("  c \n",)], "x string").select(T.strip(F.col("x"))).collect()
    assert [r[0] for r in got] == [x.rstrip(), "", "", "c"] and time.perf_counter() - start < 20


def test_best_holds_little_whatever_the_number_of_queries():
    rng = np.random.default_rng(7)
    q, x = rng.normal(size=(20_000, 4)), rng.normal(size=(3000, 4))
    tracemalloc.start()
    best = tiles.Best(q, 5)
    for at in range(0, 3000, 1000):
        best.see(np.arange(at, at + 1000), x[at : at + 1000])
    place, ids, score = next(best.end())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # a whole matrix of 20,000 x 1,024 doubles has 164 MB, and was copied
    assert np.array_equal(place, np.repeat(np.arange(20_000), 5))
    for i in range(0, 20_000, 997):
        assert ids[place == i].tolist() == np.lexsort((np.arange(3000), -np.round(x @ q[i], tiles.DIGITS)))[:5].tolist()


def test_candidates_of_tiles_scored_by_columns(spark):
    store = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(100, None), (101, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 0.0]), (3, None)], "query_id long, qvec array<double>")
    for k in (4, 61):
        got, want = (f(store, queries, k) for f in (collection.top_k_scored, collection.top_k))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = collection.top_k_scored(store, queries)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_lists_are_scored_as_tiles(spark, clustered):
    _, listed = ann.build(clustered, lists=40, most=100)
    asked = ann._numbered(clustered.where("vec_id % 500 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")))
    parts = listed.select("list_id", "part").distinct()
    probes = stage(asked.select("nth").crossJoin(parts).where(F.xxhash64("nth", "list_id", "part") % 3 == 0), "probes")
    got = tiles.meet_lists(listed, asked, probes, 6)
    pairs = probes.join(asked, "nth").join(listed, ["list_id", "part"])
    every = pairs.select(F.col("nth").alias("query_id"), "vec_id", F.round(collection.dot(F.col("qvec"), F.col("embedding")), 6).alias("score"))
    assert got.count() <= 6 * 4 * asked.count() < every.count()  # k for each tile, not a row for each pair
    assert rows_of(collection._first(got.withColumnRenamed("nth", "query_id"), 6)) == rows_of(collection._first(every, 6))


def test_probes_are_as_many_as_the_recall_needs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))  # in no clusters: 32 of 64 lists hold too few
    x /= np.linalg.norm(x, axis=1)[:, None]
    store = stage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "loose")
    queries = store.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    centroids, listed = ann.build(store, lists=256)
    want = {r[:1] + r[2:3] for r in rows_of(collection.top_k_blocked(store, queries))}
    found = lambda n: len(want & {r[:1] + r[2:3] for r in rows_of(ann.search(centroids, listed, queries, nprobe=n))}) / len(want)
    assert found(ann.NPROBE) < 0.9 <= found(ann.probes_for(centroids, listed))


def test_hybrid_search_without_lists(spark, clustered, monkeypatch):
    q = clustered.where("vec_id % 97 = 0").select(F.struct(F.col("vec_id").alias("a"), F.lit(-1).alias("b")).alias("query_id"), F.col("embedding").alias("qvec"))
    flat = lambda df: rows_of(df.select("query_id.a", "query_id.b", "rank", "vec_id", "score"))
    assert flat(ann.search_tiles(clustered, q, 7)) == flat(collection.top_k(clustered, q, 7))

    def fitted(*_, **__):
        raise AssertionError("lists are fitted and written for one search of every vector")

    monkeypatch.setattr(ann, "build", fitted)
    got = catalog.QUERIES["hybrid_pages"](spark, "/root/testdata/sf0.001")
    assert got.groupBy("query_id").count().where("count > 10").isEmpty() and not got.isEmpty()


def test_white_space_by_trimming(spark):
    named = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "Z")
    white = re.compile(text.SPACE.replace(r"\p{Z}", re.escape(named)), re.ASCII).findall("".join(map(chr, range(0xD800))))
    assert sorted(white) == sorted(text.SPACES)
    rng = random.Random(9)
    rows = ["".join(rng.choices([*white, "a", "é", "​", "."], k=rng.randint(0, 12))) for _ in range(2000)]
    ends = "".join(white)
    got = spark.createDataFrame(list(enumerate(rows)), "i long, x string").select("i", text.strip(F.col("x")).alias("y")).collect()
    assert all(r.y == rows[r.i].strip(ends) for r in got)
    plan = spark.range(1).select(text.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan.lower()  # one looks at each place of a text


def test_first_sentences_are_split_alone(spark):
    rng = random.Random(10)
    rows = ["".join(rng.choices(["a", "b. ", "! ", "?\n", " ", ".", " "], k=rng.randint(0, 15))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(F.slice(text.sentences(F.col("x")), 1, 2).alias("want"), text.sentences(F.col("x"), 2).alias("got"))
    assert df.where("want <> got").count() == 0


def test_pages_are_dealt_before_they_are_cleaned(spark):
    pages = spark.createDataFrame([(i, " t\t", " one. two! three ") for i in range(20)], "page_id long, title string, content string")
    assert {r.text for r in chunk_corpus(pages).collect()} == {"t. one. two!"}
    seen = []
    dealt = type(pages).repartitionByRange

    def held(self, *a):
        seen.append(self._jdf.queryExecution().analyzed().toString().lower())
        return dealt(self, *a)

    type(pages).repartitionByRange = held
    try:
        chunk_corpus(pages)
    finally:
        type(pages).repartitionByRange = dealt
    assert seen and "trim" not in seen[0] and "regexp" not in seen[0]  # the sample of ids would clean whole texts for nothing


def test_a_task_counts_words_by_their_numbers(spark, monkeypatch):
    rng = random.Random(11)
    words = ["Running", "run", "runs", "ÉTÉ", "naïve", "x1", "İstanbul", "K", "1820s", "boxes", "box", "ßs", "_", "日本a"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    lowered = dict(map(tuple, spark.createDataFrame(rows, "i long, x string").select("i", F.lower("x")).collect()))
    want = {}
    for i, x in lowered.items():
        for word in re.findall("[a-z0-9]+", x):
            for term in {word, stem.stem(word)}:
                want[term, i] = want.get((term, i), 0) + 1
    monkeypatch.setattr(bm25, "HELD", 50)  # blocks in several rows, words forgotten between them
    monkeypatch.setattr(bm25, "STEMS", 5)
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1)
    made = []
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda self, f, *_, **__: made.append((self, f)))
    bm25.term_counts(chunks, 64)
    lower, f = made[0]
    table = lower.toArrow()
    out = [r for b in f(iter(table.to_batches())) for r in b.to_pylist()]
    got = {(r["term"], r["block"] * 64 + at): tf for r in out for at, tf in zip(r["at"], r["tf"], strict=True)}
    assert got == want and sum(r["n"] for r in out) == len(want) and sum(r["total"] for r in out) == sum(want.values())
    lengths = {i: sum(n for (_, j), n in want.items() if j == i) for _, i in want}
    assert all(dl == lengths[r["block"] * 64 + at] for r in out for at, dl in zip(r["at"], r["dl"], strict=True))
    known = bm25.Words()
    assert [known[w] for w in (b"running", b"run", b"running")] == [0, 1, 0] and known.roots == [1, 1]


def test_blocks_of_few_terms_are_not_shuffled(spark):
    chunks = spark.createDataFrame([(i, f"alpha w{i % 50} stone{i}") for i in range(300)], "chunk_id long, text string")
    i, few = bm25.build(chunks), spark.createDataFrame([("w7",), ("stone5",), ("absent",)], "term string")
    plan = i.blocks(stage(few, "few"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning(term" not in plan.split("BroadcastExchange")[0]
    assert rows_of(i.blocks(few).select("term", "df").distinct()) == [("stone5", 1), ("w7", 6)]


@pytest.fixture
def nothing_is_small(spark):
    """As over large tables, of whose size Spark knows no better."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins_of(df):
    return re.findall(r"(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) \[([a-z_]+)#", df._jdf.queryExecution().executedPlan().toString())


def test_blocks_stay_where_few_keys_meet_them(spark, index, terms, nothing_is_small, monkeypatch):
    rows, stats = index
    b, scored, seen = stage(blocks.blocked(rows, 64), "blocks"), blocks._scored, []
    monkeypatch.setattr(blocks, "_scored", lambda *a, **k: seen.append(scored(*a, **k)) or seen[-1])
    got = blocks.query(b, stats, terms, 10, 64)
    assert len(seen) == 2 and all(("BroadcastHashJoin", "term") in joins_of(x) and ("SortMergeJoin", "term") not in joins_of(x) for x in seen)
    want = rows_of(got.select("query_id", "stream_id", "chunk_id", "score", "rank"))
    monkeypatch.setattr(blocks, "FEW", 0)
    got = blocks.query(b, stats, terms, 10, 64)
    assert ("SortMergeJoin", "term") in joins_of(seen[-1]) and rows_of(got.select("query_id", "stream_id", "chunk_id", "score", "rank")) == want


def test_frequencies_of_the_asked_terms_alone(spark, nothing_is_small, monkeypatch):
    chunks = spark.createDataFrame([(i, f"alpha w{i % 50} stone{i}") for i in range(300)], "chunk_id long, text string")
    i, some = bm25.build(chunks), spark.createDataFrame([("w7",), ("stone5",), ("alpha",), ("absent",)], "term string")
    made = i.blocks(some)
    assert "df" not in i.__dict__  # the frequencies of all terms
    assert joins_of(made) == [("BroadcastHashJoin", "term")]
    assert rows_of(made.select("term", "df").distinct()) == [("stone5", 1), ("w7", 6)]
    whole = i.blocks().where(F.col("term").isin("w7", "stone5"))
    assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect()))


def test_texts_stay_where_few_pairs_meet_them(spark, nothing_is_small, monkeypatch):
    from marlstone.operators import passages

    docs = spark.createDataFrame([(n, f"one two three four {n % 3} 4 five six seven eight".replace("1 4", "1")) for n in range(30)], "page_id long, text string")
    items = spark.createDataFrame([("a", "wo three four 1 five six"), ("b", "4 five six seven eight"), ("b", "four 2 4 five six seven e"), ("c", "these words are in no text")], "query_id string, item string")
    want = sorted([("a", n) for n in range(1, 30, 3)] + [("b", n) for n in range(30) if n % 3 != 1] + [("b", n) for n in range(2, 30, 3)])
    found = passages.holding(docs, items)
    assert "SortMergeJoin" not in str(joins_of(found)) and rows_of(found) == want
    for name in ("PAIRS", "BROADCAST"):
        monkeypatch.setattr(passages, name, 0)
        assert rows_of(passages.holding(docs, items)) == want


# --- search by one scan


@pytest.mark.parametrize(("k", "width"), [(3, 16), (200, 1024)])
def test_a_scan_finds_what_the_index_finds(spark, monkeypatch, k, width):
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(500)] + ["Running", "runs", "boxes", "é"]
    pages = [(None if i == 7 else 3 * i, rng.choice(["", "t w1"]), " ".join(rng.choices(words, k=rng.choice([0, 1, 25, 400])))) for i in range(200)]
    pages = stage(spark.createDataFrame(pages, "page_id long, title string, content string").repartition(5), "scan-pages")
    asking = [(q, s, t) for q in range(5) for s in range(2) for t in rng.sample(words, 4)] + [(0, 0, "run"), (0, 0, "box"), (9, 0, "absent"), (8, 0, "w1"), (8, 0, "w1")]
    terms = stage(spark.createDataFrame([(q, s, t.lower()) for q, s, t in asking], "query_id long, stream_id long, term string"), "scan-terms")
    chunks = chunk_corpus(pages)
    i = bm25.build(chunks)
    want = bm25.query(i.postings, terms, k).join(chunks.drop("text"), "chunk_id")
    monkeypatch.setattr(bm25, "HELD", 300)  # a range in several rows
    columns = ["query_id", "stream_id", "chunk_id", "page_id", "chunk_type", "score", "rank"]
    got = scan.search(placed(pages), terms, k, width)
    assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect()))
    assert scan.search(placed(pages.where("false")), terms, k, width).count() == scan.search(placed(pages), terms.where("false"), k, width).count() == 0


def test_rows_of_a_scan_are_scored_where_they_are(spark):
    chunks = spark.createDataFrame([(i, i, "body", f"w{i % 5} other{i}") for i in range(40)], "chunk_id long, page_id long, chunk_type string, text string").coalesce(2)
    rows = stage(scan.counts(chunks, ["absent", "w1", "w2"], 16), "scan-rows")
    assert sorted(x for r in rows.collect() for x in r.at) == sorted(i % 16 for i in range(40))  # each chunk once
    assert sum(r.tokens for r in rows.collect()) == 80 and {t for r in rows.collect() for t in r.term} == {1, 2}
    hits = scan.best(rows, [(4, [1]), (6, [1, 2])], [0.0, 1.0, 2.0], 2.0, 3, 16)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    tasks = rows.rdd.getNumPartitions()
    assert all(3 <= n <= 3 * tasks for n in hits.groupBy("nth").count().toPandas()["count"])  # the best of each task, not all hits


@pytest.fixture
def searched(spark, tmp_path):
    """A folder of documents, and what a query of it writes: (rows, the columns of all that it wrote)."""
    docs = [(i, None if i == 3 else f"mountain river {'harbor ' * (i % 4)}u{i}a u{i}b u{i}c", "src", "en", 1) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "harbor river of u5a"), (2, "the u7b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    where = shared_dir(spark).removeprefix("file://") + "/marlstone"

    def run(name):
        before = set(os.listdir(where)) if os.path.isdir(where) else set()
        rows = sorted(map(str, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        return rows, [c for d in set(os.listdir(where)) - before for c in spark.read.parquet(f"file://{where}/{d}").columns]

    return run


def test_rrf_fuse_writes_no_texts_and_no_whole_index(searched, monkeypatch):
    rows, written = searched("rrf_fuse")
    assert rows and not {"text", "tf", "df", "total"} & set(written)
    monkeypatch.setattr(scan, "few", lambda terms: False)  # too many terms for each task: in the index
    assert searched("rrf_fuse")[0] == rows


def test_search_pages_writes_no_texts_and_no_whole_index(searched, monkeypatch):
    rows, written = searched("search_pages")
    assert rows and not {"text", "tf", "df", "total"} & set(written)
    monkeypatch.setattr(scan, "few", lambda terms: False)
    assert searched("search_pages")[0] == rows
