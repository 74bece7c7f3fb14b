"""Limits that were found wanting: white space in linear time, probes by vectors that the fit never saw, tiles by bytes; op7 by brute force."""

import os
import time

import numpy as np
import pytest
import regex

import __spark_entry__ as entry
from marlstone.llm import chat, embdedup, langid, mixing, neighbours, simhash, vectors


def test_chat_windows_with_long_white_space(spark):
    words = "ab, " * 1500
    texts = [words + " " * 80_000, words + " " * 80_000 + "end", " " * 80_000, "\n" * 30_000 + words + " " * 20]
    convs = spark.createDataFrame([(c, i, "user" if i % 2 == 0 else "assistant", t) for c in range(2) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    start = time.perf_counter()
    read = chat.read_windows(chat.windows(convs, chat.Budget())).select("conv_id", "window", chat.said(chat.F.col("turns")).alias("said"), "targets").orderBy("conv_id", "window").collect()
    assert time.perf_counter() - start < 60
    for c in range(2):
        own = [r for r in read if r.conv_id == c]
        assert "".join(r.said for r in own) == "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n{t}\n" for i, t in enumerate(texts))
        assert "".join(t for r in own for t in r.targets) == texts[1] + texts[3]


def test_probes_hold_for_vectors_outside_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 16))
    x = (centers[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, asked = [], []
    fit, needed = neighbours.fit, neighbours.needed_probes
    monkeypatch.setattr(neighbours, "fit", lambda y, *rest: seen.append(y) or fit(y, *rest))
    monkeypatch.setattr(neighbours, "needed_probes", lambda placed, router, y, *rest: asked.append(y) or needed(placed, router, y, *rest))
    got = neighbours.search(df, settings=neighbours.Settings(sample=1500)).collect()
    known = {v.tobytes() for v in seen[0]}
    assert 1000 < len(known) < 2000 and len(asked[0]) > 100 and not known & {v.tobytes() for v in asked[0]}
    u, hit, n = vectors.unit(x), 0, 0
    for q in range(0, 6000, 50):
        if u[q].tobytes() not in known:
            s = (u * u[q]).sum(1)
            s[q] = -2
            hit += len(set(np.lexsort((np.arange(6000), -s))[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
            n += 5
    assert n >= 5 * 60 and hit >= 0.9 * n


@pytest.mark.parametrize("dim", [1, 64, 4096])
def test_tiles_are_bounded_by_bytes(dim):
    assert 1 <= embdedup.tile_rows(dim) * dim * 8 <= max(embdedup.TILE_BYTES, dim * 8) and embdedup.tile_rows(dim) <= embdedup.TILE


def phrases(text, train):
    """Phrases of the greedy parse: the longest runs that occur in the training text; a character that doesn't is one."""
    at = n = 0
    while at < len(text):
        size, place = 0, 0
        while at + size < len(text) and (place := train.find(text[at : at + size + 1], place)) >= 0:
            size += 1
        at += max(size, 1)
        n += 1
    return n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_op7_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    train = langid.training_texts(langid.training_rows(docs))
    got = {r.doc_id: r for r in entry.queries()["op7_language_id"](spark, sf).collect()}
    for d in docs.collect():
        words = regex.sub(r"[^\p{L}\p{M}]+", " ", (d.text or "").lower()).strip()
        if not regex.search(r"\p{L}", d.text or ""):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        counts = sorted((phrases(f" {words} ", t), lang) for lang, t in train.items())
        assert got[d.doc_id].lang_pred == counts[0][1] and abs(got[d.doc_id].score - (1 - counts[0][0] / counts[1][0])) < 1e-12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_the_pipeline_keeps_one_of_each_group_of_near_copies(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect())
    rows = sorted(docs.collect(), key=lambda d: d.doc_id)
    sets = []
    for d in rows:
        words = (d.text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    assert got == [d.doc_id for i, d in enumerate(rows) if root(i) == i] and len(got) < len(rows)


def test_large_keys_are_dealt_by_a_third_segment(spark):
    rng = np.random.default_rng(6)
    centers = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for c in centers:
        for _ in range(250):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 9), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for large in (simhash.LARGE, 20, 0):
        pairs = [(place[r.u], place[r.v]) for r in simhash.links(df, large).collect()]
        assert all(near[a, b] for a, b in pairs)
        own = np.arange(len(fps))
        for _ in range(len(fps)):
            before = own.copy()
            for a, b in pairs:
                own[a] = own[b] = min(own[a], own[b])
            if (own == before).all():
                break
        assert own.tolist() == label.tolist()


def test_three_hundred_sources_keep_within_a_block(spark):
    rows = [(i, "x" * 9, f"s{i % 300:03d}") for i in range(3000)] + [(3000 + i, "x" * 9, f"s{i % 30:03d}") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_chars=10).collect()
    assert sorted(r["__mix_slot"] for r in got) == list(range(4500))
    slots = {}
    for r in got:
        slots.setdefault(r.source, []).append(r["__mix_slot"])
    first = min(max(x) for x in slots.values()) + 1  # until one runs out all weigh by the root of their size
    roots = {s: len(x) ** 0.5 for s, x in slots.items()}
    share = mixing.shares_of(roots, 8 * 300)
    total, at = sum(share.values()), np.arange(1, first + 1)
    assert first > 1000
    for s, x in slots.items():
        done = np.searchsorted(np.sort(x), at)  # blocks before each slot
        assert (np.abs(done - at * share[s] / total) < 1).all(), s
