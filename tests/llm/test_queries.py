"""The opN_ queries and the pipeline themselves, with their own settings, by brute force on the smallest tables."""

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pytest
from test_operators import base_pii, brute_fingerprint, words

import __spark_entry__ as entry
from marlstone.llm import mixing, packing, vectors

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
COLUMNS = {
    "op1_hmm_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_pii_weak_supervision": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_learned_partitions": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_chat_windows": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_pfair_mixing": "doc_id bigint, source string, block bigint, slot bigint",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}
digest = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def run(spark, name):
    df = entry.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    return df.collect()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "documents")


def test_op1(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts, ends = {}, 0
    for d in docs:
        if not held(d.doc_id):
            ends += 1
            for w in words(d.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r.doc_id: r for r in run(spark, "op1_hmm_lm_score")}
    assert len(got) == len(docs)
    for d in docs:
        r, w = got[d.doc_id], words(d.text)
        base = sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d.doc_id), len(w) + 1, sum(x in counts for x in w) + 1, n) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    away = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_op2(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op2_pii_weak_supervision")}
    assert len(got) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 0
    for d in docs:
        base, r = base_pii(d.text or ""), got[d.doc_id]
        assert r.base_sha256 == digest(base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_op3(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, "embeddings")}
    ids = np.array(sorted(rows))
    u = vectors.unit(np.array([rows[i] for i in ids]))
    got = {}
    for r in run(spark, "op3_learned_partitions"):
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hit = 0
    for q, some in got.items():
        s = u @ u[np.searchsorted(ids, q)]
        some.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in some] == [1, 2, 3, 4, 5] and all(abs(r.score - s[np.searchsorted(ids, r.vec_id)]) < 1e-12 and r.vec_id != q for r in some)
        assert [(-r.score, r.vec_id) for r in some] == sorted((-r.score, r.vec_id) for r in some)
        s[np.searchsorted(ids, q)] = -2
        hit += len({r.vec_id for r in some} & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(got)


def test_op4_and_pipeline(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_file())
    got = run(spark, "op4_best_fit_packing")
    expected, total = [], 0
    for d in docs:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        expected += [(d.doc_id, k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // 2048)) for x in [ids[2048 * k : 2048 * (k + 1)]]]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    for rows in (got, entry.queries()["pipeline"](spark, SF).collect()):
        by_seq = {}
        for r in rows:
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for runs in by_seq.values():
            runs.sort()
            assert [a for a, _ in runs] == [0, *itertools.accumulate(n for _, n in runs)][:-1] and sum(n for _, n in runs) <= 2048
        assert {r.doc_id for r in rows} <= {d.doc_id for d in docs} and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert len({r.sequence_id for r in got}) <= total / 2048 * 1.02 + 1


def test_op5(spark):
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(table(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in run(spark, "op5_chat_windows")}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(b) for _, b in turns)


def test_op6(spark, docs):
    got = run(spark, "op6_pfair_mixing")
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    chars = {}
    for d in docs:
        chars[d.source] = chars.get(d.source, 0) + len(d.text or "") + 1
    blocks = {s: (n - 1) // (1 << 16) + 1 for s, n in chars.items()}
    names = sorted(chars, key=lambda s: (-chars[s], s is not None, s or ""))
    plan = mixing.phases({i: blocks[s] for i, s in enumerate(names)}, mixing.shares_of({i: np.sqrt(chars[s]) for i, s in enumerate(names)}))
    slots = {(names[s], first + k): start + k // len(p) * size + p[k % len(p)] for s, first, end, start, size, p in plan for k in range(end - first)}
    assert sorted(slots.values()) == list(range(sum(blocks.values()))) and all(r.slot == slots[r.source, r.block] for r in got)


def test_op7(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op7_language_id")}
    assert len(got) == len(docs)
    right = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out and d.lang and re.search(r"[^\W\d_]", d.text or "")]
    assert np.mean(right) >= 0.95 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())


def test_op8(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op8_simhash_dedup")}
    fps = np.array([brute_fingerprint(d.text) for d in docs], np.uint64)
    assert [got[d.doc_id].fingerprint for d in docs] == [f"{int(x):016x}" for x in fps]
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, np.array([d.doc_id for d in docs])
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if (new == label).all():
            break
        label = new
    assert [got[d.doc_id].component_id for d in docs] == label.tolist()


def test_op9(spark, docs):
    patterns = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = {r.doc_id: r for r in run(spark, "op9_secret_scan")}
    assert len(got) == len(docs)
    for d in docs:
        base = [(k, a, b) for a, _, k, b in sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(patterns) for m in p.finditer(d.text or "") if ok(m))]
        r = got[d.doc_id]
        assert r.base_sha256 == digest(base) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, *_ in base) for x in ("assign", "access", "hex")]


def test_op10(spark):
    rows = sorted(table(spark, "embeddings"), key=lambda r: r.vec_id)
    u = vectors.unit(np.array([r.embedding for r in rows], float))
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    label = np.arange(len(u))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(u)).min(1))
        if (new == label).all():
            break
        label = new
    ids = [r.vec_id for r in rows]
    assert sorted(map(tuple, run(spark, "op10_embedding_dedup"))) == [(i, int(near[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)]


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the cat and the dog", "en", "a", 19), (3, "the cat and the dog", "en", "a", 19), (4, "the cat and the dog", None, None, None), (None, "the house on the hill", "en", "a", 21), (5, "der hund und die katze", "de", "b", 22), (6, "the " * 30000, "en", "c", 120000), (10, "la " * 5 + "casa", "es", "d", 19)]
    for name, some, more in (("odd", rows, ["key", "__lang", "slot", "part", "run", "at", "spans"]), ("empty", [], [])):
        df = spark.createDataFrame(some, schema)
        df.selectExpr("*", *(f"'x' AS `{c}`" for c in more)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = entry.queries()["pipeline"](spark, f"{tmp_path}/odd").collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in got}) == [-1, 3, 5, 6, 10]
    assert sorted((r.piece, r.length) for r in got if r.doc_id == 3) == [(0, 6)]
    assert entry.queries()["pipeline"](spark, f"{tmp_path}/empty").count() == 0
