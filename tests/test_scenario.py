"""Scenario replay, its files, baseline and command line, against a sequential simulation."""

import json
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.__main__ import main
from marlstone.operators import ann, metrics, scenario
from marlstone.sources import readers


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 1.0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Inserts (one as pickled pairs, one as Parquet), deletes with a repeated id, searches; the truth is off in some ids."""
    root = tmp_path_factory.mktemp("data") / "scenario_01"
    root.mkdir()
    rng = np.random.default_rng(4)
    store, ops, totals = {}, [], {"insert": 0, "delete": 0, "search": 0}
    expected = {"insert": 0.0, "delete": 0.0, "search": 0.0}

    def mutation(n, kind, ids, vectors=None):
        ok, bad = [], []
        for i in ids:
            good = (i not in store) if kind == "insert" else (i in store)
            (ok if good else bad).append(i)
            if good and kind == "insert":
                store[i] = vectors[i]
            elif good:
                del store[i]
        truth = [i for i in ok if i % 5], [i for i in bad if i % 5]
        (root / f"gt{n}.json").write_text(json.dumps({"succeeded": truth[0], "failed": truth[1]}))
        totals[kind] += len(ids)
        return kind, len(ids) * (jaccard(ok, truth[0]) + jaccard(bad, truth[1])) / 2

    parts = []
    for n, (lo, hi) in enumerate([(0, 30), (20, 50)]):
        vectors = {i: rng.normal(size=4).astype(np.float32) for i in range(lo, hi)}
        if n:
            pd.DataFrame({"pos": range(hi - lo), "vec_id": list(vectors), "embedding": [v.tolist() for v in vectors.values()]}).to_parquet(root / f"batch{n}.parquet")
        else:
            held = np.empty((len(vectors), 2), object)
            held[:, 0], held[:, 1] = list(vectors), list(vectors.values())
            np.save(root / f"batch{n}.npy", held, allow_pickle=True)
        parts.append(mutation(n, "insert", list(vectors), vectors))
        ops.append({"type": "insert", "batch": f"batch{n}.{'parquet' if n else 'npy'}", "gt": f"gt{n}.json"})
        if not n:
            ids = [3, 4, 3, 99, 12]
            np.save(root / "ids.npy", np.array(ids))
            parts.append(mutation(9, "delete", ids))
            ops.append({"type": "delete", "ids": "ids.npy", "gt": "gt9.json"})
        queries = rng.normal(size=(6 - 3 * n, 4)).astype(np.float32)
        names = np.array(sorted(store))
        best = names[np.argsort(-(queries.astype(float) @ np.array([store[i] for i in names], float).T), axis=1)[:, :10]]
        best[:, 0] = 1000  # a tenth is missed
        np.save(root / f"q{n}.npy", queries)
        np.save(root / f"best{n}.npy", best)
        ops.append({"type": "search", "queries": f"q{n}.npy", "gt": f"best{n}.npy"})
        totals["search"] += len(queries)
        parts.append(("search", len(queries) * 0.9))
    for kind, score in parts:
        expected[kind] += score / totals[kind]
    (root / "manifest.json").write_text(json.dumps({"config": {f"total_{k}": v for k, v in totals.items()}, "dim": 4, "operations": ops}))
    return str(root), expected


@pytest.mark.parametrize("factory", [scenario.LogIndex, scenario.StoreIndex])
def test_replay(spark, folder, factory):
    root, expected = folder
    s = scenario.replay(spark, root, factory, 1e9)
    assert all(abs(s[f"{k}_score"] - v) < 1e-9 for k, v in expected.items())
    assert abs(s["functional_score"] - (0.5 * expected["search"] + 0.3 * expected["insert"] + 0.2 * expected["delete"])) < 1e-9
    assert s["runtime_multiplier"] == 1.0 and s["final_score"] == s["functional_score"] and not s["wall_timeout"]
    assert s["initial_time"] > 0 and abs(s["total_time"] - s["initial_time"] - s["dynamic_time"]) < 1e-9
    assert scenario.stats_frame(spark, s).columns == list(scenario.STATS)


def test_wall_limit_and_missing_baseline(spark, folder):
    s = scenario.replay(spark, folder[0], scenario.LogIndex, 1e9, wall_limit=0.0)
    assert s["wall_timeout"] == 1.0 and s["runtime_multiplier"] == 0.5 and s["functional_score"] == 0.0
    slow = scenario.replay(spark, folder[0], scenario.LogIndex, 1e-6)
    assert slow["runtime_multiplier"] == 0.5 and slow["speed_ratio"] > 2
    with pytest.raises(ValueError):
        scenario.replay(spark, folder[0], scenario.LogIndex, None)


def test_baseline_is_cached(spark, folder, monkeypatch):
    found = scenario.baseline(spark, folder[0], n_runs=2)
    assert found["baseline_time"] == found["baseline_dynamic"] > 0
    monkeypatch.setattr(scenario, "measure", None)
    assert scenario.baseline(spark, folder[0], n_runs=2) == found
    with pytest.raises(TypeError):
        scenario.baseline(spark, folder[0], n_runs=3)
    with pytest.raises(TypeError):
        scenario.baseline(spark, folder[0], n_runs=2, recalibrate=True)


def test_command_line(spark, folder, tmp_path, capsys):
    data = folder[0].rpartition("/")[0]
    out = main(["scenario", "--data", data, "--scenario", "1", "--runs", "1"], spark).first()
    assert 0 < out.final_score <= 1 and "baseline_dynamic=" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        main(["scenario", "--data", data, "--scenario", "7"], spark)
    pages = tmp_path / "pages"
    pages.mkdir()
    for i, word in enumerate(("tower", "bridge", "harbour")):
        (pages / f"{i}.json").write_text(json.dumps({"page_id": i, "title": word, "content": f"The {word} is old. It stands. " + "stone " * 30}))
    assert main(["build", "--pages", str(pages), "--index", str(tmp_path / "index"), "--no-dense"], spark).first().chunks == 6
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "a", "query": "old bridge", "relevant_page_ids": ["1"]}, {"query_id": "b", "query": "harbour", "relevant_page_ids": [2]}]))
    got = main(["evaluate", "--queries", str(tmp_path / "q.json"), "--index", str(tmp_path / "index")], spark).first()
    assert got.queries == 2 and got.mean_ndcg == 1.0
    assert [r.relevant_page_ids for r in readers.raw_queries(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()] == [["1"], ["2"]]


def test_runs_are_checked(spark):
    asked = spark.createDataFrame([("a", "x", [1]), ("b", "y", [2])], "query_id string, query string, relevant array<bigint>")
    one = lambda ids: lambda q: q.select("query_id", F.lit(None).cast("array<bigint>").alias("none"), F.array(*map(F.lit, ids)).cast("array<bigint>").alias("page_ids"))
    assert metrics.evaluate_run(one([2, 1]), asked) == 1.0
    with pytest.raises(ValueError):
        metrics.evaluate_run(lambda q: one([1])(q).where("query_id = 'a'"), asked)
    with pytest.raises(TypeError):
        metrics.evaluate_run(lambda q: q.select("query_id", F.lit("1").alias("page_ids")), asked)
    assert metrics.evaluate_run(one([1]), asked.where("false")) == 0.0


def test_pickled_pairs_load_arrays_only(spark, tmp_path):
    held = np.empty((3, 2), object)
    held[:, 0], held[:, 1] = [7, 8, 7], [np.array([1.0, 2.0], np.float32), np.array([3.0, 4.0], np.float32), np.array([5.0, 6.0], np.float32)]
    np.save(tmp_path / "a.npy", held, allow_pickle=True)
    assert sorted((r.pos, r.vec_id, r.embedding) for r in readers.insert_batch(spark, str(tmp_path / "a.npy")).collect()) == [(0, 7, [5.0, 6.0]), (1, 8, [3.0, 4.0])]
    held[0, 1] = print
    np.save(tmp_path / "b.npy", held, allow_pickle=True)
    with pytest.raises(Exception, match="isn't an array or a number"):
        readers.insert_batch(spark, str(tmp_path / "b.npy")).collect()
    assert pickle.UnpicklingError


def test_model_embedding(spark):
    texts = spark.createDataFrame([(i, None if i == 2 else "x" * i) for i in range(5)], "text_id long, text string")
    got = {r.text_id: r.embedding for r in ann.model_embedding(texts, lambda: lambda some: np.array([[len(t), 1.0] for t in some]), batch=2).collect()}
    assert len(got) == 5
    for i, v in got.items():
        n = 0 if i == 2 else i
        assert np.allclose(v, np.array([n, 1.0]) / np.hypot(n, 1.0), atol=1e-6)
