"""python -m marlstone build | evaluate | scenario: an index from a corpus, its score on a query set, a scenario's score."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import engine
from .operators import fusion, metrics, scenario
from .sources import readers
from .sources.store import Store


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="marlstone")
    each = top.add_subparsers(dest="command", required=True)
    build = each.add_parser("build", help="a folder of JSON pages to an index")
    build.add_argument("--pages", required=True)
    build.add_argument("--index", required=True)
    build.add_argument("--no-dense", action="store_true")
    build.add_argument("--append", action="store_true", help="to an index that is there")
    evaluate = each.add_parser("evaluate", help="a query set against an index: mean NDCG@10 and seconds")
    evaluate.add_argument("--queries", required=True)
    evaluate.add_argument("--index", required=True)
    for n in (None, 1, 2, 3):  # shortcuts for the first three
        replay = each.add_parser("scenario" if n is None else f"scenario-{n}", help=f"scenario {'' if n is None else n}".strip() + " against the bucketed store")
        replay.add_argument("--data", default="data/public")
        if n is None:
            replay.add_argument("--scenario", type=int, required=True)
        else:
            replay.set_defaults(scenario=n)
        replay.add_argument("--recalibrate-baseline", action="store_true")
        replay.add_argument("--runs", type=int, default=scenario.RUNS)
        replay.add_argument("--wall-limit", type=float, default=scenario.WALL_LIMIT)
    return top.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Runs a command, shows its figures and returns them as one row."""
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("marlstone").getOrCreate()
    if a.command == "build":
        with scenario.timed("build", print) as spent:
            pages = readers.corpus(spark, a.pages)
            store = engine.append(spark, pages, a.index) if a.append else engine.build(spark, pages, a.index, dense=not a.no_dense)
        out = spark.createDataFrame([(store.load("chunk_meta").count(), spent())], "chunks bigint, seconds double")
    elif a.command == "evaluate":
        asked = readers.queries(spark, a.queries)
        store = Store(spark, a.index)
        with scenario.timed("search", print) as spent:
            score = metrics.evaluate_run(lambda q: fusion.page_lists(q, engine.run(q, store)), asked)
        out = spark.createDataFrame([(asked.count(), score, spent())], "queries bigint, mean_ndcg double, seconds double")
    else:
        folder = f"{a.data}/scenario_{a.scenario:02d}"
        if not readers.exists(spark, folder):
            raise FileNotFoundError(folder)
        base = scenario.baseline(spark, folder, n_runs=a.runs, recalibrate=a.recalibrate_baseline)
        print(" ".join(f"{k}={v:.4f}s" for k, v in base.items()))
        out = scenario.stats_frame(spark, scenario.replay(spark, folder, scenario.BucketIndex, base["baseline_dynamic"], a.wall_limit))
    out.show(truncate=False, vertical=True)
    return out


if __name__ == "__main__":
    main()
