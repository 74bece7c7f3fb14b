"""From raw documents to packed sequences: language, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, langid, mixing, nearcopies, packing, pii


OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def beside(step: Stage) -> Stage:
    """The stage, which sees columns that aren't those of documents as one, so that none of their names can clash with its own."""

    @functools.wraps(step)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in OWN]
        if not more:
            return step(spark, docs, sf_dir)
        held = docs.select(*(c for c in docs.columns if c in OWN), F.struct(*(F.col(f"`{c}`") for c in more)).alias("_more"))
        return step(spark, held, sf_dir).select(*(c if c in OWN else F.col("_more").getField(c).alias(c) for c in docs.columns))

    return whole


@beside
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language (null, empty, or no letter at all) go; the others' lang is the predicted one. Repeated
    rows and null ids stay; very long texts are parsed whole. Where no row has a language to learn from, no document has one
    and all go."""
    texts = langid.training_texts(langid.training_rows(docs))
    said = langid.predict(docs, texts, *docs.columns, out=("__lang", "__score"))
    return said.where(F.col("__lang") != langid.UNKNOWN).withColumn("lang", F.col("__lang")).select(*docs.columns)


@beside
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts at a similarity of 0.8 or more by sets of five words are near copies. op8's fingerprints and keys find the
    nearest; what three bits can't tell is found as `nearcopies` says. The document with the smallest id of each group
    stays; rows that repeat an id and its text are one document (which of them is open where other columns differ), and
    rows without an id stay, since nothing could name them. Null and blank texts are copies of each other."""
    groups = nearcopies.near_components(docs)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    print_ = F.xxhash64("text").alias("__print")
    twice = kept.select("doc_id", print_).groupBy("doc_id", "__print").count().where("count > 1").drop("count")
    twice = common.stage(twice, "near-repeated")
    if not twice.isEmpty():
        marked = kept.select("*", print_)
        once = marked.join(twice, ["doc_id", "__print"], "left_semi").dropDuplicates(["doc_id", "__print"])
        kept = marked.join(twice, ["doc_id", "__print"], "left_anti").unionByName(once).select(*docs.columns)
    return kept.union(docs.where(F.col("doc_id").isNull()))


@beside
def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind, and n_chars is that of the new text (null for a null one); all documents stay,
    those with null, empty and very long texts, repeated rows and null ids too."""
    found = pii.label(docs, pii.fit(docs.select("text")), out="__spans")
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("__spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@beside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots: a null source is one of its own, a null text is one character long, ties
    of a slot come by a hash of id and text. An empty table stays empty."""
    return mixing.mixed_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of the mixed order are packed one by one, so that sequences come in the proportions of the slots. A null or blank
    text is one piece with only the end id; a very long one is cut; repeated rows are packed one by one; an empty table gives
    no rows."""
    return packing.pack_in_order(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("pii", remove_pii),
    ("mixing", mix_sources),
    ("packing", best_fit_packing),
]

#: SQL has neither the automata nor the hashes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf_dir), name)
        common.release()
    return STAGES[-1][1](spark, docs, sf_dir)
