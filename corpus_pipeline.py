"""Corpus pipeline: language, toxicity, near-duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the
columns of ``documents`` (the last one tokens). ``run`` writes each stage to the shared folder as Parquet
and rereads it, and deletes it when the next one is written.

All stages take null ids, texts, languages and sources, texts of any length, and further columns of any name, which they hand on as they
are; an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, langid, simhash, toxicity
from ledgerloom.llm.common import materialize, release, split_of, table, whole_rows

#: A document stays if its language is known with at least this mean probability.
LANGUAGE_SCORE = 0.5
#: A document goes if its toxicity score reaches this.
TOXIC_SCORE = 0.3
#: A document goes if it holds a whole window of ten words of a benchmark item.
WINDOW = 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, those without letters, and those whose words are of no language on the whole.

    Equal expected numbers of words go to the first language; equal rows are judged alike. Without any labelled row nothing can be
    recognised and every document goes.
    """
    rows = whole_rows(docs).withColumn("lang", F.col("__row.lang"))
    found = langid.identify(rows, split_of(F.col("__row.doc_id"), 3) != 1, id_col="__row")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select("__row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic window go, wherever it lies in the text.

    Null and empty texts are scored as one empty window; equal rows are judged alike. Without labels no document goes.
    """
    rows = whole_rows(docs).withColumn("doc_id", F.col("__row.doc_id"))
    scored = toxicity.score(rows, table(spark, sf_dir, "labels"), split_of(F.col("doc_id"), 4) != 2, id_col="__row")
    return scored.where(F.col("score") < TOXIC_SCORE).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id, null ids coming last.

    Rows that share an id are told apart by a hash of all their columns; of equal rows one stays. Null and empty texts are copies of each other.
    """
    columns = docs.columns
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("hash"))
    keyed = docs.withColumn("__key", key)
    classes = simhash.near_duplicates(keyed, id_col="__key", shingle=3)
    chosen = materialize(classes.where("__key = component_id").groupBy("__key").count(), "chosen")
    kept = keyed.join(chosen.select("__key"), "__key", "left_semi")
    twice = chosen.where("count > 1").select("__key")
    if twice.isEmpty():
        return kept.select(columns)
    once, again = kept.join(twice, "__key", "left_anti"), kept.join(twice, "__key", "left_semi")
    return once.unionByName(again.dropDuplicates(["__key"])).select(columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, wherever it lies in the text.

    Null and empty texts hold none; equal rows are judged alike; an empty benchmark removes nothing.
    """
    scanned = decontaminate.scan_documents(whole_rows(docs), table(spark, sf_dir, "benchmark"), window=WINDOW, id_col="__row")
    return scanned.where("n_hit = 0").select("__row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of ids and of the decoded text.

    Null and empty texts have no ids; of equally ranked pairs the leftmost merges first; equal rows get equal ids; other columns end here.
    """
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("BPE encoding", tokens),
]

#: Stages run trained models and fingerprints, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = materialize(stage(spark, before, sf_dir), name.split()[0].lower())
        release(before)
    return docs
