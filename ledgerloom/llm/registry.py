"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, hardnegatives, langid, languagemodel, licenses, mainpage, neighbours, personal, prefixtrie, simhash, tokenfiles, toxicity
from ledgerloom.llm.common import split_of, table


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_of(F.col("doc_id"), 7) == 2
    scored = languagemodel.score(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_ids")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.concat_ws(",", F.array_sort(F.array_distinct("licenses.name"))).alias("names"),
        F.array_max("licenses.coverage").alias("best_coverage"),
        F.transform("licenses", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("spans"),
    )


def op3_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfiles.read(manifest, with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = split_of(F.col("doc_id"), 4) == 2
    scored = toxicity.score(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = mainpage.main_text(pages.select(F.struct("page_id", "url").alias("__page"), "html"), id_col="__page")
    return text.select("__page.page_id", "__page.url", "text", "n_chars")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_of(F.col("doc_id"), 3) == 1
    found = langid.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        "op1_language_model": op1_language_model,
        "op2_licenses": op2_licenses,
        "op3_tokenfiles": op3_tokenfiles,
        "op4_toxicity": op4_toxicity,
        "op5_bpe": op5_bpe,
        "op6_embeddings": op6_embeddings,
        "op7_mainpage": op7_mainpage,
        "op8_langid": op8_langid,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_personal_data": op12_personal_data,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn,
         strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c, x) & 255, [CAST(0 AS BIGINT) for i in range(8)]),
        lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, CAST(3988292384 AS BIGINT)) ELSE t >> 1 END)))) % 9 AS h
  FROM turns
), pieces AS (
  SELECT c.conv_id, t.pos, 0 AS own, t.turn, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, 1, t.turn, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), sequences AS (
  SELECT c.conv_id, coalesce(list(p.turn ORDER BY own, pos) FILTER (p.turn IS NOT NULL), CAST([] AS VARCHAR[])) AS seq,
         coalesce(list(p.bytes ORDER BY own, pos) FILTER (p.turn IS NOT NULL), CAST([] AS BIGINT[])) AS sizes
  FROM convs c LEFT JOIN pieces p USING (conv_id) GROUP BY c.conv_id
), places AS (
  SELECT conv_id, d AS depth, seq[1:d] AS prefix, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes, d = len(seq) AS ends
  FROM sequences, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM places GROUP BY prefix, depth
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (prefix, depth)
), above AS (
  SELECT prefix[1:d] AS prefix, d AS depth, n_children, (n_convs - 1) * bytes AS saved
  FROM counted, LATERAL (SELECT unnest(range(0, depth + 1)) AS d)
), sums AS (
  SELECT prefix, depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY prefix, depth
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (prefix, depth)
LEFT JOIN nodes p ON c.depth > 0 AND p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": HARD_NEGATIVES, "op13_prefix_trie": PREFIX_TRIE}
