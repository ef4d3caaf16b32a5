"""The containment join against all pairs, and the words it joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import answers, containment, retrieval

QUERIES, TEXTS = "query long, terms array<string>", "chunk_id long, terms array<string>, query long, n int"


def tables(seed):
    """Words by rank of use: the first ones stand in most texts."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 60)}"
    queries = [(i, [word() for _ in range(rng.randint(0, 7))]) for i in range(40)] + [(100, None), (101, []), (102, ["unheard"]), (103, ["w1", "w1", "unheard"])]
    texts = [(i, [word() for _ in range(rng.randint(0, 12))], 5, 5) for i in range(300)] + [(900, None, 5, 5), (901, [], 5, 5)]
    return queries, texts


@pytest.mark.parametrize(("least", "hot", "lookup"), [(0.3, 20_000, 10), (0.4, 10, 0), (1.0, 3, 0), (0.01, 5, 2), (0.3, 7, 2)])
def test_pairs_equal_all_pairs(spark, least, hot, lookup):
    queries, texts = tables(int(least * 100))
    found = containment.contained(spark.createDataFrame(queries, QUERIES).repartition(2), spark.createDataFrame(texts, TEXTS).repartition(3), least, hot=hot, lookup=lookup)
    expected = []
    for q, words in queries:
        for c, held, *_ in texts:
            share = len(set(words) & set(held or ())) / len(set(words)) if words else 0
            if share >= least:
                expected.append((q, c, share))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_common_words_are_not_joined(spark):
    """A word that all texts hold is no reason to compare a pair, where a query has rarer ones."""
    texts = spark.createDataFrame([(i, ["common", f"rare{i}"], 0, 0) for i in range(500)], TEXTS)
    queries = spark.createDataFrame([(i, ["common", f"rare{i}"]) for i in range(50)], QUERIES)
    words = containment.words_of(queries)
    pairs = containment.candidate_pairs(words, containment.held_words(words, texts), 1.0, lookup=0)
    assert pairs.count() == 50
    with pytest.raises(ValueError):
        containment.candidate_pairs(words, texts, 0)


def test_only_hot_words_are_broadcast(spark):
    queries, texts = tables(1)
    words = containment.words_of(spark.createDataFrame(queries, QUERIES))
    held = containment.held_words(words, spark.createDataFrame(texts, TEXTS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = containment.candidate_pairs(words, held, 0.3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin [word" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    queries, texts = tables(2)
    none_q, none_t = spark.createDataFrame([], QUERIES), spark.createDataFrame([], TEXTS)
    assert containment.contained(none_q, spark.createDataFrame(texts, TEXTS), 0.3).collect() == []
    assert containment.contained(spark.createDataFrame(queries, QUERIES), none_t, 0.3).collect() == []


def test_scan_keeps_titles_and_texts(spark):
    chunks = spark.createDataFrame([(1, "장학금 신청 절차", "지원 대상"), (2, "없음", "신청 절차"), (3, None, None), (4, "다른 글", "")], "chunk_id long, text string, section_title string")
    queries = spark.createDataFrame([(7, "신청하려면 절차를 알려줘"), (8, None)], "query long, text string")
    found = {r["chunk_id"]: (r["overlap"], r["title_overlap"]) for r in answers.lexical_scan(chunks, queries).collect()}
    assert found == {1: (1.0, 0.0), 2: (0.0, 1.0)}


def test_terms_follow_the_stated_rule(spark):
    said = {
        "신청하려면 어떻게 해야 하나": {"신청", "하나"},
        "장학금에서부터 학교으로부터 집까지": {"장학금", "학교", "집까지"},
        "문서 관련 내용 알려줘 THE Rule-2 x": {"the", "rule"},
        "성적은 있는": {"성적"},
        "": set(),
    }
    df = spark.createDataFrame([(t,) for t in said], "text string").select("text", retrieval.terms(F.col("text")).alias("terms"))
    assert {r["text"]: set(r["terms"]) for r in df.collect()} == said


@pytest.mark.parametrize("step", [1 << 20, 3])
def test_words_of_few_queries_are_counted_where_texts_are_read(spark, monkeypatch, step):
    """The same pairs by a scan and by joins, with nothing shuffled by the scan."""
    monkeypatch.setattr(containment, "STEP", step)
    queries, texts = tables(3)
    q, t = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(texts, TEXTS).repartition(3)
    for least in (0.01, 0.4, 1.0):
        scanned = containment.contained(q, t, least)
        assert "Exchange" not in scanned._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").replace("Exchange RoundRobinPartitioning", "")
        assert sorted(tuple(r) for r in scanned.collect()) == sorted(tuple(r) for r in containment.contained(q, t, least, postings=0).collect())
    with pytest.raises(ValueError):
        containment.contained(q, t, 0)


def test_scans_of_chunks_equal_joins(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"말{rng.randint(0, 30)}" for _ in range(n))
    chunks = spark.createDataFrame([(i, text(rng.randint(0, 20)), text(rng.randint(0, 3))) for i in range(200)] + [(500, None, None)], "chunk_id long, text string, section_title string")
    queries = spark.createDataFrame([(f"q{i}", text(rng.randint(0, 6))) for i in range(30)] + [("none", None)], "query string, text string")
    rows = lambda **more: sorted(tuple(r) for r in answers.lexical_scan(chunks, queries, **more).collect())
    assert rows() == rows(postings=0) and rows()


@pytest.mark.parametrize("postings", [0, 1000])
def test_repeated_ids_of_texts_count_as_one(spark, postings):
    texts = spark.createDataFrame([(1, ["a", "b"], 0, 0), (1, ["a", "c"], 0, 0), (2, ["a"], 0, 0)], TEXTS)
    found = containment.contained(spark.createDataFrame([(7, ["a", "b", "c", "d"])], QUERIES), texts, 0.25, postings=postings)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 1, 0.75), (7, 2, 0.25)]
